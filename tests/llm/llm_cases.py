"""Invented texts for the tests of this folder."""

from __future__ import annotations

import collections
import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to", "vu", "ze") for b in ("ba", "do", "fe", "gu", "hi", "jo", "ky", "la", "mo", "na")]


def prose(seed: int, n: int) -> str:
    """n invented words, some lines, from a seed."""
    rnd = random.Random(seed)
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", " ", " ", ". ", "\n"]) for _ in range(n)).strip()


def edited(text: str, seed: int, edits: int) -> str:
    """The text with some words replaced."""
    rnd = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS) + "x"
    return " ".join(words)


def empty(df):
    return df.limit(0)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if w[s] * level >= cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute_groups(sets):
    """Index -> smallest index that links reach."""
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    common = collections.Counter()
    for rows in by.values():
        for j in range(len(rows)):
            for i in range(j):
                common[rows[i], rows[j]] += 1
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), c in common.items():
        if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def edit_distance(item, text):
    """Least distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


MIT_TEXT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Copyright (c) 2020, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_TEXT = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_TEXT = """Copyright (C) 2020 Some Body

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
