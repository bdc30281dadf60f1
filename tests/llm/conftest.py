from __future__ import annotations

import pytest

from llm_cases import edited, prose


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    """Nulls, empty and blank texts, ties, repeats, long texts, long words, other scripts."""
    a, b = prose(1, 300), prose(2, 80)
    passage = prose(3, 60)
    return [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two three four", "one two three four five", "One Two THREE four five",
        a, a, edited(a, 5, 3), edited(a, 6, 12), a.upper(), b, b + " " + passage, prose(7, 50) + "\n" + passage + "\n" + prose(8, 50),
        passage, passage + passage, "x" * 30_000, "ab" * 700, ("lo mi ne pu ra " * 400).strip(), "é" * 500, "日本語の文 " * 60,
        prose(9, 6000), edited(prose(9, 6000), 10, 40), "\n".join(["same line here"] * 50), "a\x00b " * 40, "😀 " * 30 + passage,
        "### $$$ %%% &&& " * 20, passage.replace(" ", " "), "z " * 2000,
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """One row per odd text, twice the first id and two null ids, and columns whose names clash with results."""
    rows = [(i if i not in (3, 12) else None, t, None if i % 7 == 0 else f"s{i % 3}", "en", 0, "x", 1.5)
            for i, t in enumerate(odd_texts)]
    rows += [rows[7], rows[7], (7, "another text under the id of seven, as long as it takes to count", "s1", "en", 0, "x", 2.5)]
    schema = "doc_id long, text string, source string, lang string, n_words int, kept string, size double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def plain_docs(spark, odd_texts):
    """The odd texts under unique ids."""
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "en", len(t or "")) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
