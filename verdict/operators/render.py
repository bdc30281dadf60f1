"""Test-file assembly: import lines, template rendering, import set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_

# The test-class template with its placeholders.
ESTEST_TEMPLATE = """package {TEST_PACKAGE};

import org.junit.Test;
import static org.junit.Assert.*;
import static org.evosuite.runtime.EvoAssertions.*;
{TEST_IMPORTS}
import java.util.Random;
import org.junit.Assert;
import org.evosuite.runtime.EvoRunner;
import org.evosuite.runtime.EvoRunnerParameters;
import org.junit.runner.RunWith;

@RunWith(EvoRunner.class) @EvoRunnerParameters(mockJVMNonDeterminism = true, useVFS = true, useVNET = true, resetStaticState = true, separateClassLoader = true, useJEE = true) 
public class {TEST_CLASS_NAME}_ESTest extends {TEST_CLASS_NAME}_ESTest_scaffolding {
  {TEST_CASES}
}
"""


# The start of a line up to '@RunWith', and an import line from its first to its last character that is no blank.
_RUN_WITH_RE = r"(?U)(?:^|\n)[\s&&[^\n]]*@RunWith"
_IMPORT_RE = r"(?U)(?:^|\n)[\s&&[^\n]]*(import(?:[^\n]*\S)?)"


def import_lines(text: Column | str) -> Column:
    """Stripped lines starting with 'import', up to (excluding) the first '@RunWith' line."""
    return F.regexp_extract_all(F.split(col_(text), _RUN_WITH_RE, 2)[0], F.lit(_IMPORT_RE), F.lit(1))


def template_imports() -> list[str]:
    """Import lines of the template itself (the same rule applied to the fixed text)."""
    out = []
    for line in ESTEST_TEMPLATE.split("\n"):
        s = line.strip()
        if s.startswith("import"):
            out.append(s)
        if s.startswith("@RunWith"):
            break
    return out


def extra_imports(imports: Column | str) -> Column:
    """File imports minus template imports, as a sorted set (the set order of the
    reference is arbitrary; sorting makes it deterministic)."""
    harness = F.array(*[F.lit(i) for i in template_imports()])
    return F.sort_array(F.array_except(col_(imports), harness))


def support_classes(extra: Column | str) -> Column:
    """'"a.B", "c.D"' list of the scaffolding from the extra imports."""
    return F.array_join(F.transform(col_(extra), lambda i: F.concat(F.lit('"'), F.replace(i, F.lit("import "), F.lit("")),
                                                                     F.lit('"'))), ", ")


def render_template(package: Column, imports: Column, class_name: Column, cases: Column,
                    template: str = ESTEST_TEMPLATE) -> Column:
    """Fill the placeholders of ``template`` (nested replace, JVM-side)."""
    return fill(template, {"{TEST_PACKAGE}": package, "{TEST_IMPORTS}": F.array_join(imports, "\n"),
                           "{TEST_CLASS_NAME}": class_name, "{TEST_CASES}": cases})


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template given as text (read it from the caller's file) with its placeholders replaced, in order."""
    out = F.lit(template)
    for placeholder, value in values.items():
        out = F.replace(out, F.lit(placeholder), value)
    return out


def import_consistency(df: DataFrame, group: Sequence[str], imports: str) -> DataFrame:
    """Per group: members and whether they all have the same import set; sets meet by their digest."""
    key = F.sha2(F.array_join(F.sort_array(F.array_distinct(F.col(imports))), "\n"), 256)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("members"),
                                  (F.count_distinct(key) == 1).alias("same_imports"))
