"""Static analysis of Python sources as a table function, a violation table, a zero-filled report and a command."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from glyphloom.functions.guard_rules import RULES, Finding, Source, check_source, shown
from glyphloom.sources.tables import python_sources

Rules = dict[str, Callable[[Source], Iterator[Finding]]]

#: What the command prints.
SUMMARY = "Guard rule summary:"
COUNTED = "  {rule}: {violations} violations"
FAILED = "Guard checks failed:"
PASSED = "Guard checks passed: no violations found."


def findings(more: Rules | None = None) -> UserDefinedTableFunction:
    """Table function: path and source of a file to its violations, of the rules there are and ``more``."""
    rules = {**RULES, **(more or {})}

    class Findings:
        def eval(self, path: str, source: str) -> Iterator[tuple[str, int, str, str]]:
            if path is not None and source is not None:
                yield from check_source(path, source, rules)

    return F.udtf(Findings, returnType="rule string, line_no int, kind string, line string")


def violations(sources: DataFrame, more: Rules | None = None) -> DataFrame:
    """path, rule, line_no, kind and line of every violation in ``sources`` (path, source).

    ``more`` has further rules by name: functions from a ``Source`` to line number, kind and line of what they find.
    """
    spark = sources.sparkSession
    spark.udtf.register("guard_findings", findings(more))
    sources.createOrReplaceTempView("_guard_sources")
    return spark.sql("SELECT s.path, f.rule, f.line_no, f.kind, f.line FROM _guard_sources s, LATERAL guard_findings(s.path, s.source) f")


def report(found: DataFrame, more: Rules | None = None) -> DataFrame:
    """Every rule in order with its number of violations, zero included."""
    names = found.sparkSession.createDataFrame([(i, name) for i, name in enumerate({**RULES, **(more or {})})], "rule_order int, rule string")
    counts = found.groupBy("rule").agg(F.count(F.lit(1)).alias("k"))
    return names.join(counts, "rule", "left").select("rule_order", "rule", F.coalesce("k", F.lit(0)).cast("long").alias("violations"))


def run_guards(spark: SparkSession, root: str) -> int:
    """Check a project folder and print; 0 if clean, 2 with violations, 1 if it has no pyproject.toml."""
    if not (Path(root) / "pyproject.toml").exists():
        print(f"no pyproject.toml in {root}", file=sys.stderr)
        return 1
    found = violations(python_sources(spark, root)).persist()
    print(SUMMARY)
    for row in report(found).orderBy("rule_order").collect():
        print(COUNTED.format(**row.asDict()))
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    bad = False
    for row in found.orderBy(order, "path", "line_no").toLocalIterator():
        if not bad:
            print(FAILED, file=sys.stderr)
        bad = True
        print(f"  {row['path'].removeprefix(root.rstrip('/') + '/')}:{row['line_no']}: {row['kind']} {shown(row['line'])}", file=sys.stderr)
    found.unpersist()
    if not bad:
        print(PASSED)
    return 2 if bad else 0
