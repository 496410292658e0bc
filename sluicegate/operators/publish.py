"""Second enforcement layer at write time: expectations, their log, audit columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluicegate.model import TemplateConfig

Rules = Mapping[str, Column]


def expectations(cfg: TemplateConfig, checks: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Named predicates of a template: NOT NULL of included columns, then CHECK
    expressions. Uniqueness is not among them; only file validation enforces it."""
    rules = {
        f"{c.column_name}_not_null": F.col(f"`{c.column_name}`").isNotNull()
        for c in cfg.included
        if not c.is_nullable
    }
    for name, text in (checks or {}).items():
        if name in rules:
            raise ValueError(f"expectation named twice: {name!r}")
        rules[name] = F.expr(text)
    return rules


def _holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def meets_all(rules: Rules) -> Column:
    return reduce(lambda a, b: a & b, [_holds(r) for r in rules.values()], F.lit(True))


def expect_or_drop(df: DataFrame, rules: Rules) -> DataFrame:
    """Keep rows that meet every expectation; an unknown (NULL) result drops the row."""
    return df.filter(meets_all(rules))


def expectation_counts(rules: Rules) -> list[Column]:
    """Aggregates behind the log, usable with `observe` during the write itself."""
    return [
        F.count(F.lit(1)).alias("processed"),
        F.count_if(meets_all(rules)).alias("passed_all"),
        *[F.count_if(~_holds(r)).alias(f"dropped_{i}") for i, r in enumerate(rules.values())],
    ]


def expectation_log(df: DataFrame, rules: Rules, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows processed, passed and dropped per expectation, optionally per run:
    (*by, rule, processed, passed, dropped)."""
    counts = df.groupBy(*by).agg(*expectation_counts(rules))
    entries = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col("processed"),
            (F.col("processed") - F.col(f"dropped_{i}")).alias("passed"),
            F.col(f"dropped_{i}").alias("dropped"),
        )
        for i, name in enumerate(rules)
    ]
    return counts.select(*by, F.inline(F.array(*entries)))


def observe_expectations(df: DataFrame, rules: Rules, name: str) -> tuple[DataFrame, Observation]:
    """`expect_or_drop` whose counts are taken while the result is written."""
    observation = Observation(name)
    return expect_or_drop(df.observe(observation, *expectation_counts(rules)), rules), observation


def observed_log(observation: Observation, rules: Rules) -> list[tuple[str, int, int, int]]:
    """(rule, processed, passed, dropped) after the observed frame was written."""
    seen = observation.get
    return [
        (name, seen["processed"], seen["processed"] - seen[f"dropped_{i}"], seen[f"dropped_{i}"])
        for i, name in enumerate(rules)
    ]


def with_audit_columns(
    df: DataFrame, uploaded_by: Column | str, uploaded_at: Column | str, source_file: Column
) -> DataFrame:
    """Add who uploaded (a user name or a column), when the run took place (a timestamp
    text or a column) and the stored file name."""
    who = uploaded_by if isinstance(uploaded_by, Column) else F.lit(uploaded_by)
    when = uploaded_at if isinstance(uploaded_at, Column) else F.lit(uploaded_at).cast("timestamp")
    return df.withColumns({"uploaded_by": who, "uploaded_at": when, "source_file": source_file})
