"""Row-level quality rules: valid rows, quarantine, violation counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _broken(expression: str) -> Column:
    """True only where the rule is FALSE; an unknown result passes."""
    return ~F.coalesce(F.expr(expression), F.lit(True))


def split_by_rules(
    df: DataFrame, rules: Mapping[str, str], source: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Split into rows that break no rule, and rows that do with the names of those rules.

    The two are disjoint and together hold every input row.  Works on batch
    and streaming frames alike.
    """
    any_broken = reduce(lambda a, b: a | b, (_broken(e) for e in rules.values()), F.lit(False))
    names = F.array_compact(F.array(*[F.when(_broken(e), F.lit(n)) for n, e in rules.items()]))
    quarantine = df.filter(any_broken).withColumns({
        "_failed_dq_rules": names,
        "_quarantine_timestamp": F.current_timestamp(),
        "_source_table": F.lit(source),
    })
    return df.filter(~any_broken), quarantine


def drop_and_count(
    df: DataFrame, rules: Mapping[str, str], observation: Observation | str
) -> DataFrame:
    """Keep valid rows and count violations per rule in the same pass (``observe``)."""
    counts = [F.count_if(_broken(e)).alias(n) for n, e in rules.items()]
    return split_by_rules(df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts), rules)[0]
