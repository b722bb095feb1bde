"""Counts that are taken while rows pass, so that a report costs no pass of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, and what their counts will be: ``get`` of the second waits for the first action on the first.

    Only that action counts, and only if it reads all rows (a limit or an early stop may not).
    """
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in counts.items())), seen


def import_report(read: DataFrame) -> tuple[DataFrame, Observation]:
    """Imported files, and how many there were, how many failed, held warnings or jobs."""
    return observed(
        read,
        files=F.count(F.lit(1)),
        failed=F.count("error"),
        warned=F.count_if(F.size("warnings") > 0),
        jobs=F.coalesce(F.sum(F.greatest(F.size("work"), F.lit(0))), F.lit(0)),
    )


def merged_warnings(*stages: Column) -> Column:
    """Warnings of all stages in the order of the stages; a stage without any may be null."""
    return F.concat(*(F.coalesce(s, F.array().cast("array<string>")) for s in stages))
