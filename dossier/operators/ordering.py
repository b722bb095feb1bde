"""Orders of dated entries, top rows, ranges and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.dates import sort_key


def rank_jobs(df: DataFrame, key: str, draft: Column) -> DataFrame:
    """Adds ``rank``: running entries first, then by start and end, latest first; equal ones by later position; drafts last."""
    start, end = sort_key(F.col("start_month"), F.col("start_year")), sort_key(F.col("end_month"), F.col("end_year"))
    live = lambda c: F.when(~draft, c)
    order = [draft, live(F.col("is_current")).desc(), live(start).desc(), live(end).desc(), live(F.col("pos")).desc(), F.col("pos")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def rank_dated(df: DataFrame, key: str, month: str, year: str, draft: Column) -> DataFrame:
    """Adds ``rank``: latest first, equal ones by position; drafts last."""
    order = [draft, F.when(~draft, sort_key(F.col(month), F.col(year))).desc(), F.col("pos")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def repair_targets(df: DataFrame, key: str, confidence: Column, most: int = 25) -> DataFrame:
    """Fields to repair: lowest confidence first, in order; at most ``most`` a key, with the number dropped."""
    order = Window.partitionBy(key).orderBy(confidence.desc(), "pos")
    ranked = df.withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("dropped", F.greatest(F.count("*").over(Window.partitionBy(key)) - most, F.lit(0)))
    return ranked.where(F.col("rank") <= most)


def recent(df: DataFrame, path: str, ts: str, most: int = 8) -> DataFrame:
    """The latest row of each path, the newest ``most`` of them; blank paths go."""
    w = Window.partitionBy(path).orderBy(F.col(ts).desc())
    latest = df.where(F.col(path).rlike(r"\S")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return latest.orderBy(F.col(ts).desc(), path).limit(most)


def suggest(df: DataFrame, column: str, query: str, most: int = 12) -> DataFrame:
    """Values that hold a text, ignoring case, the first ``most`` by value."""
    return df.where(F.contains(F.lower(column), F.lit(query.lower()))).orderBy(column).limit(most)


def page_range(total: Column, first: Column, last: Column, most: int = 50) -> Column:
    """struct<pages, error> of a 1-based inclusive range: out of bounds, reversed and too long ranges are errors."""
    error = (
        F.when(total < 1, "no_pages")
        .when((first < 1) | (last > total), "out_of_bounds")
        .when(first > last, "reversed")
        .when(last - first + 1 > most, "too_many")
    )
    safe = F.sequence(first, F.greatest(first, last))
    return F.struct(F.when(error.isNull(), safe).alias("pages"), error.alias("error"))


def moved(df: DataFrame, key: str, source: Column, target: Column) -> DataFrame:
    """Adds ``new_pos`` (from 0): the row at ``source`` moves to ``target``, clamped; a move down lands before the target's old place.

    Without a row at ``source`` all keep their places.
    """
    n = F.count("*").over(Window.partitionBy(key))
    to = F.least(F.greatest(target, F.lit(0)), n)
    to = F.least(F.when(to > source, to - 1).otherwise(to), n - 1)
    pos = F.col("pos")
    new = (
        F.when(pos == source, to)
        .when((pos > source) & (pos <= to), pos - 1)
        .when((pos < source) & (pos >= to), pos + 1)
        .otherwise(pos)
    )
    return df.withColumn("new_pos", F.when(source.between(0, n - 1), new).otherwise(pos))


def best_model(df: DataFrame, ram_gb: Column) -> DataFrame:
    """Ranks a catalogue (name, tier, priority): strictest tier that fits first, then priority, then name."""
    top = F.when(ram_gb.isNull(), 1).when(ram_gb < 8, 0).when(ram_gb < 16, 1).when(ram_gb < 32, 2).otherwise(3)
    # The first row's values, by partial aggregates; of rows equal in all of them each would be it, so names should be unique.
    rank = F.struct(F.col("tier") > top, -F.col("tier"), -F.col("priority"), F.col("name"))
    first = df.agg(F.min(rank).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn("recommended", rank == F.col("_first")).withColumn("fits", F.col("tier") <= top).drop("_first")
