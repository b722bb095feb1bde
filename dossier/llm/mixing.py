"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget.

Only DataFrame functions run here. A row's hash-random key is a number in the hash space; equal slices of that space
are the ranges of the range sort, so the range a row belongs to is arithmetic and needs no sample. Prefix sums come in
two steps: sums per (source, slice), a running sum over the slices of each source, and a running sum inside the one
slice of each source in which its budget ends. That gives the key at which the source is cut; a row's share follows
from its key alone, so texts are never shuffled, and no task holds more than one slice of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Weights by the rank of the source, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source's target is at most this many times its size, so no document repeats more often.
MAX_EPOCHS = 3
#: Rows a slice holds on average.
SLICE_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a row's hash-random key.
KEY_BITS = 60
#: Columns of the result; a kept column of such a name comes back with an underscore after it.
OWN = ("doc_id", "size", "source_size", "target", "taken")


def random_key() -> Column:
    """The first 60 bits of the MD5 of doc_id and text."""
    said = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, KEY_BITS // 4), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by source, null last: places inside ranges of a distributed sort, then the ranges' offsets."""
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = stash(dealt, "mix-sources")  # written, so that a part is the same whenever it is read
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    # One row a part, so one task may hold them all.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("place", F.row_number().over(inside) - 1).join(offsets, "part")
    return placed.withColumn("rank", F.col("place") + F.col("offset")).drop("part", "place", "offset")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), one row per source: adds ``target``.

    Targets share the sum of all sizes by weight; what a target would have over ``max_epochs`` times its source's
    size is reshared by weight. That ends in a common level: target = min(cap, level * weight). The level rises as
    sources reach their caps, so it is found by rounds: share what the capped sources leave among the others, until no
    further source is capped. Each round is one sum over the sources. An empty table stays empty.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    own = ranked(sizes).withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_epochs)).drop("rank")
    own = stash(own, "mix-caps")
    total = own.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        n, caps, rest = own.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not rest:
            break
        level, capped = (total - (caps or 0.0)) / rest, n
    return own.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Returns (doc_id, *keep, size, source_size, target, taken), one row per row of ``docs``.

    A source whose target is e times its size and a rest takes every document e times and then documents in
    hash-random order until the rest is used up; the document at the cut is taken in part, so a source's words come to
    its target rounded down. The order depends on doc_id and text alone: reruns and other partitionings agree. Rows that
    are equal in both have one key; if the cut falls on them they share what is left in equal parts, rounded down. A null source is a source of its own, last in rank. Null and empty
    texts have size 0 and are taken 0 times; a source without words has target 0. Texts of any length are counted whole.
    An empty table gives an empty result. Other columns are ignored; a kept one named like a result gets an underscore.
    """
    sized = docs.select("source", size_of(F.col("text")).alias("size"), random_key().alias("key"))
    sized = stash(sized, "mix-sizes")
    # Every source is sliced by its own number of rows, so a slice of the largest holds no more than one of the others.
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.count("*") / slice_rows)).cast("int")))
    bits = stash(sized.groupBy(F.col("source").alias("g_source")).agg(bits.alias("bits")), "mix-bits")
    same = F.col("source").eqNullSafe(F.col("g_source"))
    slice_of = F.expr(f"shiftrightunsigned(key, {KEY_BITS} - bits)").alias("slice")
    sized = sized.join(bits, same).select("source", "size", "key", slice_of)

    slices = stash(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices")
    goals = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    goals = goals.withColumn("goal", F.floor("target").cast("long")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    )
    goals = goals.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    goals = stash(goals.withColumnRenamed("source", "g_source"), "mix-goals")
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(running), F.lit(0))).join(goals, same)
    # The slice in which the rest ends: one of each source that takes a rest at all.
    ends = before.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("slice_size")))
    ends = stash(ends.select("g_source", F.col("slice").alias("g_slice"), (F.col("rest") - F.col("before")).alias("left")), "mix-ends")
    last = sized.join(ends, same & (F.col("slice") == F.col("g_slice")))
    last = last.groupBy("source", "key", "left").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("left", F.col("left") - F.coalesce(F.sum("words").over(inside), F.lit(0)))
    cut = last.where((F.col("left") > 0) & (F.col("left") <= F.col("words"))).select(F.col("source").alias("c_source"), F.col("key").alias("c_key"), "left", "words")
    cuts = goals.join(cut, F.col("g_source").eqNullSafe(F.col("c_source")), "left")
    cuts = stash(cuts.select("g_source", "source_size", "target", "epochs", "c_key", "left", "words"), "mix-cuts")

    kept = [F.col(c).alias(c + "_" if c in OWN else c) for c in keep]
    plain = docs.select(
        F.struct("doc_id", *kept).alias("row"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"), random_key().alias("key")
    )
    out = plain.join(cuts, same)
    rest = F.when(F.col("key") < F.col("c_key"), F.col("size")).when(F.col("key") == F.col("c_key"), F.floor(F.col("size") * F.col("left") / F.col("words")))
    return out.select(
        "row.*",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.col("epochs") * F.col("size") + F.coalesce(rest, F.lit(0))).cast("long").alias("taken"),
    )
