"""Union of JSON fragments: objects merge key by key at any depth, arrays append, nulls change nothing, other values overwrite.

Fragments are VARIANT values that are opened level by level. On each level the fragments of a document meet by path, so a
document's fragments are never held together as wholes; what a later value of another kind replaces goes before its inside
is opened. The result is put together from the deepest level up, an aggregate a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.lineage import cut

#: Between the keys of a path; no JSON text holds it unescaped.
STEP = "\x01"


def kind_of(value: Column) -> Column:
    """object, array or scalar; null for JSON's null."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind != "VOID", "scalar")


def quoted(key: Column) -> Column:
    """A key as JSON writes it."""
    return F.regexp_replace(F.to_json(F.array(key)), r"^\[|\]$", "")


def current(values: DataFrame) -> DataFrame:
    """Of the values (key, path, seq, value, kind) of each path those that count: of the last one's kind, with none of another kind after."""
    w = Window.partitionBy("key", "path")
    last = F.max(F.struct("seq", "kind")).over(w)
    values = values.where("kind is not null").withColumn("last", last)
    broken = F.max(F.when(F.col("kind") != F.col("last.kind"), F.col("seq"))).over(w)
    kept = values.withColumn("broken", broken).where("kind = last.kind and (broken is null or seq > broken)")
    return kept.where("kind != 'scalar' or seq = last.seq").select("key", "path", "seq", "value", "kind")


def inside(values: DataFrame) -> DataFrame:
    """The members of objects, by path."""
    members = values.lateralJoin(values.sparkSession.tvf.variant_explode(F.col("value").outer()))
    members = members.toDF("key", "path", "seq", "value", "kind", "pos", "k", "member").where("k is not null")
    path = F.concat_ws(STEP, F.nullif(F.col("path"), F.lit("")), F.col("k"))
    return members.select("key", path.alias("path"), "seq", F.col("member").alias("value"), kind_of(F.col("member")).alias("kind"))


def texts(values: DataFrame) -> DataFrame:
    """(key, path, text) of what is no object: the last scalar, the items of all arrays but nulls in order."""
    scalars = values.where("kind = 'scalar'").select("key", "path", F.to_json("value").alias("text"))
    arrays = values.where("kind = 'array'")
    items = arrays.lateralJoin(arrays.sparkSession.tvf.variant_explode_outer(F.col("value").outer())).toDF("key", "path", "seq", "value", "kind", "pos", "k", "item")
    own = F.when(F.col("item").isNotNull() & kind_of(F.col("item")).isNotNull(), F.struct("seq", "pos", F.to_json("item").alias("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]), ",")
    return scalars.unionByName(items.groupBy("key", "path").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("text")))


def union(fragments: DataFrame, key: str, order: str, body: str, deepest: int = 64) -> DataFrame:
    """(key, merged): the union of each key's fragments in an order, with keys in ASCII order; null if no fragment is an object.

    ``body`` is JSON text; what is null, malformed or no object changes nothing. Fragments of one order number merge in no
    defined order, so ``order`` should be unique within a key. JSON nested deeper than ``deepest`` raises an error.
    """
    value = F.try_parse_json(F.col(body))
    top = fragments.select(F.col(key).alias("key"), F.lit("").alias("path"), F.col(order).cast("long").alias("seq"), value.alias("value"), kind_of(value).alias("kind"))
    objects, levels = top.where("kind = 'object'"), []
    while True:
        members = cut(current(inside(objects)))
        levels.append((objects.select("key", "path").distinct(), texts(members)))
        objects = members.where("kind = 'object'")
        if objects.isEmpty():
            break
        if len(levels) == deepest:
            raise ValueError(f"JSON is nested deeper than {deepest}")
    made = None
    for owners, own in reversed(levels):
        own = own if made is None else own.unionByName(made)
        name = F.substring_index("path", STEP, -1)
        parent = F.when(F.contains("path", F.lit(STEP)), F.regexp_replace("path", f"{STEP}[^{STEP}]*$", "")).otherwise("")
        fields = F.array_sort(F.collect_list(F.struct(name.alias("name"), F.concat(quoted(name), F.lit(":"), F.col("text")).alias("field"))))
        joined = own.groupBy("key", parent.alias("path")).agg(F.array_join(F.transform(fields, lambda x: x["field"]), ",").alias("fields"))
        full = owners.join(joined, (owners["key"].eqNullSafe(joined["key"])) & (owners["path"] == joined["path"]), "left")
        made = full.select(owners["key"], owners["path"], F.concat(F.lit("{"), F.coalesce("fields", F.lit("")), F.lit("}")).alias("text"))
    keys = fragments.select(F.col(key).alias("k")).distinct()
    return keys.join(made, keys["k"].eqNullSafe(made["key"]), "left").select(F.col("k").alias(key), F.col("text").alias("merged"))
