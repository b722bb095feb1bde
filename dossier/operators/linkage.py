"""Record linkage: distinct-on, semi and anti joins, upserts, fill-empty merges, layered lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import ci_key, has_text, trim_ws
from dossier.functions.urls import normal_url

#: The collation of keys that ignore case.
CASELESS = "UTF8_LCASE"


def first_by(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """Distinct on keys, the first row of each in an order; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dedupe_skills(skills: DataFrame) -> DataFrame:
    """Named skills of a person once, ignoring case and outer spaces, the first by (gpos, spos); names stay as written."""
    return first_by(skills.where(has_text("name")), ["cv_id", F.collate(trim_ws("name"), CASELESS)], ["gpos", "spos"])


def skills_without(skills: DataFrame, technologies: DataFrame) -> DataFrame:
    """Named skills that are none of the person's technologies (cv_id, name). Unnamed ones go only from persons with any."""
    tech = technologies.where(has_text("name")).select(F.col("cv_id").alias("t_cv"), ci_key("name").alias("t_key")).distinct()
    match = (F.col("cv_id") == F.col("t_cv")) & (ci_key("name") == F.col("t_key"))
    kept = skills.join(tech, match, "left_anti")
    having = tech.select(F.col("t_cv").alias("cv_id"), F.lit(True).alias("any")).distinct()
    return kept.join(having, "cv_id", "left").where(F.col("any").isNull() | has_text("name")).drop("any")


def regroup(groups: DataFrame, skills: DataFrame) -> DataFrame:
    """Groups with their skills as an ordered array; groups without one keep an empty array."""
    each = skills.groupBy("cv_id", "gpos").agg(F.array_sort(F.collect_list(F.struct("spos", "name"))).alias("skills"))
    return groups.join(each, ["cv_id", "gpos"], "left").withColumn("skills", F.coalesce("skills", F.expr("cast(array() as array<struct<spos:int,name:string>>)")))


def upsert(baseline: DataFrame, incoming: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Baseline rows, all of them, and incoming rows whose keys neither the baseline nor an earlier incoming row has.

    Keys compare null to null as equal; text keys should be lower-cased by the caller.
    """
    both = baseline.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("_src", *order)
    return both.withColumn("_rank", F.row_number().over(w)).where("_src = 0 or _rank = 1").drop("_src", "_rank")


def fill_empty(baseline: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer merge: the baseline's text where it is not blank, else the incoming one, else empty."""
    b, i = baseline.alias("b"), incoming.alias("i")
    joined = b.join(i, F.col(f"b.{key}") == F.col(f"i.{key}"), "full")
    pick = [F.when(has_text(f"b.{f}"), F.col(f"b.{f}")).when(has_text(f"i.{f}"), F.col(f"i.{f}")).otherwise("").alias(f) for f in fields]
    return joined.select(F.coalesce(f"b.{key}", f"i.{key}").alias(key), *pick)


def whole_or_other(a: Column, b: Column) -> Column:
    """The first array unless it is empty."""
    return F.when(F.size(a) > 0, a).otherwise(b)


def links_matching(links: DataFrame, personal: DataFrame, how: str = "left_semi") -> DataFrame:
    """Links whose normal form is (not) one of the person's own URLs; personal is (cv_id, url)."""
    own = personal.select(F.col("cv_id").alias("p_cv"), normal_url("url").alias("p_url")).where("p_url != ''").distinct()
    match = (F.col("cv_id") == F.col("p_cv")) & (F.col("n_url") == F.col("p_url"))
    return links.withColumn("n_url", normal_url("url")).join(own, match, how).drop("n_url")


def links_not_exactly(links: DataFrame, personal: DataFrame) -> DataFrame:
    """Links that are none of the person's own URLs letter by letter, ignoring case."""
    # The collation compares letters in any case, so the keys need no copies in small letters.
    own = personal.where(has_text("url")).select(F.col("cv_id").alias("p_cv"), F.collate("url", CASELESS).alias("p_url")).distinct()
    return links.join(own, (F.col("cv_id") == F.col("p_cv")) & (F.collate("url", CASELESS) == F.col("p_url")), "left_anti")


def orphan_errors(errors: DataFrame, registered: DataFrame) -> DataFrame:
    """Errors whose target is blank or not registered; repeated errors stay."""
    return errors.join(registered.select(F.col("field_key").alias("r_key")).distinct(), F.col("target") == F.col("r_key"), "left_anti")


def first_invalid(ordered: DataFrame, invalid: DataFrame, key: str) -> DataFrame:
    """(key, field): the first ordered field that is invalid; the first invalid one where none is ordered."""
    hit = ordered.join(invalid.select(key, "field_key").distinct(), [key, "field_key"], "left_semi")
    hit = hit.groupBy(key).agg(F.min_by("field_key", "pos").alias("hit"))
    rest = invalid.groupBy(key).agg(F.min_by("field_key", "pos").alias("rest"))
    return rest.join(hit, key, "left").select(key, F.coalesce("hit", "rest").alias("field_key"))


def message_map(errors: DataFrame, key: str) -> DataFrame:
    """(key, target, messages): distinct messages of each target in first order, joined; blank targets and messages go."""
    first = errors.where(has_text("target") & has_text("message")).groupBy(key, "target", "message").agg(F.min("pos").alias("pos"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"]), "\n")
    return first.groupBy(key, "target").agg(joined.alias("messages"))


def layered(keys: DataFrame, base: DataFrame, theme: DataFrame, overlay: DataFrame) -> DataFrame:
    """(key, value): overlay over theme over base, the key itself where none has it; each layer is (key, value)."""
    out = keys
    for n, layer in enumerate((overlay, theme, base)):
        out = out.join(layer.select(F.col("key"), F.col("value").alias(f"v{n}")), "key", "left")
    return out.select("key", F.coalesce("v0", "v1", "v2", "key").alias("value"))


def dismissed_key(hint_id: Column, entry: Column, field: Column) -> Column:
    return F.concat_ws("|", hint_id, F.coalesce(entry.cast("string"), F.lit("")), F.coalesce(field, F.lit("")))


def split_names(full: Column) -> Column:
    """struct<first_name, last_name>: the first token and the rest."""
    t = trim_ws(F.regexp_replace(full, r"(?U)\s+", " "))
    return F.struct(F.split_part(t, F.lit(" "), F.lit(1)).alias("first_name"), F.when(t.contains(" "), F.regexp_replace(t, "^[^ ]* ", "")).otherwise("").alias("last_name"))
