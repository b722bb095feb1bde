"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, mixture.

Each stage reads all rows its predecessor kept and returns the columns of documents; the last returns the mixture:
documents' columns with size, source_size, target and taken. Stages take (spark, docs, sf_dir). Rows without a text
pass every filter but that for near-duplicates, where they share a fingerprint with wordless texts; rows without a doc_id
pass them all, since they take no part in linking. Texts of any length are read whole. Columns beside those of documents
are dropped. An empty table stays empty. Texts are not shuffled where the ids that go can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, mixing, pii, simhash, toxicity
from dossier.llm.common import small, stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half go on; null and empty texts score as texts without a match, equal rows alike."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), grammar).where("toxicity_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id goes on, once; rows without a doc_id go on.

    Of rows that repeat that doc_id the one with the least of the other columns goes on. Null and wordless texts are one class.
    """
    docs = docs.select(*COLUMNS)
    classes = stash(simhash.near_duplicates(docs).select("doc_id", "component_id"), "pipeline-classes")
    # A doc_id that rows repeat has one class, so all of its rows go or one of them stays.
    gone = small(stash(classes.where("doc_id != component_id").select("doc_id").distinct(), "pipeline-gone"))
    twice = small(stash(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated"))
    left = docs.join(gone, "doc_id", "left_anti")
    row = F.min(F.struct(*(c for c in COLUMNS if c != "doc_id"))).alias("row")
    several = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("doc_id", "row.*")
    return left.join(twice, "doc_id", "left_anti").unionByName(several).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks go on; null, empty and wordless texts hold none, equal rows alike."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents go on, with personal data masked and n_chars following the text; null texts stay null."""
    return pii.sanitise(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the mixture takes of each."""
    return mixing.mix(docs, keep=("text", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
]

#: SQL cannot express a learned score, a transitive closure over fingerprints or string tiling; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread before the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stash(docs, f"pipeline-{name}")
    return docs
