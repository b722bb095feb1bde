"""The registered queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, edit_embedding, embeddings, html_extract, licenses, mixing, periodic, pii, simhash, suffix_dedup, toxicity, warc
from .common import stash_dir, table
from .oracles import ORACLE_SQL


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that leaks into it."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under SimHash links of two bits at most."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents at the target weights takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", "text"), grammar)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.learn(pages))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences whose wording every document holds."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads them back."""
    folder = f"{stash_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, folder).drop("html", "url")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier document holds."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), return_kept=False).drop("kept", "spans")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors at a cosine of 0.95 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired rows of every conversation after damage."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its version edited with the next one."""
    return edit_embedding.fingerprints(table(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words after one in ten was made periodic."""
    return periodic.report(periodic.find(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_mix": op3_mix,
    "op4_toxicity": op4_toxicity,
    "op5_html": op5_html,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_warc": op8_warc,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_embeddings": op10_embeddings,
    "op11_conversations": op11_conversations,
    "op12_edit_embedding": op12_edit_embedding,
    "op13_periodic": op13_periodic,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
