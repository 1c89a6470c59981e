"""A corpus pipeline of five stages over ``documents``; each works on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borehole.llm.language import UNKNOWN, identify
from borehole.llm.line_templates import drop_recurring_lines
from borehole.llm.near_dedup import near_duplicates
from borehole.llm.packing import pack
from borehole.llm.phrase_automata import remove_repeated_phrases
from borehole.session import materialise

#: Shorter texts may be ambiguous without being unclean.
JUDGED_CHARS = 50

#: A line's template, shingle hashes and trained codes have no counterpart in SQL.
ORACLE_SQL = None


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``changed(doc_id, text)``; other columns stay."""
    new = changed.select("doc_id", F.col("text").alias("_new")).dropDuplicates(["doc_id"])
    joined = docs.join(new, "doc_id", "left")
    text = F.coalesce("_new", "text")
    columns = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text).cast("long"))}
    return joined.select(
        *[F.when(F.col("_new").isNotNull(), columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
          for c in docs.columns]
    )


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and long ones that are like no language."""
    found = identify(docs)
    unclear = docs.select("doc_id", "text").where(F.length("text") >= JUDGED_CHARS).select("doc_id")
    unknown = found.where(F.col("lang_pred") == UNKNOWN).select("doc_id")
    ambiguous = found.where(F.col("ambiguous") & (F.col("lang_pred") != UNKNOWN)).select("doc_id")
    rejected = materialise(unknown.union(ambiguous.join(unclear, "doc_id", "left_semi")), "rejected")
    return docs.join(rejected, "doc_id", "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that had nothing else goes with them."""
    found = drop_recurring_lines(docs).where("n_dropped > 0")
    changed = _with_text(docs, found).select(*docs.columns)
    return changed.where("text is null or length(trim(both ' \t\n\r' from text)) > 0")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    copies = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti")


def phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of an earlier document go; a document that had nothing else goes with them."""
    found = remove_repeated_phrases(docs).where("n_removed > 0")
    return _with_text(docs, found).where("text is null or text <> ''")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of a token budget inside length buckets of least padding."""
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("phrases", phrases), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
