"""Line dedup by a fixed-depth tree of log templates, in DataFrame functions only.

A line's tokens are its trimmed text cut at white space; a token with a digit is a variable field
and becomes ``<*>``. The tree's first level is the number of tokens, the next ``DEPTH`` levels the
leading tokens. Below, a line has a template of all its tokens and, from ``2 * CONSTANT`` tokens
on, two that generalise one half of the line to variable fields and hold the other half constant
(so at least half of the tokens agree). A template recurs if at least ``MIN_DOCS`` documents have
a line of it. A line goes if one of its templates recurs and also occurs in a document with a
smaller id, so the first document keeps its lines.

Empty lines are never dropped. Null texts stay null, empty texts empty. Repeated lines within one
document aren't copies. Rows that repeat an id must repeat its text. Rows without an id keep all
lines. Extra columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.session import materialise

DEPTH = 2
CONSTANT = 4
MIN_DOCS = 3
FIELD = "<*>"
WHITE = " \t\n\x0b\f\r"


def line_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, template``: 64-bit hashes of the templates of all lines that aren't blank.

    Every step is a projection of its own, so that no line is cut twice.
    """
    lines = docs.where("doc_id is not null").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    lines = lines.select("doc_id", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).where("line <> ''")
    fields = F.regexp_replace("line", r"\S*[0-9]\S*", FIELD)
    lines = lines.select("doc_id", "pos", F.when(F.col("line").rlike("[0-9]"), fields).otherwise(F.col("line")).alias("line"))
    lines = lines.select("doc_id", "pos", F.split("line", r"\s+").alias("tokens"))
    n = F.size("tokens")
    half = F.ceil(n / F.lit(2)).cast("int")
    whole = F.xxhash64(F.lit("line"), n, "tokens")
    head = F.xxhash64(F.lit("head"), n, F.slice("tokens", F.lit(1), half))
    tail = F.xxhash64(F.lit("tail"), n, F.slice("tokens", 1, DEPTH), F.slice("tokens", half + 1, n - half))
    keys = F.when(n >= 2 * CONSTANT, F.array(whole, head, tail)).otherwise(F.array(whole))
    return lines.select("doc_id", "pos", F.explode(keys).alias("template"))


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every document without its recurring lines."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = materialise(line_keys(texts), "templates")
    found = (
        keys.select("template", "doc_id").distinct().groupBy("template")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    )
    gone = (
        keys.join(found, "template").where("first < doc_id")
        .groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    )
    rows = texts.join(gone, "doc_id", "left").select(
        "doc_id", "text", "gone", F.split("text", "\n").alias("lines")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    lines = F.col("lines")
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped_raw"),
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
        .alias("text"),
    ).select("doc_id", "n_lines", F.greatest("n_dropped_raw", F.lit(0)).cast("long").alias("n_dropped"), "text")
