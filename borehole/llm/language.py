"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; each bit is a binary classifier of hashed byte trigrams that tells
the languages with that bit set from the others. Up to seven languages get the exhaustive code
(every split of the languages into two parts), more get the best of many random codes by smallest
distance. Training is one pass of counts over all labelled rows, summed by Spark: the weight of a
trigram in a bit is its smoothed log odds. Decoding is loss-weighted: a codeword's distance is the
logistic loss of the bits' margins, weighted by how well each bit separates that language in
training, and the nearest codeword wins. ``ambiguous`` marks predictions whose score, the softmax
of the negated distances, is below ``CLEAR``.

Null, empty and letterless texts are ``und`` with score 0. Without labelled rows all are ``und``.
Equal distances go to the alphabetically first language. The model's size depends on the number
of languages alone (65,536 counts each).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borehole.llm.hashing import chunks
from borehole.session import ship_package

CELLS = 1 << 16
EXHAUSTIVE = 7
#: Trigrams beyond this many add no more evidence: longer texts count as if they had so many.
EVIDENCE = 100
SMOOTHING = 0.5
CLEAR = 0.6
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def codewords(n: int) -> np.ndarray:
    """``n`` rows of +1 and -1."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, far = np.random.default_rng(20260103), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int(apart[~np.eye(n, dtype=bool)].min())
        if least > far:
            best, far = code, least
    return best


def trigrams(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all trigrams of a chunk, and each document's first trigram and number of them."""
    b = chunk.data.astype(np.uint32)
    cells = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return cells, chunk.bounds[:-1], np.maximum(np.diff(chunk.bounds) - 2, 0)


def _padded(texts: pa.Array) -> pa.Array:
    """Lower-cased, with a space at both ends, so that every text has a trigram."""
    return pc.binary_join_element_wise(" ", pc.utf8_lower(texts.fill_null("")), " ", "")


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        padded = pa.RecordBatch.from_arrays([pa.array(range(len(langs))), _padded(batch.column(1))], names=["i", "t"])
        for chunk in chunks([padded]):
            cells, first, n = trigrams(chunk)
            names, index = np.unique([langs[i] for i in chunk.ids], return_inverse=True)
            own = np.repeat(index, np.diff(chunk.bounds))[: len(cells)]
            inside = np.ones(len(cells), bool)
            ends = chunk.bounds[1:-1]
            inside[ends - 1] = inside[ends - 2] = False
            found = np.bincount((own * CELLS + cells)[inside], minlength=len(names) * CELLS).reshape(-1, CELLS)
            for name, row in zip(names.tolist(), found, strict=True):
                total[name] = total.get(name, 0) + row
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))],
            names=["lang", "cell", "n"],
        )


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from all rows with a language; the driver gets the summed counts only."""
    ship_package(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counts, "lang string, cell int, n long")
    table = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    return from_counts(*(table.column(x).to_numpy() for x in ("lang", "cell", "n")))


def from_counts(lang: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Model:
    names, index = np.unique(lang.astype(str), return_inverse=True) if len(lang) else (np.array([], str), None)
    counts = np.zeros((len(names), CELLS))
    if len(names):
        np.add.at(counts, (index, cell), n)
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * CELLS)
    code = codewords(len(names))
    weights = np.zeros((CELLS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        up = code[:, b] > 0
        weights[:, b] = np.log(share[up].mean(axis=0)) - np.log(share[~up].mean(axis=0))
    trust = np.maximum(share @ weights * code, 1e-6) if code.shape[1] else np.ones(code.shape)
    return Model(names.tolist(), code, weights, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-12))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row of margins, and its score."""
    if len(model.languages) == 1:
        return np.zeros(len(margins), int), np.ones(len(margins))
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None])
    distance = (loss * model.trust[None]).sum(axis=2)
    best = distance.argmin(axis=1)
    score = 1 / np.exp(distance[np.arange(len(best)), best][:, None] - distance).sum(axis=1)
    return best, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row, from the text alone."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(1)
            letters = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            padded = pa.RecordBatch.from_arrays([batch.column(0), _padded(texts)], names=["i", "t"])
            for chunk in chunks([padded]):
                ok = letters[chunk.rows] & (len(m.languages) > 0)
                best = np.full(len(chunk.ids), len(m.languages))
                score = np.zeros(len(chunk.ids))
                if ok.any():
                    cells, first, n = trigrams(chunk)
                    margins = np.zeros((len(chunk.ids), m.code.shape[1]))
                    at = np.flatnonzero(n > 0)
                    pieces = np.empty(2 * len(at), np.int64)
                    pieces[::2], pieces[1::2] = first[at], first[at] + n[at]
                    pieces = np.minimum(pieces, len(cells) - 1) if len(cells) else pieces
                    for b in range(m.code.shape[1]):
                        sums = np.add.reduceat(m.weights[cells, b], pieces, dtype=np.float64)[::2]
                        if first[at[-1]] + n[at[-1]] >= len(cells):
                            sums[-1] = m.weights[cells[first[at[-1]] :], b].sum(dtype=np.float64)
                        margins[at, b] = sums / n[at] * np.minimum(n[at], EVIDENCE)
                    b, s = decode(m, margins)
                    best[ok], score[ok] = b[ok], s[ok]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows)), pa.array(names[best], pa.string()),
                     pa.array(score), pa.array(score < CLEAR)],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows not held out, predict all: ``doc_id, held_out, lang_pred, score, ambiguous``."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out())
