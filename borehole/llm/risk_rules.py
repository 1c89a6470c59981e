"""Quality rules with cutoffs whose share of falsely rejected good documents is bounded.

Each document is measured over its whole text. Four rules compare a measure with a cutoff from a
fixed ladder, loosest first: the share of symbols, of words in repeated windows, of repeated lines,
and the mean word length outside a band. Labelled documents say, per stratum and cutoff, how many
good ones a cutoff would reject. A cutoff is certified if, with a true false-rejection share of
``alpha / 4``, so few would be rejected with a probability of at most ``delta / (4 * strata)``: the
exact binomial (Clopper-Pearson) bound, shared out over the rules of all labelled strata by
Bonferroni. A ladder's sets are nested, so its cutoffs are tested in order, at no further price,
and any certified one may be chosen. The one taken rejects the most labelled poor documents less the good ones
(ties: the loosest); where that is not above zero, the rule stays off. With probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents that pass the base rules.
This holds for labelled documents drawn independently; copies among them weaken it.

DataFrame functions only; nothing passes the driver. Measures are made row by row, and of the rest only counts per
stratum and cutoff are shuffled, with partial sums first, so a stratum may hold any share of the rows.

* A null or empty text has no words: all counts 0, ``base_failed``.
* Any text length: an array of one hash per word is held for the row being measured.
* Rows are judged one by one, so repeated rows come back as often as they are given, and an id with two texts gets
  two rows; its label then counts for both. Ids whose labels disagree count as unlabelled, as do null ids.
* A null stratum is a stratum of its own. A stratum without labels, or with too few good ones to certify
  anything, is left to the base rules.
* Empty tables give no rows; an empty label table leaves all rules off. Other columns are not read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borehole.session import materialise

SPACE = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Base rules: words at least, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Cutoffs in percent, loosest first; a document above one is rejected by it.
SYMBOL_SHARE = (50, 30, 20, 10, 5, 2, 1)
REPEATED_WORDS = (25, 20, 15, 10, 7, 5, 2)
REPEATED_LINES = (90, 70, 50, 40, 30, 20, 10)
#: Bands of the mean word length in hundredths, widest first; a document outside one is rejected by it.
WORD_LENGTH = ((200, 1400), (250, 1200), (300, 1000), (350, 900), (400, 800), (425, 700), (450, 650))
RULES = 4
ALPHA, DELTA = 0.1, 0.05


def _paired(source: str, step: int) -> Column:
    """Each element hashed together with the one ``step`` further on."""
    return F.transform(source, lambda x, i: F.xxhash64(x, F.get(source, i + step)))


def _with_equal_neighbour(rows: Column, field: str) -> Column:
    """Of sorted structs, those whose ``field`` another one has too."""

    def same(at: Column, x: Column) -> Column:
        return F.coalesce(F.get(rows, at)[field] == x[field], F.lit(False))

    return F.filter(rows, lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), x)) | same(i + 1, x))


def measures(docs: DataFrame, stratum: str | Column = "lang") -> DataFrame:
    """``doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed``.

    Words of 8-word windows that occur twice are found by hashes, and compared word by word where
    hashes agree. Only documents with such windows sort them.
    """
    text = F.coalesce("text", F.lit(""))
    of = F.col(stratum) if isinstance(stratum, str) else stratum
    trimmed = F.btrim("_text", F.lit(SPACE))
    plain = F.col("_text")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    df = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), of.cast("string")), F.lit("")).alias("stratum"), text.alias("_text"))
    df = df.select(
        "doc_id", "stratum", (F.length("_text") - F.length(plain)).alias("n_symbols"), lines.alias("_lines"),
        F.when(trimmed != "", F.split(trimmed, WORD_BREAK)).otherwise(F.array().cast("array<string>")).alias("_words"),
    )
    # each step keeps only what later ones need: arrays of whole texts are copied from step to step
    kept = ["doc_id", "stratum", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    df = df.select(
        "doc_id", "stratum", "n_symbols", F.size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).alias("word_chars"), F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), "_words",
        _paired("_words", 1).alias("_two"),
    )
    # a window's hash is built by doubling
    df = df.select(*kept, "_words", _paired("_two", 2).alias("_four"))
    df = df.select(*kept, "_words", _paired("_four", 4).alias("_eight"))
    windows = F.slice("_eight", 1, F.greatest(F.size("_eight") - (WINDOW - 1), F.lit(0)))
    df = df.select(*kept, "_words", windows.alias("_eight"))
    repeats = F.size(F.array_distinct("_eight")) < F.size("_eight")
    at = F.sequence(F.lit(0), F.size("_eight") - 1)
    df = df.select(*kept, F.when(repeats, F.col("_words")).alias("_words"), F.when(repeats, F.sort_array(
        F.zip_with("_eight", at, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )).alias("_sorted"))
    df = df.select(*kept, F.sort_array(F.transform(
        _with_equal_neighbour(F.col("_sorted"), "h"),
        lambda x: F.struct(F.concat_ws(" ", *[F.get("_words", x["i"] + k) for k in range(WINDOW)]).alias("g"), x["i"].alias("i")),
    )).alias("_like"))
    at = F.transform(_with_equal_neighbour(F.col("_like"), "g"), lambda x: x["i"])
    df = df.select(*kept, F.sort_array(at).alias("_at"))
    fresh = F.transform(
        "_at", lambda x, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get("_at", F.greatest(j - 1, F.lit(0)))))
    )
    covered = F.aggregate(fresh, F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    df = df.select("doc_id", "stratum", *[F.col(c).cast("long").alias(c) for c in counts])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _ladders() -> list[list[Column]]:
    """Per rule, whether each of its cutoffs rejects a document; later cutoffs reject more."""

    def above(part: str, whole: str, cutoffs: tuple[int, ...]) -> list[Column]:
        return [100 * F.col(part) > c * F.col(whole) for c in cutoffs]

    length = 100 * F.col("word_chars")
    return [
        above("n_symbols", "word_chars", SYMBOL_SHARE),
        above("n_repeat_words", "n_words", REPEATED_WORDS),
        above("n_dup_lines", "n_lines", REPEATED_LINES),
        [(length < a * F.col("n_words")) | (length > b * F.col("n_words")) for a, b in WORD_LENGTH],
    ]


def with_levels(measured: DataFrame) -> DataFrame:
    """``levels``: per rule, the number of the first (loosest) cutoff that rejects the row; null if none does."""
    first = [F.coalesce(*[F.when(test, F.lit(i)) for i, test in enumerate(ladder)]) for ladder in _ladders()]
    return measured.withColumn("levels", F.array(*first))


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(at most ``k`` of ``n``) at a true ``share``; 1 where k reaches the expected number.

    Summed in logarithms by the recurrence of the terms, so it neither underflows nor needs tables.
    """
    odds = log(share) - log(1 - share)

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        total = F.greatest(s["total"], term) + F.log1p(F.exp(-F.abs(s["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"))

    start = (n * F.lit(log(1 - share))).cast("double")
    none = F.struct(start.alias("term"), start.alias("total"))
    several = F.exp(F.aggregate(F.sequence(F.lit(1).cast("long"), k), none, step, lambda s: s["total"]))
    return F.when(k >= n * F.lit(share), F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(several)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, level, n_good, n_poor, good_rejected, poor_rejected, p_value`` of each rule that is on.

    ``measured`` comes from :func:`with_levels`; ``labels`` has ``doc_id, quality`` (1 good, 0 poor).
    """
    agreed = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"), F.max("quality").alias("_most"))
        .where("good = _most")
        .select("doc_id", "good")
    )
    known = measured.where(~F.col("base_failed")).join(agreed, "doc_id")
    steps = len(SYMBOL_SHARE)
    good, poor = F.col("good") == 1, F.col("good") == 0
    sums = [F.count_if(good).alias("n_good"), F.count_if(poor).alias("n_poor")]
    for rule in range(RULES):
        for i in range(steps):
            hit = F.coalesce(F.col("levels")[rule] <= i, F.lit(False))
            sums += [F.count_if(good & hit).alias(f"g{rule}_{i}"), F.count_if(poor & hit).alias(f"p{rule}_{i}")]
    counted = known.groupBy("stratum").agg(*sums)
    cells = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("level"), F.col(f"g{rule}_{i}").alias("good_rejected"), F.col(f"p{rule}_{i}").alias("poor_rejected"))
        for rule in range(RULES) for i in range(steps)
    ])
    strata = counted.where("n_good > 0").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    # one row, joined to one row per stratum
    tested = counted.where("n_good > 0").join(strata).select("stratum", "n_good", "n_poor", "strata", F.inline(cells))
    tested = tested.withColumn("p_value", binomial_tail(F.col("good_rejected"), F.col("n_good"), alpha / RULES))
    gain = F.col("poor_rejected") - F.col("good_rejected")
    certified = tested.where((F.col("p_value") <= F.lit(delta / RULES) / F.col("strata")) & (gain > 0))
    best = F.max_by(F.struct("level", "n_good", "n_poor", "good_rejected", "poor_rejected", "p_value"), F.struct(gain, -F.col("level")))
    return certified.groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", "b.*")


def judge(docs: DataFrame, labels: DataFrame, stratum: str | Column = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The measures of every document, ``levels``, the ``cutoff_levels`` of its stratum (by rule, null: off) and ``kept``."""
    measured = materialise(with_levels(measures(docs, stratum)), "measures")
    chosen = cutoffs(measured, labels, alpha, delta).groupBy("stratum")
    chosen = chosen.agg(*[F.max(F.when(F.col("rule") == r, F.col("level"))).alias(f"_{r}") for r in range(RULES)])
    chosen = chosen.select("stratum", F.array(*[f"_{r}" for r in range(RULES)]).alias("cutoff_levels"))
    # a row per stratum; written, so that the join is planned by its true size
    judged = measured.join(materialise(chosen, "cutoffs"), "stratum", "left")
    rejected = F.lit(False)
    for r in range(RULES):
        rejected = rejected | F.coalesce(F.col("levels")[r] <= F.col("cutoff_levels")[r], F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).select(*measured.columns, "cutoff_levels", "kept")
