"""One-bit codes, risk-controlled rules and whitening against brute force, with awkward rows."""

import re
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from borehole.llm import bit_codes, risk_rules, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, x string, code int, part int, n string"
TEXTS = "doc_id long, text string, lang string, n_words string, levels string, good string, stratum string"


def awkward_vectors(dims=12):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=dims).round(2).tolist(), int(i % 4)) for i in range(260)]
    rows += [(1000 + i, rows[7][1], 3) for i in range(90)]  # copies: ties by id
    rows += [(1100 + i, rows[7][1], 1) for i in range(30)]
    rows += [rows[50], rows[50], (100, rows[3][1], 2)]  # repeated rows, and an id with two vectors
    rows += [(2000, None, 1), (2050, [NAN] * dims, 1), (2100, [INF] + [0.0] * (dims - 1), 1), (2150, [None] * dims, 2),
             (2200, [], 1), (2250, [1.0] * dims, None), (None, [1.0] * dims, 1), (2300, [0.0] * dims, 2)]
    return [(i, v, y, "a", 1, 2, "b") for i, v, y in rows]


def whole(rows, dims=12, labelled=True):
    """The rows that take part, as id, whole-number vector, label."""
    out = []
    for i, v, y, *_ in rows:
        if v and len(v) == dims and all(c is not None and np.isfinite(c) for c in v) and not (labelled and (y is None or i is None)):
            out.append((i, tuple(int(np.floor(256 * c)) for c in v), y))
    return out


def mined(rows, least=50, most=95):
    rows = sorted(set(whole(rows)))
    ids, x, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    out = []
    for a in np.flatnonzero(ids % 50 == 0):
        score = x @ x[a]

        def best(keep, k, score=score):
            at = np.flatnonzero(keep)
            return at[np.lexsort((ids[at], -score[at]))[:k]]

        for p in best((labels == labels[a]) & (ids != ids[a]), 5):
            fits = (labels != labels[a]) & (ids != ids[a]) & (least * score[p] <= 100 * score) & (100 * score <= most * score[p])
            out += [(ids[a], ids[p], r + 1, ids[n], score[p], score[n]) for r, n in enumerate(best(fits, 3))]
    return sorted(tuple(map(int, o)) for o in out)


@pytest.mark.parametrize(("least_rows", "ask"), [(1024, 2048), (16, 2)])
def test_hard_negatives_are_exact(spark, monkeypatch, least_rows, ask):
    monkeypatch.setattr(bit_codes, "LEAST_ROWS", least_rows)
    monkeypatch.setattr(bit_codes, "ASK", ask)
    df = spark.createDataFrame(awkward_vectors(), VECTORS).repartition(3)
    got = sorted(map(tuple, bit_codes.hard_negatives(df).collect()))
    assert got == mined(awkward_vectors())
    assert any(o[0] == 100 for o in got) and any(o[1] >= 1000 for o in got)


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame(awkward_vectors(), VECTORS)
    assert bit_codes.hard_negatives(df.where("false")).count() == 0
    assert bit_codes.hard_negatives(df.where("vec_id % 50 <> 0")).count() == 0
    assert bit_codes.hard_negatives(df.where("vec_id = 50")).count() == 0
    with pytest.raises(ValueError, match="from 3 to 12"):
        bit_codes.hard_negatives(df.union(spark.createDataFrame([(9, [1.0] * 3, 1, "", 0, 0, "")], VECTORS)))


@pytest.mark.parametrize("dims", [1, 7, 64, 130])
def test_intervals_hold_every_score(dims):
    rng = np.random.default_rng(dims)
    x = rng.integers(-300, 300, (400, dims))
    x[:3] = 0
    queries = np.r_[x[::50], rng.integers(-300, 300, (5, dims)), np.zeros((1, dims), int)]
    turn = bit_codes.rotation(dims)
    low, high = bit_codes.intervals(bit_codes.encode(x.astype(float), turn), queries.astype(float), turn)
    score = queries @ x.T
    assert (low <= score).all() and (score <= high).all()
    if dims > 1:
        assert (high - low).mean() < np.abs(queries).max() * np.abs(x).max() * dims  # and they tell rows apart


def test_bounds_save_scoring():
    """With clusters the search ends long before all rows are scored."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32)) * 100
    x = np.rint(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 32)) * 8).astype(np.int64)
    turn = bit_codes.rotation(32)
    low, high = bit_codes.intervals(bit_codes.encode(x.astype(float), turn), x[:1].astype(float), turn)
    found, scored = bit_codes.best_in_ranges(x, np.arange(4000), x[0], low[0], high[0], [(-(1 << 62), 1 << 62)], 5)
    assert scored < 1500
    score = x @ x[0]
    assert found[0][1].tolist() == np.lexsort((np.arange(4000), -score))[:5].tolist()


def test_large_products():
    big = np.array([[1 << 40, -(1 << 40)]])
    with pytest.raises(OverflowError):
        bit_codes.products(big, big[0])
    assert bit_codes.products(np.array([[1 << 30, 3]]), np.array([1 << 30, 5])).tolist() == [(1 << 60) + 15]


# --- rules ------------------------------------------------------------------------------


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered), failed


def awkward_texts():
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    return [
        None, "", " \n\t\x0b ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 50, "é ü 漢字\n" * 30,
        "a b\n\na b\n a b\na b", "# * $ % & | < > ok", long_, long_ + " " + " ".join(long_.split()[:9]), "w\r\nw\r\n",
        " ".join(f"v{i}" for i in range(40)) + "\n" + " ".join(f"v{i}" for i in range(12)), "\U0001f600 \U0001f600",
    ]


def test_measures_by_brute_force(spark):
    rows = [(i, t, "en", "", "", "", "") for i, t in enumerate(awkward_texts())] + [(5, "other", None, "", "", "", "")] * 2
    out = risk_rules.measures(spark.createDataFrame(rows, TEXTS)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((r.doc_id, r.stratum, *(r[c] for c in columns)) for r in out)
    assert got == sorted((r[0], "=en" if r[2] else "", *measured(r[1])) for r in rows)


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, a) for n in (1, 40, 700) for a in (0.025, 0.3) for k in (0, 1, 2, 5, 17, 200) if k <= n]
    cases += [(500, 40_000, 0.025)]
    for share in (0.025, 0.3):
        df = spark.createDataFrame([c for c in cases if c[2] == share], "k long, n long, a double")
        for r in df.select("k", "n", risk_rules.binomial_tail(F.col("k"), F.col("n"), share).alias("p")).collect():
            if r.k >= r.n * share:
                assert r.p == 1.0
            elif r.n < 1000:
                want = sum(comb(r.n, i) * share**i * (1 - share) ** (r.n - i) for i in range(r.k + 1))
                assert r.p == pytest.approx(want, rel=1e-9)
            else:
                assert 0 < r.p < 1e-40


def labelled(n=900):
    """Long documents of two languages; poor ones are full of symbols, a few good ones have some."""
    rows, labels = [], []
    for i in range(n):
        poor = i % 5 == 0
        tail = " $$$$" * 12 if poor else " #" * 3 if i % 90 == 1 else ""
        rows.append((i, " ".join(f"word{(i * 7 + k * k) % 5000}{k}" for k in range(40)) + tail, "a" if i % 10 else None))
        labels.append((i, int(not poor)))
    return rows, labels


def cutoffs_by_hand(rows, labels, alpha, delta):
    known = {}
    for i, q in labels:
        known.setdefault(i, set()).add(q)
    by = {}
    for i, text, lang in rows:
        m = measured(text)
        if i in known and len(known[i]) == 1 and not m[6]:
            by.setdefault(lang, []).append((m, *known[i]))
    by = {lang: docs for lang, docs in by.items() if any(q for _, q in docs)}
    ladders = [
        [lambda m, c=c: 100 * m[2] > c * m[1] for c in risk_rules.SYMBOL_SHARE],
        [lambda m, c=c: 100 * m[5] > c * m[0] for c in risk_rules.REPEATED_WORDS],
        [lambda m, c=c: 100 * m[4] > c * m[3] for c in risk_rules.REPEATED_LINES],
        [lambda m, a=a, b=b: not a * m[0] <= 100 * m[1] <= b * m[0] for a, b in risk_rules.WORD_LENGTH],
    ]
    out, share = {}, alpha / 4
    for lang, docs in by.items():
        n = sum(q for _, q in docs)
        for r, ladder in enumerate(ladders):
            best = (0, None)
            for level, test in enumerate(ladder):
                good, poor = (sum(test(m) for m, q in docs if q == want) for want in (1, 0))
                tail = sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(good + 1))
                if tail <= delta / 4 / len(by) and poor - good > best[0]:
                    best = (poor - good, level)
            if best[1] is not None:
                out[lang, r] = ladder[best[1]]
    return out


def test_kept_by_brute_force(spark):
    rows, labels = labelled()
    labels += [(7, 0), (14, None), (None, 1), (11, 1)]  # disagreeing, missing and repeated labels
    rows += [(i, t, "a") for i, t in enumerate(awkward_texts(), 5000)] + [(None, rows[5][1], "a"), (6000, rows[5][1], "never seen")]
    rows += [rows[5], (8, "short", "a")]
    docs = spark.createDataFrame([(*r, "", "", "", "") for r in rows], TEXTS)
    got = risk_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    chosen = cutoffs_by_hand(rows, labels, risk_rules.ALPHA, risk_rules.DELTA)
    assert ("a", 0) in chosen
    want = []
    for i, text, lang in rows:
        m = measured(text)
        want.append((i, m[0], not m[6] and not any(test(m) for (s, _), test in chosen.items() if s == lang)))
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=repr) == sorted(want, key=repr)
    by_id = {r.doc_id: r.kept for r in got}
    assert not by_id[5] and by_id[6000]  # only a labelled stratum has cutoffs


def test_rules_stay_off_without_proof(spark):
    rows, labels = labelled(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = spark.createDataFrame(labels, "doc_id long, quality int")
    for known in (few, few.where("false")):
        assert risk_rules.judge(docs, known).where("not kept").count() == 0
    assert risk_rules.judge(docs.where("false"), few).count() == 0


# --- whitening --------------------------------------------------------------------------


def check_whitening(df, rows, dims, components=4):
    out = whitening.whiten(df, components).collect()
    used = whole(rows, dims, labelled=False)
    fit = np.array(sorted({x for _, x, _ in used}), float)
    n, sums = len(fit), [sum(int(v) for v in c) for c in fit.T]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(dims, dims))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(out) == len(used) * k and {r.component for r in out} == set(range(1, k + 1))
    assert {r.n for r in out} == {n}
    want = sorted((str(i), sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))) for i, x, _ in used)
    assert sorted((str(r.vec_id), int(r.deviation)) for r in out if r.component == 1) == want
    assert {round(r.explained / (values[r.component - 1] / values.sum()), 9) for r in out} == {1.0}
    assert max(r.identity_error for r in out) < 1e-9
    by = {i: np.array(x, float) for i, x, _ in used}
    for j in range(k):
        pairs = [(r.whitened, (by[r.vec_id] - fit.mean(axis=0)) @ vectors[:, j] / np.sqrt(values[j])) for r in out if r.component == j + 1]
        got, want = (np.array(c) for c in zip(*pairs, strict=True))
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
    return out


def test_whitening_of_awkward_rows(spark):
    rows = [r for r in awkward_vectors() if r[0] != 100]  # ids of one vector, to look them up
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    out = check_whitening(df, rows, 12)
    assert any(r.vec_id is None for r in out)


@pytest.mark.parametrize(("dims", "rank"), [(40, 40), (40, 2), (3, 3), (1, 1)])
def test_whitening_of_any_rank(spark, dims, rank):
    rng = np.random.default_rng(dims + rank)
    made = rng.integers(-8, 9, (150, rank)) @ rng.integers(-3, 4, (rank, dims))
    rows = [(i, [float(c) for c in v], 0, "", 0, 0, "") for i, v in enumerate(made)]
    check_whitening(spark.createDataFrame(rows, VECTORS), rows, dims)


def test_whitening_filters_a_close_spectrum(spark):
    """Eigenvalues a percent apart: the block alone would not do, the filter must."""
    rng = np.random.default_rng(9)
    scale = 1.01 ** -np.arange(60.0)
    rows = [(i, (v * scale).tolist(), 0, "", 0, 0, "") for i, v in enumerate(rng.normal(size=(3000, 60)))]
    df = spark.createDataFrame(rows, VECTORS)
    check_whitening(df, rows, 60)
    fit = whitening.integer_rows(df, "vec_id", "embedding").select("x")
    assert whitening.leading_components(fit, 60, 4, guard=6).passes > 8


def test_whitening_of_tied_eigenvalues(spark):
    rows = [(2 * i + s, [float(1 - 2 * s) if j == i else 0.0 for j in range(30)], 0, "", 0, 0, "") for i in range(30) for s in (0, 1)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) == 240 and max(r.identity_error for r in out) < 1e-9
    assert {round(r.explained, 9) for r in out} == {round(1 / 30, 9)}


def test_whitening_without_variance(spark):
    df = spark.createDataFrame(awkward_vectors(), VECTORS)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 50")).count() == 0
    with pytest.raises(ValueError, match="from 3 to 12"):
        whitening.whiten(df.union(spark.createDataFrame([(9, [1.0] * 3, 1, "", 0, 0, "")], VECTORS)))


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 33, -5], [0, 7]])
    got = whitening._deviations(x, 3, [1 << 33, 2]).to_pylist()
    assert [int(v) for v in got] == [(3 * (1 << 33) - (1 << 33)) ** 2 + 17**2, (1 << 66) + 19**2]
