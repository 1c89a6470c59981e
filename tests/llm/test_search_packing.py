"""Vector searches and packing against brute force, and the pipeline's contract."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from borehole.llm import hamming, kmeans_tree, packing

SF = "/root/testdata/sf0.001"


def awkward_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=24)], "x") for i in range(300)]
    rows += [(1000 + i, rows[7][1], "x") for i in range(100)]
    rows += [(2000, None, "x"), (2020, [0.0] * 24, "x"), (2040, [float("nan")] * 24, "x"), (2060, [None] * 24, "x"),
             (2080, [1.0], "x"), (None, [1.0] * 24, "x"), (20, rows[20][1], "x")]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(awkward_vectors(), "vec_id long, embedding array<double>, code string").repartition(4)


def expected(nearness, k=20):
    good = {i: np.array(v) for i, v, _ in awkward_vectors() if i is not None and (i < 2000)}
    ids = np.array(sorted(good))
    table = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        d = nearness(table, good[q])
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


def test_hamming_is_exact(vectors):
    got = {}
    for r in hamming.nearest_by_sign(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    assert got == expected(lambda t, q: ((t > 0) != (q > 0)).sum(axis=1))
    assert hamming.nearest_by_sign(vectors.where("vec_id = 20")).count() == 0
    assert hamming.nearest_by_sign(vectors.where("false")).count() == 0


@pytest.mark.parametrize(("rows", "wide", "values"), [(1, 8, 256), (30, 3, 256), (900, 8, 256), (900, 8, 2), (300, 1, 256), (50, 13, 20)])
def test_block_search_in_slices(monkeypatch, rows, wide, values):
    """Slices of few pairs, copies of codes, queries inside and outside of the block, fewer ids than k."""
    monkeypatch.setattr(hamming, "PAIRS", 5000)
    rng = np.random.default_rng(rows)
    ids = rng.permutation(2 * rows)[:rows].astype(np.int64)
    codes = rng.integers(0, values, (rows, wide)).astype(np.uint8)
    codes[rows // 2 :] = codes[: rows - rows // 2]
    asked = np.concatenate([ids[:20], np.arange(10**6, 10**6 + 20)])
    queries = np.concatenate([codes[:20], rng.integers(0, 256, (20, wide)).astype(np.uint8)])
    want = []
    for i, q in zip(asked.tolist(), queries, strict=True):
        d, other = np.bitwise_count(codes ^ q).sum(axis=1, dtype=np.int64), ids != i
        order = np.lexsort((ids[other], d[other]))[:20]
        want += [(i, *x) for x in zip(ids[other][order].tolist(), d[other][order].tolist(), strict=True)]
    got = hamming.search_block(ids, codes, asked, queries, 20)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_tree_recall(vectors, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 16)
    want = expected(lambda t, q: -(t * q).sum(axis=1))
    rows = kmeans_tree.nearest_vectors(vectors).collect()
    score = {i: dict((v, -s) for v, s in expected(lambda t, q: -(t * q).sum(axis=1), 10**6)[i]) for i in want}
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in rows)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(r.score == score[r.query_id][r.vec_id] for r in rows)
    assert kmeans_tree.nearest_vectors(vectors.where("false")).count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 9), replace=False))
        counts = rng.integers(1, 20, len(lengths))
        for k in (1, 2, 3):
            ends = packing.boundaries(lengths, counts, k)

            def cost(ends):
                at = np.searchsorted(ends, lengths)
                return int((counts * np.array(ends)[at]).sum())

            best = min(
                cost([*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1].tolist(), n)
            )
            assert ends[-1] == lengths[-1] and len(ends) <= k and cost(ends) == best


def test_long_lengths_are_near_the_optimum(spark):
    """Above the exact cells the padded size is at most 65/64 of the least one."""
    lengths = np.random.default_rng(2).integers(2049, 9000, 400)
    docs = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, n long")
    got = sum(r.bucket_tokens for r in packing.pack(docs, buckets=5, length_col="n").collect())
    exact, counts = np.unique(lengths, return_counts=True)
    ends = np.array(packing.boundaries(exact, counts, 5))
    best = int((counts * ends[np.searchsorted(ends, exact)]).sum())
    assert best <= got <= best * 65 / 64


def test_batches_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 10)
    rows = [(i, "w " * (i % 37)) for i in range(200)] + [(500, None), (501, "w " * 5000), (None, "w"), (3, "w w w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, budget=128, buckets=4).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens
        batches.setdefault(r.batch, []).append(r)
    for own in batches.values():
        assert len(own) == 1 or sum(r.bucket_tokens for r in own) <= 128
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert packing.pack(docs.where("false")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == columns, name
        path = f"{corpus_pipeline.materialise(after, name).inputFiles()[0].rsplit('/', 1)[0]}"
        left, before = spark.read.parquet(path), left
        assert left.count() <= before.count()
        assert left.join(before, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == left.count()


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34"), (10**6 + 1, None)], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    kept = corpus_pipeline.language(spark, both, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_leaves_of_a_bin_are_scored_together(monkeypatch):
    """Each query's best in its leaves by brute force, with copies, ties and more than one block of queries."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (400, 3)).astype(float)
    ids, leaf = rng.permutation(400), rng.integers(0, 9, 400)
    query_ids, queries = np.arange(0, 400, 2), rng.integers(-2, 3, (200, 3)).astype(float)
    pairs = np.array([(q, one) for q in range(200) for one in range(12) if (q * 7 + one * 5) % 4 == 0 and q != 9])
    picked = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: picked.append(1) or partition(*a, **k))
    got = kmeans_tree.best_of(ids, vectors, query_ids, queries, 5, leaf, (pairs[:, 0], pairs[:, 1]))
    assert len(picked) == 2
    want = []
    for q in range(200):
        seen = np.isin(leaf, pairs[pairs[:, 0] == q, 1]) & (ids != query_ids[q])
        scores = vectors[seen] @ queries[q]
        best = np.lexsort((ids[seen], -scores))[:5]
        want += [(int(query_ids[q]), int(i), float(s)) for i, s in zip(ids[seen][best], scores[best], strict=True)]
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want
