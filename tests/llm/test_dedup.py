"""Near-duplicate, substring and line dedup against brute force on small awkward tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from borehole.llm import near_dedup, phrase_automata, recurrence, suffix_parse
from borehole.llm.components import connected_components
from borehole.llm.hashing import Chunk
from borehole.llm.line_templates import drop_recurring_lines

SCHEMA = "doc_id long, text string, band long, leader string, marks int"


def awkward() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["été", "Ünit", "THE", "the"]

    def prose(n: int) -> list[str]:
        return [rng.choice(vocab) for _ in range(n)]

    shared = prose(60)
    base = prose(120)
    docs: list[str | None] = [None, "", " \t\n", "one", "one two three", "one two three", "a " * 400, "a " * 900]
    docs += [" ".join(prose(80)) for _ in range(15)]
    docs += [" ".join(prose(20) + shared[10:50] + prose(20)) for _ in range(12)]
    docs += [" ".join(base)] * 6
    for _ in range(25):  # a chain of near copies
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = rng.choice(vocab)
        docs.append("\n".join([" ".join(base[:60]), " ".join(base[60:])]))
    docs.append(" ".join(prose(6000)))
    docs.append("  ".join(shared).upper())
    docs.append("x" * 5000 + "é" * 60)
    docs.append("y" + "é" * 60 + "x" * 200)
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i * 3, docs[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", 2) for i, t in awkward()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates_are_exact(docs):
    rows = awkward()
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_bayes_limits_keep_links():
    least = near_dedup.least_matches()
    assert list(least) == sorted(least) and 0 < least[0] < 24 and 60 < least[-1] < 96


def test_buckets_of_many_components(spark, monkeypatch):
    """Members of one bucket whose smallest document links with none of them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    common = [f"c{i}" for i in range(100)]
    rows = [(0, " ".join(common + [f"z{i}" for i in range(60)]))]
    for k in range(4):
        own = common + [f"k{k}x{i}" for i in range(30)]
        rows += [(10 * k + j + 1, " ".join([*own, f"e{j}"])) for j in range(3)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0
    for k in range(4):
        assert {got[10 * k + j + 1] for j in range(3)} == {10 * k + 1}


def hot_source() -> list[tuple[int, set[int]]]:
    """Pages of one source with 60 and 83 percent in common, and near copies of some of them."""
    rng = np.random.default_rng(4)
    common = rng.integers(1, 2**63, 500, dtype=np.int64).tolist()
    sets = [{*common[: 60 if i % 2 else 83], *rng.integers(1, 2**63, 40 if i % 2 else 17, dtype=np.int64).tolist()} for i in range(80)]
    sets += [{*sorted(s)[k % 5 :], *range(k % 9)} for k, s in enumerate(sets[:30])]
    return [(7 * i % 113, s) for i, s in enumerate(sets)]


def test_prefixes_keep_links_and_part_a_hot_source():
    sets = [np.array(sorted(s), np.uint64) for _, s in hot_source()]
    counts = np.zeros(1 << near_dedup.CELL_BITS, np.int64)
    for s in sets:
        np.add.at(counts, near_dedup._cell(s), 1)
    made = [near_dedup.prefix(s, counts) for s in sets]
    met = links = 0
    for x, (long, n) in enumerate(made):
        for y, (other, m) in enumerate(made[:x]):
            meet = bool({*long[:n].tolist()} & {*other.tolist()} or {*long.tolist()} & {*other[:m].tolist()})
            link = near_dedup.linked(sets[x], sets[y])
            assert meet or not link
            met, links = met + meet, links + link
    assert links > 20 and met < 3 * links


def test_block_pairs_keep_links_across_batches():
    """Position and size filters lose no link, wherever the batches are cut."""
    sets = [np.array(sorted(s), np.uint64) for _, s in hot_source()]
    counts = np.zeros(1 << near_dedup.CELL_BITS, np.int64)
    for s in sets:
        np.add.at(counts, near_dedup._cell(s), 1)
    rows = []
    for i, s in enumerate(sets):
        keys = near_dedup.prefix(s, counts)[0]
        rows += [(int(k) >> 1, i, i, len(s) - at, len(s), 0, 0, 0) for at, k in enumerate(keys)]
    rows = np.array(sorted(rows), np.int64)
    links = {(x, y) for y in range(len(sets)) for x in range(y) if near_dedup.linked(sets[x], sets[y])}
    for step in (1, 7, len(rows)):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c) for c in rows[at : at + step].T], names=list(near_dedup._BLOCKS))
            for at in range(0, len(rows), step)
        ]
        found = [tuple(r.values()) for b in near_dedup._block_pairs(iter(batches)) for r in b.to_pylist()]
        assert links <= set(found) and all(a < b for a, b in found)
    assert not list(near_dedup._block_pairs(iter([])))
    # one component holds no pair
    rows[:, 2] = 0
    one = pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=list(near_dedup._BLOCKS))
    assert not sum(b.num_rows for b in near_dedup._block_pairs(iter([one])))


def test_large_open_buckets(spark, monkeypatch):
    """Only pairs that meet by a prefix are compared, and all links are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = [(i, " ".join(f"w{x}" for x in sorted(s))) for i, s in hot_source()]
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {i: root(i) for i in sets}


def test_phrases_are_exact(docs):
    rows = sorted(awkward())
    first, words = {}, {}
    for i, t in rows:
        words[i] = (t or "").encode().split()
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    want = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    assert {r.doc_id: tuple(r)[1:] for r in phrase_automata.remove_repeated_phrases(docs).collect()} == want


def test_bytes_are_exact(docs):
    rows = sorted(awkward())
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = suffix_parse.remove_repeated_bytes(docs).withColumn("kept", F.sha2("kept", 256)).drop("spans")
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def brute_force_windows(rows, units, width):
    """The starts of all windows that a document with a smaller id has too."""
    first = {}
    cut = {i: units(t) for i, t in rows}
    for i in sorted(cut):
        for k in range(len(cut[i]) - width + 1):
            first.setdefault(tuple(cut[i][k : k + width]), i)
    gone = {i: {k for k in range(len(u) - width + 1) if first[tuple(u[k : k + width])] < i} for i, u in cut.items()}
    return {i: starts for i, starts in gone.items() if starts}


@pytest.mark.parametrize("limit", [10, 10**6])
@pytest.mark.parametrize("operator", [phrase_automata, suffix_parse])
def test_hot_anchors_are_cut(spark, monkeypatch, operator, limit):
    """A passage with different words around it: no kernel call gets more windows of an anchor than the limit says."""
    monkeypatch.setattr(recurrence, "HOT", limit, raising=False)
    core = "a core of exactly thirteen words that all of the documents here share"
    rng = random.Random(8)
    rows = [(i, f"{' '.join(f'l{rng.randrange(4)}' for _ in range(6))} {core} r{i % 7} s{i % 5} t{i}") for i in range(300)]
    rows += [(1000 + i, f"{core} " * 5 + f"u{i}") for i in range(3)] + [(2000, "z" * 700), (2001, "z" * 900)]
    rng.shuffle(rows)
    spec, kernel = operator.SPEC, operator.locate if operator is phrase_automata else operator.order

    def guarded(segments):
        windows = {}
        for s in segments:
            data = np.frombuffer(s.content, np.uint8)
            anchor = spec.units(Chunk(np.zeros(1), np.array([0, len(data)]), data, np.zeros(1))).minima[0]
            windows[anchor] = windows.get(anchor, 0) + s.windows
        assert max(windows.values()) <= limit * (spec.width - spec.gram + 1)
        return kernel(segments)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    marks = recurrence.with_marks(docs, spec, guarded).where("marks is not null").collect()
    got = {}
    for r in marks:
        size = len(dict(rows)[r.doc_id].encode()) if spec.unit == "byte" else len(dict(rows)[r.doc_id].split())
        got[r.doc_id] = {k for m in r.marks for k in range(m.start, min(m.start + m.windows, size - spec.width + 1))}
    units = (lambda t: t.encode()) if spec.unit == "byte" else str.split
    assert got == brute_force_windows(rows, units, spec.width)


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_ids_with_several_texts(spark, unit):
    """Each text of an id is judged by itself, against smaller ids only."""
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(45)) for _ in range(8)]

    def text():
        return " ".join([*rng.sample(pool, 2), *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30)))])

    rows = [(i, text()) for i in (1, 1, 2, 3, 3, 3, 5, 5, 8, 9)]
    alone = " ".join(f"alone{i}" for i in range(40))
    rows += [(2, rows[0][1]), (2, alone), (2, alone), (5, None), (5, ""), (9, alone), (None, alone), (10, rows[4][1])]
    width = 13 if unit == "word" else 50
    cut = (lambda t: (t or "").split()) if unit == "word" else (lambda t: list((t or "").encode()))
    first = {}
    for i, t in rows:
        units = cut(t) if i is not None else []
        for k in range(len(units) - width + 1):
            w = tuple(units[k : k + width])
            first[w] = min(first.get(w, i), i)
    want = []
    for i, t in rows:
        units, gone = cut(t), set()
        for k in range(len(units) - width + 1):
            if i is not None and first[tuple(units[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = [u for k, u in enumerate(units) if k not in gone]
        want.append((i, len(gone), " ".join(kept).encode() if unit == "word" else bytes(kept)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, marks string, offset int").repartition(3)
    if unit == "word":
        got = [(r.doc_id, r.n_removed, r.text.encode()) for r in phrase_automata.remove_repeated_phrases(df).collect()]
    else:
        got = [(r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_parse.remove_repeated_bytes(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 0 and (2, 0, alone.encode()) in want


def test_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"t{i}" for i in range(40))
    twice = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in phrase_automata.remove_repeated_phrases(twice).collect()) == [
        (-1, 0), (1, 0), (1, 0), (2, 40)]
    assert sorted((r.doc_id or -1, r.kept) for r in near_dedup.near_duplicates(twice).collect()) == [
        (-1, True), (1, True), (1, True), (2, False)]
    none = twice.where("false")
    for made in (near_dedup.near_duplicates, phrase_automata.remove_repeated_phrases,
                 suffix_parse.remove_repeated_bytes, drop_recurring_lines):
        assert made(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (5, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_lines(spark):
    rows = [(i, f"user {i} logged in from 10.0.0.{i}\nown line of number words {'abcdefghij'[i]}\n") for i in range(5)]
    rows += [(7, "one two three four same words differ here A B\nkeep"), (8, "one two three four same rest is not C D"),
             (9, "one two three four same ends quite otherwise E F"), (10, None), (11, ""), (12, "\n\n")]
    got = {r.doc_id: tuple(r)[1:] for r in drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (3, 0, rows[0][1])
    assert got[3] == (3, 1, "own line of number words d\n")
    assert got[7][1] == 0 and got[8] == (1, 1, "") and got[9] == (1, 1, "")
    assert got[10] == (0, 0, None) and got[11] == (1, 0, "") and got[12] == (3, 0, "\n\n")
