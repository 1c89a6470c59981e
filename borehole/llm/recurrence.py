"""Runs of units (words or bytes) that also start in a document with a smaller id.

The shared frame of the two substring operators. A window is ``width`` consecutive units. Its
anchor is the ``gram`` units with the smallest hash in it, so equal windows have equal anchors,
and consecutive windows with one anchor form a segment. Three jobs, each ending in a table:

1. ``anchors``: the anchors of every document go to the partition of their hash; those found in
   two documents come back. Within a batch of documents a repeated anchor is known to recur: its
   documents pass through, and one row speaks for the batch, so an anchor that a third of all
   documents share sends one row per batch. Rows carry counts, so anchors with more than ``HOT``
   segments are known; there are at most corpus / ``HOT`` of them, and every task gets their list.
2. ``segments``: the segments with a recurring anchor go to the partition of that anchor. A
   segment equal to one of a smaller document in the same batch is decided there and passes
   through. A kernel (automata or suffix order) gets whole anchor groups, in blocks of bounded
   size, and returns the runs of windows that start in a smaller document. Segments of hot anchors
   are cut into their windows, and each window goes to the partition of its own hash, one row per
   batch; there it is compared whole, and only the smallest document so far is held.
3. ``marks``: the runs of each document, joined to its text.

Whole copies of a smaller document are found by digests first and take no part in step 2: all they
have goes. Every shuffle carries rows keyed by a hash of contents; texts are shuffled twice, by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borehole.llm.cleanup import release
from borehole.llm.hashing import (
    BLOCK_BYTES, U64, Chunk, byte_grams, chunks, grams, signed, sliding_min, word_bounds, word_hashes,
)
from borehole.session import materialise, ship_package

#: Segments that a kernel gets at once, unless one anchor alone has more.
KERNEL_ROWS = 20_000
KERNEL_BYTES = 4 << 20
#: Segments (of ``Spec.reach`` windows) above which an anchor's windows are dealt by their own hashes.
HOT = KERNEL_ROWS
#: Hot segments that are cut into windows at once.
CUT_ROWS = 4096
#: The number of windows of a run that ends with its text.
WHOLE = 1 << 30

#: States of segments. An anchor's row has THROUGH, or its number of segments, below 0 for a speaker.
THROUGH, SINGLE, WINDOW = 0, 1, 2
_SEGMENT = "h long, doc_id long, start int, windows int, state byte, content binary"

Kernel = Callable[[list["Segment"]], Iterator[tuple[int, int, int]]]


@dataclass
class Segment:
    doc: int
    start: int
    windows: int
    content: bytes
    #: The hash of its anchor.
    anchor: int = 0


@dataclass
class Units:
    """The units of a chunk: byte ranges, and for each document its range of units."""

    starts: np.ndarray | None
    ends: np.ndarray | None
    cut: np.ndarray
    minima: np.ndarray = field(repr=False)

    def span(self, first: int, last: int) -> tuple[int, int]:
        if self.starts is None:
            return first, last
        return int(self.starts[first]), int(self.ends[last - 1])


@dataclass(frozen=True)
class Spec:
    unit: str
    width: int
    gram: int

    @property
    def reach(self) -> int:
        """The windows that can hold one place of an anchor."""
        return self.width - self.gram + 1

    def units(self, chunk: Chunk) -> Units:
        if self.unit == "byte":
            return Units(None, None, chunk.bounds, self._minima(chunk.data, byte_grams))
        starts, ends = word_bounds(chunk.data, chunk.bounds)
        hashes = word_hashes(chunk.data, starts, ends)
        cut = np.searchsorted(starts, chunk.bounds)
        return Units(starts, ends, cut, self._minima(hashes, lambda u: grams(u, self.gram)))

    def _minima(self, units: np.ndarray, hashed) -> np.ndarray:
        """The anchor of every window, block by block."""
        n = len(units) - self.width + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = np.empty(n, U64)
        for at in range(0, n, BLOCK_BYTES // 2):
            to = min(n, at + BLOCK_BYTES // 2)
            out[at:to] = sliding_min(hashed(units[at : to + self.width - 1]), self.reach)
        return out

    def windows_of(self, units: Units, i: int) -> tuple[int, int]:
        lo, hi = int(units.cut[i]), int(units.cut[i + 1])
        return lo, max(lo, hi - self.width + 1)

    def cut(self, content: bytes) -> list[bytes]:
        """The windows of a segment."""
        if self.unit == "byte":
            return [content[i : i + self.width] for i in range(len(content) - self.width + 1)]
        words = content.split(b" ")
        return [b" ".join(words[i : i + self.width]) for i in range(len(words) - self.width + 1)]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], edge)), np.concatenate((edge, [len(values)]))


def _anchor_rows(spec: Spec):
    def rows(batches):
        for chunk in chunks(batches, size=8 << 20):
            units = spec.units(chunk)
            found, owner, number = [], [], []
            for i in range(len(chunk.ids)):
                lo, hi = spec.windows_of(units, i)
                if hi > lo:
                    mine, n = np.unique(units.minima[lo:hi], return_counts=True)
                    found.append(mine)
                    number.append(-(-n // spec.reach))
                    owner.append(np.full(len(mine), chunk.ids[i], np.int64))
            if not found:
                continue
            h, doc = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first, last = runs(h)
            n = np.add.reduceat(np.concatenate(number)[order], first)
            many = doc[first] != doc[last - 1]
            state = np.repeat(np.where(many, THROUGH, n), last - first)
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            speak = first[many]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((signed(h)[keep], signed(h)[speak]))),
                    pa.array(np.concatenate((doc[keep], doc[speak]))),
                    pa.array(np.concatenate((state[keep], -n[many])).astype(np.int32)),
                ],
                names=["h", "doc_id", "state"],
            )

    return rows


def _groups(batches, key: int = 0) -> Iterator[pa.Table]:
    """Batches of whole groups, from rows sorted by a key: the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[-1]):
            held.append(batch)
            continue
        if cut == 0:
            yield pa.Table.from_batches(held)
            held = [batch]
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _recurring(limit: int):
    """(doc_id, h) of every document that holds a recurring anchor, and (null, h) of every hot one."""

    def rows(batches):
        for table in _groups(batches):
            h, doc, state = (table.column(i).to_numpy() for i in range(3))
            first, last = runs(h)
            open_ = state != THROUGH
            spoken = np.add.reduceat(state < 0, first) > 0
            n = np.add.reduceat(open_, first)
            least = np.minimum.reduceat(np.where(open_, doc, np.iinfo(np.int64).max), first)
            most = np.maximum.reduceat(np.where(open_, doc, np.iinfo(np.int64).min), first)
            yes = spoken | (n > 1) & (least < most)
            keep = (state == THROUGH) | (state > 0) & np.repeat(yes, last - first)
            hot = h[first[yes & (np.add.reduceat(np.abs(state.astype(np.int64)), first) > limit)]]
            ids = pa.concat_arrays([pa.array(doc[keep], pa.int64()), pa.nulls(len(hot), pa.int64())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate((h[keep], hot)))], names=["doc_id", "h"])

    return rows


def _window_rows(spec: Spec, rows: list[tuple[tuple[int, int, int, int], bytes]]) -> Iterator[tuple]:
    """The windows of hot segments, by ascending documents: those of an earlier one pass through.

    A window that a document has k times is one row, with the other k - 1 starts after its content.
    """
    first: dict[bytes, tuple[int, list[int]]] = {}
    for (doc, start, windows, h), content in rows:
        gone = np.zeros(windows, bool)
        for i, window in enumerate(spec.cut(content)):
            low, starts = first.setdefault(window, (doc, []))
            if low < doc:
                gone[i] = True
            else:
                starts.append(start + i)
        if gone.any():
            for a, b in zip(*(x.tolist() for x in runs(gone)), strict=True):
                if gone[a]:
                    yield h, doc, start + a, b - a, THROUGH, None
    for window, (doc, starts) in first.items():
        h = int.from_bytes(blake2b(window, digest_size=8).digest(), "little", signed=True)
        yield h, doc, starts[0], len(starts), WINDOW, window + np.array(starts[1:], "<i4").tobytes()


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    h, doc, start, n, state, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()),
         pa.array(n, pa.int32()), pa.array(state, pa.int8()), pa.array(content, pa.binary())],
        names=["h", "doc_id", "start", "windows", "state", "content"],
    )


def _segment_rows(spec: Spec, hot: np.ndarray):
    """The segments with recurring anchors; repeats within the batch are decided here."""

    def rows(batches):
        cut_up = set(hot.tolist())
        for batch in batches:
            wanted, offset = batch.column(2), batch.column(3).to_numpy()
            for chunk in chunks([batch], size=4 << 20):
                units = spec.units(chunk)
                first: dict[bytes, tuple[int, int, int, int]] = {}
                h, doc, start, n, state, content = [], [], [], [], [], []
                large: list[tuple[tuple[int, int, int, int], bytes]] = []

                def put(row, kind, text, h=h, doc=doc, start=start, n=n, state=state, content=content, large=large):
                    if kind == SINGLE and row[3] in cut_up:
                        large.append((row, text))
                        return
                    h.append(row[3])
                    doc.append(row[0])
                    start.append(row[1])
                    n.append(row[2])
                    state.append(kind)
                    content.append(text)

                for i in range(len(chunk.ids)):
                    lo, hi = spec.windows_of(units, i)
                    if hi <= lo:
                        continue
                    minima = signed(units.minima[lo:hi])
                    a, b = runs(minima)
                    ok = np.flatnonzero(np.isin(minima[a], wanted[int(chunk.rows[i])].values.to_numpy()))
                    base, moved = int(units.cut[i]), int(offset[int(chunk.rows[i])])
                    for k in ok.tolist():
                        s, e = int(a[k]), int(b[k])
                        from_, to = units.span(base + s, base + e - 1 + spec.width)
                        text = chunk.data[from_:to].tobytes()
                        if spec.unit == "word":
                            text = b" ".join(text.split())
                        row = (int(chunk.ids[i]), moved + s, e - s, int(minima[s]))
                        old = first.get(text)
                        if old is None:
                            first[text] = row
                        elif row[0] > old[0]:
                            put(row, THROUGH, None)
                        elif row[0] < old[0]:
                            put(old, THROUGH, None)
                            first[text] = row
                        else:
                            put(row, SINGLE, text)
                for text, row in first.items():
                    put(row, SINGLE, text)
                if h:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()),
                         pa.array(n, pa.int32()), pa.array(state, pa.int8()), pa.array(content, pa.binary())],
                        names=["h", "doc_id", "start", "windows", "state", "content"],
                    )
                large.sort(key=lambda x: (x[0][3], x[0][0]))
                for at in range(0, len(large), CUT_ROWS):
                    yield _segment_batch(list(_window_rows(spec, large[at : at + CUT_ROWS])))

    return rows


def _settled(batches):
    """Windows of hot anchors become rows that pass through where a smaller document has them too.

    Rows are sorted by ``h``. Of every window only the smallest document so far is held.
    """
    at, first = None, {}
    for batch in batches:
        is_window = batch.column(4).to_numpy() == WINDOW
        if not is_window.any():
            yield batch
            continue
        out = []
        for h, doc, start, n, content in zip(
            *(batch.column(i).filter(pa.array(is_window)).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True
        ):
            if h != at:
                at, first = h, {}
            end = len(content) - 4 * (n - 1)
            window, starts = content[:end], [start, *np.frombuffer(content, "<i4", n - 1, end).tolist()] if n > 1 else [start]
            low, own = first.setdefault(window, (doc, []))
            if doc == low:
                own += starts
                continue
            if doc < low:
                first[window] = doc, starts
                doc, starts = low, own
            out += [(h, doc, s, 1, THROUGH, None) for s in starts]
        rest = [batch.filter(pa.array(~is_window))]
        if out:
            rest.append(_segment_batch(out).cast(batch.schema))
        rest = pa.Table.from_batches(rest)
        order = np.argsort(rest.column(0).to_numpy(), kind="stable")
        yield from rest.take(order).combine_chunks().to_batches()


def _decided(kernel: Kernel):
    """Runs of windows to remove: passed through, or found by the kernel in blocks of whole groups."""

    def rows(batches):
        held: list[pa.Table] = []
        size = 0

        def flush():
            table = pa.concat_tables(held)
            through = table.column("state").to_numpy() == THROUGH
            d, s, w = (table.column(x).to_numpy() for x in ("doc_id", "start", "windows"))
            out = [(d[through], s[through], w[through])]
            idx = np.flatnonzero(~through)
            columns = (d[idx], s[idx], w[idx], table.column("content").take(pa.array(idx)), table.column("h").take(pa.array(idx)))
            segments = list(map(Segment, *(c.tolist() if isinstance(c, np.ndarray) else c.to_pylist() for c in columns)))
            if found := list(kernel(segments)) if segments else []:
                out.append(tuple(np.array(x, np.int64) for x in zip(*found, strict=True)))
            d, s, w = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(d.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32))],
                names=["doc_id", "start", "windows"],
            )

        for table in _groups(_settled(batches)):
            # split a large batch between groups, so that the kernel's memory stays bounded
            keys = table.column(0).to_numpy()
            at = 0
            while at < len(keys):
                to = min(len(keys), at + KERNEL_ROWS)
                to = int(np.searchsorted(keys, keys[to - 1], "right"))
                part = table.slice(at, to - at)
                held.append(part)
                size += part.nbytes
                if sum(t.num_rows for t in held) >= KERNEL_ROWS or size >= KERNEL_BYTES:
                    yield flush()
                    held, size = [], 0
                at = to
        if held:
            yield flush()

    return rows


def with_marks(texts: DataFrame, spec: Spec, kernel: Kernel) -> DataFrame:
    """``doc_id, text, marks, offset``: every row with the runs of windows that start in a smaller document.

    ``texts`` has ``doc_id, text`` (text as binary or string). ``marks`` are runs ``(start, windows)``, null if there
    are none. An id may have several texts: they are laid out one after another, each text's ``offset`` is
    its place there, and starts count from the first. :func:`covered` takes a text's own part.
    """
    ship_package(texts.sparkSession)
    digests = materialise(_digests(texts.where("doc_id is not null and text is not null")), "digests")
    offsets = _offsets(digests)
    placed = texts.withColumn("offset", F.lit(0))
    if not offsets.isEmpty():
        at = _digests(texts, "text").join(offsets, ["doc_id", *_SAME], "left")
        placed = at.select("doc_id", "text", F.coalesce("offset", F.lit(0)).alias("offset"))
    marks = _recurring_runs(placed, _copies(digests, offsets), spec, kernel)
    return placed.join(marks, "doc_id", "left").select("doc_id", "text", "marks", "offset")


def _recurring_runs(placed: DataFrame, copies: DataFrame, spec: Spec, kernel: Kernel) -> DataFrame:
    """``doc_id, marks`` of the documents with such windows."""
    texts = placed
    known = placed.where("doc_id is not null and text is not null")
    part = F.when(F.col("state") == THROUGH, F.xxhash64("doc_id", F.lit(1))).otherwise(F.col("h"))
    rows = known.select("doc_id", "text").mapInArrow(_anchor_rows(spec), "h long, doc_id long, state int")
    hits = (
        rows.repartition(part).sortWithinPartitions("h").mapInArrow(_recurring(HOT), "doc_id long, h long")
        .groupBy("doc_id").agg(F.collect_list("h").alias("anchors"))
    )
    hits = materialise(hits.join(copies, "doc_id", "left_anti"), "anchors")
    del rows
    release(texts.sparkSession)
    hot = [h for row in hits.where("doc_id is null").select("anchors").collect() for h in row.anchors]
    segments = known.join(hits, "doc_id").select("doc_id", "text", "anchors", "offset").mapInArrow(
        _segment_rows(spec, np.array(hot, np.int64)), _SEGMENT
    )
    marks = (
        segments.repartition(part).sortWithinPartitions("h")
        .mapInArrow(_decided(kernel), "doc_id long, start int, windows int")
        .union(copies.select("doc_id", F.lit(0), F.lit(WHOLE)))
        .groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    )
    marks = materialise(marks, "marks")
    del segments
    release(texts.sparkSession)
    return marks


_SAME = ["size", "one", "two"]


def _digests(known: DataFrame, *columns: str) -> DataFrame:
    """Each row's id with its text's length and 128 hash bits."""
    return known.select(
        "doc_id", *columns, F.length("text").alias("size"), F.xxhash64("text").alias("one"),
        F.xxhash64(F.lit("second"), "text").alias("two"),
    )


def _offsets(digests: DataFrame) -> DataFrame:
    """``doc_id, size, one, two, offset`` of the ids that have several different texts."""
    text = F.struct(*_SAME)
    several = digests.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi")
    rows = digests.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    before = Window.partitionBy("doc_id").orderBy(*_SAME).rowsBetween(Window.unboundedPreceding, -1)
    # a text has at most as many units as bytes, and at most four bytes a character
    size = F.col("size").cast("long") * 4 + 1
    return materialise(rows.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int")), "offsets")


def _copies(digests: DataFrame, offsets: DataFrame) -> DataFrame:
    """Ids of the documents whose whole text a smaller id has too, but for those with several texts."""
    first = digests.groupBy(*_SAME).agg(F.min("doc_id").alias("first"))
    again = digests.join(first, _SAME).where("first < doc_id").select("doc_id").distinct()
    return materialise(again.join(offsets.select("doc_id"), "doc_id", "left_anti"), "copies")


def covered(marks: pa.Scalar, n: int, width: int, offset: int = 0) -> np.ndarray:
    """Which of ``n`` units, from ``offset`` on, lie in a marked window."""
    if n < width:
        return np.zeros(n, bool)
    both = marks.values
    start, windows = both.field(0).to_numpy().astype(np.int64) - offset, both.field(1).to_numpy()
    own = (start >= 0) & (start < n)
    start = start[own]
    end = start + windows[own] + width - 1
    delta = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(end, n), minlength=n + 1)[: n + 1]
    return np.cumsum(delta[:n]) > 0
