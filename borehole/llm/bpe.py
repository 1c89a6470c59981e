"""BPE encoding and decoding of the public word tokenizer, by a contiguous array of ranks.

A word's parts are an array, with the rank of each adjacent pair beside it. The array is scanned
for the smallest rank, the boundary there is deleted and the two neighbouring ranks are refreshed,
until no pair has a rank. Short words of one length are held as rows of one matrix, so that a step
is taken for all of them at once. Words above ``LONG`` bytes take the same merges from a heap of
(rank, place), so that their time does not grow with the square of their length.

``encode`` returns ``n_tokens, ids`` and ``decode`` the text of ids: the vocabulary has no decoder,
so tokens are joined by one space. ``encode(..., decoded=True)`` does both in one pass over the texts. Null and
empty texts have no tokens and decode to the empty string; unknown ids are skipped. An empty table gives no rows;
repeated rows come back as often as given, and ids may be null. A task holds texts of about ``TOGETHER`` characters
at a time, or one longer text, whose tables take some fifty bytes a character. The strings of the special tokens are those tokens wherever they
occur. Texts with letters beyond the Latin blocks are cut into words by the library's own splitter,
which settles which Unicode version counts as a letter. Other columns pass ``encode`` by id only.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.llm.hashing import word_hashes
from borehole.session import ship_package

LONG = 64
#: Characters of texts that are encoded at once; one longer text alone.
TOGETHER = 1 << 20
NONE = np.int32(2**31 - 1)
LATIN = 0x240
#: The word pattern that ``latin_words`` follows (fixed value of the vocabulary file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokenizer:
    """The vocabulary file: token ids, merge ranks, word pattern and special tokens."""

    def __init__(self, path: str) -> None:
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens.update({i: t for t, i in self.special.items()})
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.width = max(vocab.values()) + 1
        # the merge table: pairs as sorted numbers, and the first rank of each
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.keys, first = np.unique(keys, return_index=True)
        self.key_ranks = first.astype(np.int32)
        letters = byte_letters()
        self.start = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.end = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.normal = tokenizers.Tokenizer.from_file(path).normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        if pattern != PATTERN:
            raise ValueError(f"unsupported word pattern {pattern!r}")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.strings = np.array([tokens.get(i) for i in range(max(tokens) + 1)], object)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words ``data[start:end]``, one after another, and each word's number of ids.

        Equal words are merged once, words of one length together.
        """
        place = np.argsort(starts, kind="stable")
        hashed = np.empty(len(starts), np.uint64)
        hashed[place] = word_hashes(data, starts[place], ends[place])
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        size = (ends - starts)[first]
        count = np.zeros(len(first), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            raw = data[starts[first[own]][:, None] + np.arange(length)]
            ids = self.start[raw]
            ids[:, -1] = self.end[raw[:, -1]]
            if length > LONG:
                for k, row in zip(own.tolist(), ids, strict=True):
                    done.append((np.array([k]), self.merge_long(row)[None]))
            else:
                done.extend((own[rows], final) for rows, final in self.merge(ids))
        for rows, final in done:
            count[rows] = final.shape[1]
        base = np.cumsum(count) - count
        pool = np.empty(int(count.sum()), np.int32)
        for rows, final in done:
            pool[base[rows][:, None] + np.arange(final.shape[1])] = final
        n = count[which]
        to = np.cumsum(n) - n
        return pool[np.repeat(base[which] - to, n) + np.arange(int(n.sum()))], n

    def merge(self, ids: np.ndarray):
        """Merge all rows (words of one length); yields rows that are ready, with their ids.

        Every step deletes one boundary of each unfinished row, the leftmost of smallest rank.
        """
        rows = np.arange(len(ids))
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] == 1:
                yield rows, ids
                return
            at = rank.argmin(axis=1)
            line = np.arange(len(rows))
            least = rank[line, at]
            ready = least == NONE
            if ready.any():
                yield rows[ready], ids[ready]
                go = ~ready
                rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
                line = line[: len(rows)]
                if not len(rows):
                    return
            n, size = ids.shape
            ids[line, at] = self.merged[least]
            keep = np.ones((n, size), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, size - 1)
            keep = np.ones((n, size - 1), bool)
            keep[line, at] = False
            rank = rank[keep].reshape(n, size - 2)
            if size > 2:
                to_right = np.flatnonzero(at < size - 2)
                p = at[to_right]
                rank[to_right, p] = self.pair_ranks(ids[to_right, p], ids[to_right, p + 1])
                to_left = np.flatnonzero(at > 0)
                p = at[to_left]
                rank[to_left, p - 1] = self.pair_ranks(ids[to_left, p - 1], ids[to_left, p])

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """The same merges of one long word from a heap; stale entries are recognised by their pair."""
        ids, n = word.tolist(), len(word)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.pair_ranks(word[:-1], word[1:])
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = right[i]
            if j >= 0:
                key = ids[i] * self.width + ids[j]
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    heapq.heappush(heap, (int(self.key_ranks[at]), i, ids[i], ids[j]))

        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(self.merged[rank]), False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], np.int32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of ids of each."""
        plain, raw, other = [], [], []
        for i, text in enumerate(texts):
            small = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
            coded = small.encode("utf-8", "surrogatepass")
            # the lead bytes of characters below LATIN end at 0xC8
            if "<|" in text or not small.isascii() and np.frombuffer(coded, np.uint8).max() > 0xC8:
                other.append(i)
            else:
                plain.append(i)
                raw.append(coded)
        bounds = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends = latin_words(data, bounds)
        owner = np.array(plain, np.int64)[np.searchsorted(bounds, starts, "right") - 1]
        special = np.full(len(starts), -1, np.int64)
        if other:
            words, whose, marks = [], [], []
            for i in other:
                for piece in self.cut.split(texts[i]) if self.cut else [texts[i]]:
                    if piece in self.special:
                        own = [piece.encode()]
                    else:
                        cut = self.splitter.pre_tokenize_str(self.normal.normalize_str(piece))
                        own = [w.encode("utf-8", "surrogatepass") for w, _ in cut]
                    words += own
                    whose += [i] * len(own)
                    marks += [self.special.get(piece, -1)] * len(own)
            at = np.cumsum([0, *map(len, words)]) + len(data)
            data = np.concatenate((data, np.frombuffer(b"".join(words), np.uint8)))
            owner = np.concatenate((owner, np.array(whose, np.int64)))
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            starts = np.concatenate((starts, at[:-1]))[order]
            ends = np.concatenate((ends, at[1:]))[order]
            special = np.concatenate((special, np.array(marks, np.int64)))[order]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ids, n = self.encode_words(data, starts, ends)
        marked = np.flatnonzero(special >= 0)
        if len(marked):
            at = np.cumsum(n) - n
            ids[at[marked]] = special[marked]
            keep = np.ones(len(ids), bool)
            for k in marked.tolist():
                keep[at[k] + 1 : at[k] + n[k]] = False
            ids = ids[keep]
            n[marked] = 1
        return ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < len(self.strings))]
        return " ".join([t for t in self.strings[known].tolist() if t is not None])


def _kinds() -> np.ndarray:
    """For each character below ``LATIN``: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(LATIN, 3, np.uint8)
    for c in range(LATIN):
        out[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3)
    out[[*range(9, 14), 32, 0x85, 0xA0]] = 0
    return out


KINDS = _kinds()


def latin_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's words in UTF-8 texts of characters below ``LATIN``.

    Words are runs of letters, single numbers, and runs of other signs; an apostrophe that begins
    a run and stands before one of the pattern's endings forms a word with it.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KINDS[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC2)
    point = (data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63
    kind[lead] = kind[lead + 1] = KINDS[point]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[bounds] = True
    head = kind == 2
    head[lead + 1] = False
    new[:-1] |= head
    quote = np.flatnonzero((data == 39) & new[:-1])
    after = np.concatenate((data, np.zeros(2, np.uint8)))
    whole = np.append(bounds, len(data) + 2)
    room = whole[np.searchsorted(whole, quote, "right")] - quote
    one, two = after[quote + 1], after[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (room >= 2)
    pair = one.astype(np.int64) << 8 | two
    long = np.isin(pair, [0x7265, 0x7665, 0x6C6C]) & (room >= 3)
    for at, n in ((quote[short], 2), (quote[long], 3)):
        new[at + 1] = new[at + 2] = False
        new[at + n] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    words = kind[starts] > 0
    return starts[words], ends[words]


def byte_letters() -> list[str]:
    """A printable letter for every byte: its own if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


@cache
def tokenizer(path: str) -> Tokenizer:
    """One per worker process."""
    return Tokenizer(path)


def _slices(texts: pa.Array):
    """Runs of rows of about ``TOGETHER`` characters, as (first row, texts)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row, and the text of its ids if ``decoded``."""
    ship_package(docs.sparkSession)

    def run(batches):
        own = tokenizer(path or default_path())
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                flat, n = own.encode_all(texts)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([own.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``, which replaces one of that name."""
    ship_package(encoded.sparkSession)
    rows = encoded.drop("decoded")
    place = rows.columns.index(ids_col)
    schema = rows.withColumn("decoded", F.lit("")).schema

    def run(batches):
        own = tokenizer(path or default_path())
        for batch in batches:
            column = batch.column(place)
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int32)
            text = [own.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return rows.mapInArrow(run, schema)
