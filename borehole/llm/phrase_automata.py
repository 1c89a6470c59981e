"""Substring dedup on words: confirmed passages, sharded Aho-Corasick automata.

A word is removed when it lies in a window of 13 words whose words also start in a document with
a smaller id. Candidate passages of all documents meet, by the hash of a short anchor they must
share, in the partition that compiles their automata (``recurrence``). There

1. passages of two documents are confirmed word by word, and each keeps its first document,
2. they are compiled to one Aho-Corasick automaton per bounded block of anchors, over words
   numbered within the block, and
3. the candidate stretches of every document stream through it, which finds every occurrence.

A document's stretches go only to automata that may hold a phrase of it, so the corpus isn't read
once per shard.

Null and empty texts have no words. Texts of fewer than 13 words lose nothing. Equal texts under
one id don't count as copies; an id may have several texts, which are judged each by itself and
don't count against one another. Repeated rows come back as often as given. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.llm.hashing import chunks, word_bounds
from borehole.llm.recurrence import Segment, Spec, covered, with_marks

WORDS = 13
SPEC = Spec("word", WORDS, 5)
#: First code point after the surrogates, which texts can't hold.
_AFTER = 0xE000


def _letters(content: bytes, codes: dict[bytes, str]) -> str:
    """The words as one character each."""
    return "".join([codes[w] for w in content.split(b" ")])


class _Codes(dict):
    def __missing__(self, word: bytes) -> str:
        n = len(self)
        code = self[word] = chr(n + 1 if n + 1 < 0xD800 else n + 1 - 0xD800 + _AFTER)
        return code


def locate(segments: list[Segment]) -> Iterator[tuple[int, int, int]]:
    """(doc, start, windows) of all runs of windows that a smaller document holds too."""
    codes = _Codes()
    owners: dict[str, list[Segment]] = {}
    for s in segments:
        owners.setdefault(_letters(s.content, codes), []).append(s)
    first: dict[str, int] = {}
    several: set[str] = set()
    for text, own in owners.items():
        docs = {s.doc for s in own}
        low = min(docs)
        for i in range(len(text) - WORDS + 1):
            window = text[i : i + WORDS]
            known = first.get(window)
            if known is None:
                first[window] = low
                if len(docs) > 1:
                    several.add(window)
            else:
                if known != low or len(docs) > 1:
                    several.add(window)
                if low < known:
                    first[window] = low
    if not several:
        return
    automaton = ahocorasick.Automaton()
    for window in several:
        automaton.add_word(window, first[window])
    automaton.make_automaton()
    for text, own in owners.items():
        found = list(automaton.iter(text))
        if not found:
            continue
        latest = max(low for _, low in found)
        for s in own:
            if len(found) == s.windows and latest < s.doc:
                yield s.doc, s.start, s.windows
                continue
            run = None
            for end, low in found:
                if low >= s.doc:
                    continue
                at = end - WORDS + 1
                if run is not None and run[0] + run[1] == at:
                    run[1] += 1
                    continue
                if run is not None:
                    yield s.doc, s.start + run[0], run[1]
                run = [at, 1]
            if run is not None:
                yield s.doc, s.start + run[0], run[1]


def _strip(batches):
    for batch in batches:
        marks, offsets = batch.column(2), batch.column(3).to_numpy()
        for chunk in chunks([batch]):
            n_words, n_removed, kept = [], [], []
            starts, ends = word_bounds(chunk.data, chunk.bounds)
            cut = np.searchsorted(starts, chunk.bounds)
            for i in range(len(chunk.ids)):
                lo, hi = int(cut[i]), int(cut[i + 1])
                words = chunk.text(i).split()
                mark = marks[int(chunk.rows[i])]
                n_words.append(hi - lo)
                if mark.is_valid and hi > lo:
                    gone = covered(mark, hi - lo, WORDS, int(offsets[int(chunk.rows[i])]))
                    n_removed.append(int(gone.sum()))
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows)), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )


def remove_repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the kept words of every document, joined by one space."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = with_marks(texts, SPEC, locate)
    return marked.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, text string")
