"""Packing of tokenised documents into fixed windows by multiway differencing.

Documents become ids by a public tokenizer plus one closing id.  Whole windows are cut off a long
document; what is left is cut into parts, and groups of parts are dealt to windows by the
Karmarkar-Karp method: every part starts as a partition of its own with one filled window and the
others empty; again and again the two partitions with the largest spread merge, the fullest windows
of one meeting the emptiest of the other, so that opposing imbalances cancel.  A group starts with
the least number of windows that could hold it, and the number rises until none is over capacity.

Groups are bounded and built within a task from its own rows, so nothing is shuffled and a task that
is run again makes the same windows.  Every id lands in exactly one piece, none is dropped.

Defined results: null and empty text: the closing id alone.  No rows: no pieces.  Equal texts get
equal ids; repeated rows are packed each.
"""

from __future__ import annotations

import functools
import gc
import heapq
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rankweave.llm.textbatch import column, slices, trimmed, use_memory

WINDOW = 2048
PART = 512  #: what remains of a document is cut into equal parts of at most so many ids
GROUP_IDS = 96 * WINDOW
BATCH_CHARS = 6_000_000
KEEP_RUNS = 900_000  #: runs of non-blanks that a worker remembers, of some 200 bytes each

#: Fixed value: the word pattern of the public tokenizer file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Encodes by the tokenizer file, but each distinct run of non-blanks once.

    Its words are encoded apart from each other, so a text's ids are those of its words in a row, and
    no word crosses white space.  Texts with characters beyond the common Latin ones, or with a
    special token's string, go to the tokenizer whole, where normalisation may differ from Python's.
    """

    def __init__(self, path: str, keep_runs: int = KEEP_RUNS) -> None:
        self.keep_runs = keep_runs
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = regex.compile(WORDS)
        self.unusual = re.compile("[^\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u017f\u2010-\u2027]|<\\|")
        self.runs: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, runs: set[str]) -> None:
        """The ids of new runs of non-blanks, by those of their words; a word is a run as well."""
        if len(self.runs) + len(runs) > self.keep_runs:
            self.runs.clear()
        known = self.runs
        # most runs are letters, perhaps with one mark behind; the pattern splits the others
        split = {r: [r[:-1], r[-1]] if r[:-1].isalpha() and r[-1] in ".,;:?!" else self.words.findall(r) for r in runs if not r.isalpha()}
        new = list({w for words in split.values() for w in words if w not in known}.union(r for r in runs if r not in split))
        for lo in range(0, len(new), 200):
            part = new[lo : lo + 200]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, at = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids)
            edges = [0, *((np.flatnonzero(np.diff(at)) + 1) * 4).tolist(), len(ids)]
            if len(edges) == len(part) + 1:
                known.update(zip(part, (ids[i:j] for i, j in itertools.pairwise(edges)), strict=True))
            else:
                known.update((w, self._whole(w)) for w in part)
        get = known.__getitem__
        known.update([(r, b"".join(map(get, words))) for r, words in split.items()])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        gc.disable()  # the word lists hold no cycles, and walking them again and again is slow
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), 500):
            some = texts[lo : lo + 500]
            split = [None if self.unusual.search(t) else t.lower().split() for t in some]
            found = [None if s is None else list(map(self.runs.get, s)) for s in split]
            holes = [i for i, f in enumerate(found) if f is not None and None in f]
            new = {r for i in holes for r, ids in zip(split[i], found[i], strict=True) if ids is None}
            if new:
                self._learn(new)
                get = self.runs.__getitem__
                for i in holes:
                    found[i] = [get(r) if ids is None else ids for r, ids in zip(split[i], found[i], strict=True)]
            out += [self._whole(t) if f is None else b"".join(f) for t, f in zip(some, found, strict=True)]
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str, keep_runs: int) -> WordEncoder:
    return WordEncoder(path, keep_runs)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of ``k``, of each size, by multiway differencing; ties go by position."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    sums: list[np.ndarray | None] = []
    for s in sizes:
        row = np.zeros(k, np.int64)
        row[0] = s
        sums.append(row)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        sums.append(total)
        merged.append((a, b, order))
        heapq.heapreplace(heap, (int(total[-1] - total[0]), len(sums) - 1))
    place: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    for i in range(len(merged) - 1, -1, -1):
        a, b, order = merged[i]
        final = place.pop(n + i)
        here = np.empty(k, np.int64)
        here[order] = final
        place[a], place[b] = here, here[::-1]
    return np.array([place[i][0] for i in range(n)], np.int64)


def pack_sizes(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Windows of parts that each fit one: by differencing, over as few windows as it can fill."""
    total = int(sizes.sum())
    k = max(1, -(-total // window))
    while True:
        at = differencing(sizes, k)
        if np.bincount(at, weights=sizes, minlength=k).max(initial=0) <= window:
            return at, k
        k += 1


def pack_ids(docs: list[bytes], window: int = WINDOW, part: int = PART, group_ids: int = GROUP_IDS) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document's position, start, length, sequence, offset); sequences count from 0."""
    sequence = 0
    waiting: list[tuple[int, int, int]] = []
    load = 0

    def dealt() -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal sequence, load
        if waiting:
            sizes = np.array([w[2] for w in waiting], np.int64)
            at, k = pack_sizes(sizes, window)
            fill = np.zeros(k, np.int64)
            numbers = np.full(k, -1)
            for (doc, start, length), b in zip(waiting, at, strict=True):
                if numbers[b] < 0:
                    numbers[b], sequence = sequence, sequence + 1
                yield doc, start, length, int(numbers[b]), int(fill[b])
                fill[b] += length
            waiting.clear()
            load = 0

    for doc, ids in enumerate(docs):
        n = len(ids) // 4
        whole = n // window
        for i in range(whole):
            yield doc, i * window, window, sequence, 0
            sequence += 1
        rest = n - whole * window
        cuts = -(-rest // part)
        edges = [whole * window + rest * i // cuts for i in range(cuts + 1)] if cuts else []
        for lo, hi in itertools.pairwise(edges):
            waiting.append((doc, lo, hi - lo))
            load += hi - lo
        if load >= group_ids:
            yield from dealt()
    yield from dealt()


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", closing_id: int = 1, window: int = WINDOW, with_ids: bool = False, keep_runs: int = KEEP_RUNS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with
    ``with_ids`` also the ids.  ``tokenizer`` is the path of the tokenizer file on every machine;
    ``keep_runs`` trades memory of the Python workers for time."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    end = np.array([closing_id], "<u4").tobytes()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, pa.DataType]]:
        for whole in batches:
            keys, texts = column(whole, doc_id), column(whole, text)
            for lo, hi in slices([len(t or "") for t in texts], BATCH_CHARS):
                yield keys[lo:hi], texts[lo:hi], whole.schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("packing", _encoder.cache_clear)
        encoder = _encoder(tokenizer, keep_runs)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        for keys, texts, kind in parts(batches):
            ids = [t + end for t in encoder.encode([t or "" for t in texts])]
            rows = list(pack_ids(ids, window))
            cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in rows]
            columns = [
                pa.array([keys[r[0]] for r in rows], kind),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                pa.array([len(ids[r[0]]) // 4 for r in rows], pa.int64()),
                pa.array([base + r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(c, "<u4").astype(np.int64) for c in cut], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)
            base += max((r[3] for r in rows), default=-1) + 1

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select(doc_id, text).mapInArrow(trimmed(run), schema)
