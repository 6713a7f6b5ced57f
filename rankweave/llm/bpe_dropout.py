"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text's pieces come from merging neighbours, best piece first.  Each candidate merge is skipped if a
hash of the seed, the text, the word's place in it and the candidate's place in the word falls below the
rate, so one seed gives the same segmentation on every machine and run, and another seed another one.
With rate 0 the pieces are those of the model file's own encoder.

Words (a run of spaces with what follows it) do not share pieces.  With dropout each occurrence of a word
draws for itself; at rate 0 each distinct word is segmented once and remembered with the merges it took.
With dropout, words that occur again are remembered so too: an occurrence that skips none of these merges
takes them all, as the best candidate is then never a skipped one, and gets the remembered pieces; every
other occurrence is segmented by itself.  Short words are segmented many at a time with NumPy, a merge of
each a round; long ones by an agenda (a heap).

Defined results: null text: null ids.  Empty text: no ids.  A character without a piece becomes its
UTF-8 bytes' pieces, and so does a literal U+2581, which else would decode to a space.  Texts are
encoded whole.  Equal texts get equal ids.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.textbatch import code_points, column, slices, starts_of, use_memory

SPACE = "▁"
LONG = 48  #: characters from which a word goes to the agenda
KEEP = 500_000  #: words remembered
BATCH_CHARS = 4_000_000
NEVER = np.int64(1) << np.int64(60)
_WORDS = re.compile(r" *[^ \n]+|\n| +")
_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _hash(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(33))


def _word_key(word: str, seed: int, variant: int) -> int:
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) | zlib.crc32(raw, (seed * 8191 + variant * 131 + 7) & 0xFFFFFFFF) << 32


class MergeModel:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        scores = np.array([model.get_score(i) for i in range(self.size)])
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spans = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_ids):
            self.spans[i] = bytes([b])
        for i in range(self.size):
            if model.is_control(i) or model.is_unknown(i):
                self.spans[i] = b""
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        # The order of merges: by falling score, then by id.
        order = np.lexsort((np.arange(self.size), -scores))
        self.rank = np.empty(self.size, np.int64)
        self.rank[order] = np.arange(self.size)
        self.by_rank = order
        self.merges = {(plain[p[:k]], plain[p[k:]]): i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        bits = max(8, int(np.ceil(np.log2(len(self.merges) + 1))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER)
        pairs = np.array([l * self.size + r for l, r in self.merges], np.int64)
        for key, slot, made in zip(pairs.tolist(), self._slots(pairs).tolist(), self.merges.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.values[slot] = key, self.rank[made]

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair makes, ``NEVER`` if none."""
        pairs = left.astype(np.int64) * self.size + right
        out = np.full(len(pairs), NEVER)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slots(pairs[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == pairs[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            todo, slot = todo[on], slot[on] + 1 & self.mask
        return out

    def _bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def agenda(self, word: str, key: int, rate: float) -> list[int]:
        """A word's ids by a heap of candidate merges."""
        bar = int(rate * 2.0**64)
        ids = [int(self.chars[ord(c)]) for c in word]
        n = len(ids)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (made := self.merges.get((ids[i], ids[j]))) is not None and not (bar and _skipped(key, i, j, end[j], bar)):
                heapq.heappush(heap, (int(self.rank[made]), i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            rank, i, mid, stop = heapq.heappop(heap)
            if gone[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            ids[i], end[i], gone[j], after[i] = int(self.by_rank[rank]), stop, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        i = 0
        while i < n:
            out += self._bytes_of(word[i]) if ids[i] < 0 else [ids[i]]
            i = after[i]
        return out

    def segment(self, words: list[str], keys: np.ndarray, rate: float, taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[bytes]:
        """Each word's ids as little-endian 32-bit numbers, all words side by side.

        ``taken`` is given each round's merges: the words' places and the merges' places, as ``_merge``.
        """
        if not words:
            return []
        flat, sizes = code_points(words)
        ids = self.chars[flat]
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(flat)) - np.repeat(starts_of(sizes), sizes)
        first = at.copy()
        stop = at + 1
        bar = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))
        done_owner, done_at, done_ids = [], [], []

        def values(i: np.ndarray) -> np.ndarray:
            """The rank that the pair starting at each place makes, if it is not skipped."""
            j = np.minimum(i + 1, len(ids) - 1)
            inside = (i + 1 < len(ids)) & (owner[j] == owner[i])
            out = np.where(inside, self._made(ids[i], ids[j]), NEVER)
            if bar:
                k = np.flatnonzero(out < NEVER)
                out[k[_hash(keys[owner[i[k]]] ^ _merge(first[i[k]], first[j[k]], stop[j[k]])) < bar]] = NEVER
            return out

        value = values(np.arange(len(ids)))
        while len(ids):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            keyed = np.where(value < NEVER, value * 64 + (np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))), NEVER)
            best = np.minimum.reduceat(keyed, begin)
            open_ = best < NEVER
            length = np.diff(np.append(begin, len(ids)))
            if not open_.all():
                shut = np.repeat(~open_, length)
                done_owner.append(owner[shut])
                done_at.append(first[shut])
                done_ids.append(ids[shut])
                keep = ~shut
                begin_kept = np.concatenate([[0], np.cumsum(length[open_])[:-1]]) if open_.any() else np.zeros(0, np.int64)
                owner, first, stop, ids, value = owner[keep], first[keep], stop[keep], ids[keep], value[keep]
                begin, best = begin_kept.astype(np.int64), best[open_]
                if not len(ids):
                    break
            spot = begin + (best & 63)
            if taken is not None:
                taken.append((owner[spot], _merge(first[spot], first[spot + 1], stop[spot + 1])))
            ids[spot] = self.by_rank[best >> 6]
            stop[spot] = stop[spot + 1]
            keep = np.ones(len(ids), bool)
            keep[spot + 1] = False
            shift = np.cumsum(~keep)
            spot = spot - shift[spot]
            owner, first, stop, ids, value = owner[keep], first[keep], stop[keep], ids[keep], value[keep]
            touched = np.concatenate([spot, spot[spot > 0] - 1])
            touched = touched[(touched == len(ids) - 1) | (touched >= 0)]
            value[touched] = values(touched)
        owners, places, got = np.concatenate(done_owner), np.concatenate(done_at), np.concatenate(done_ids)
        order = np.lexsort((places, owners))
        owners, places, got = owners[order], places[order], got[order]
        raw = got.astype("<u4").tobytes()
        edges = np.append(np.flatnonzero(np.diff(owners, prepend=-1)), len(owners)) * 4
        out = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        for k in np.unique(owners[got < 0]).tolist():  # characters that have no piece
            mine = owners == k if len(words) < 64 else slice(*np.searchsorted(owners, [k, k + 1]))
            ids_of = [x for i, p in zip(got[mine].tolist(), places[mine].tolist(), strict=True) for x in (self._bytes_of(words[k][p]) if i < 0 else [i])]
            out[k] = np.array(ids_of, "<u4").tobytes()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space that encoding puts first is taken away."""
        raw = b"".join(map(self.spans.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _merge(first: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """What a merge's place in its word adds to the skip hash."""
    return _hash(first.astype(np.uint64) << np.uint64(42) | middle.astype(np.uint64) << np.uint64(21) | stop.astype(np.uint64))


def _skipped(key: int, first: int, middle: int, stop: int, bar: int) -> bool:
    inner = _merge(np.array([first]), np.array([middle]), np.array([stop]))
    return int(_hash(np.array([key], np.uint64) ^ inner)[0]) < bar


class DropoutEncoder:
    """An encoder with a seed and a rate.  It remembers distinct words without dropout, and their merges."""

    def __init__(self, model: MergeModel, seed: int = 0, rate: float = 0.1) -> None:
        self.model, self.seed, self.rate = model, seed, rate
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pieces: list[bytes] = []
        self.sizes = np.zeros(0, np.int64)  # merges of each remembered word, and all of them in a row
        self.merges = np.zeros(0, np.uint64)

    def _segmented(self, words: list[str], keys: np.ndarray, rate: float, taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[bytes]:
        out = [b""] * len(words)
        short = np.array([i for i, w in enumerate(words) if len(w) < LONG and w != SPACE], np.int64)
        for lo in range(0, len(short), 50_000):
            part = short[lo : lo + 50_000]
            some = None if taken is None else []
            for i, ids in zip(part.tolist(), self.model.segment([words[i].replace(" ", SPACE) for i in part.tolist()], keys[part], rate, some), strict=True):
                out[i] = ids
            if some:
                taken += [(part[owner], merge) for owner, merge in some]
        for i, w in enumerate(words):
            if w == SPACE or len(w) >= LONG:
                ids = self.model._bytes_of(SPACE) if w == SPACE else self.model.agenda(w.replace(" ", SPACE), int(keys[i]), rate)
                out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _remember(self, words: set[str]) -> None:
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > KEEP:
            self._forget()
            missing = words
        if not missing:
            return
        todo, taken = sorted(missing), []
        self.known.update(zip(todo, range(len(self.known), len(self.known) + len(todo)), strict=True))
        self.pieces += self._segmented(todo, np.zeros(len(todo), np.uint64), 0.0, taken)
        if self.rate > 0:
            owners, merges = (np.concatenate([np.zeros(0, kind), *(t[k] for t in taken)]) for k, kind in enumerate((np.int64, np.uint64)))
            self.sizes = np.append(self.sizes, np.bincount(owners, minlength=len(todo)))
            self.merges = np.append(self.merges, merges[np.argsort(owners, kind="stable")])

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text:
            return _WORDS.findall(" " + text)
        return [w for i, part in enumerate((" " + text).split(SPACE)) for w in ([SPACE] if i else []) + _WORDS.findall(part)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        words = [self._words(t) for t in texts]
        if self.rate > 0:
            return self._dropped(texts, words)
        self._remember(set().union(*words))
        return [b"".join([self.pieces[self.known[w]] for w in some]) for some in words]

    def _dropped(self, texts: list[str], words: list[list[str]]) -> list[bytes]:
        """Every occurrence has a key of its own, made from its text and its place there."""
        counts = np.array([len(w) for w in words], np.int64)
        place = np.arange(counts.sum()) - np.repeat(starts_of(counts), counts)
        of_text = np.array([_word_key(t, self.seed, 0) for t in texts], np.uint64)
        keys = _hash(np.repeat(of_text, counts) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        flat = [w for some in words for w in some]
        place_of: dict[str, int] = {}
        which = np.array([place_of.setdefault(w, len(place_of)) for w in flat], np.int64)
        often = (np.bincount(which, minlength=len(place_of)) > 1).tolist()
        self._remember({w for w, again in zip(place_of, often, strict=True) if again and len(w) < LONG})
        at = np.array([self.known.get(w, -1) for w in place_of], np.int64)[which]
        got = [self.pieces[k] if k >= 0 else b"" for k in at.tolist()]
        own = np.flatnonzero((at < 0) | self._varied(at, keys))
        for i, ids in zip(own.tolist(), self._segmented([flat[i] for i in own.tolist()], keys[own], self.rate), strict=True):
            got[i] = ids
        edges = np.append(0, np.cumsum(counts)).tolist()
        return [b"".join(got[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _varied(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which occurrences of remembered words skip a merge that the word takes without dropout."""
        bar = np.uint64(min(int(self.rate * 2.0**64), 2**64 - 1))
        out = np.zeros(len(at), bool)
        begin = starts_of(self.sizes)
        for lo in range(0, len(at), 200_000):
            some = lo + np.flatnonzero(at[lo : lo + 200_000] >= 0)
            sizes = self.sizes[at[some]]
            spots = np.arange(sizes.sum()) + np.repeat(begin[at[some]] - starts_of(sizes), sizes)
            owner = np.repeat(some, sizes)
            out[owner[_hash(keys[owner] ^ self.merges[spots]) < bar]] = True
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str, seed: int, rate: float) -> DropoutEncoder:
    return DropoutEncoder(MergeModel(path), seed, rate)


def _mapped(df: DataFrame, source: str, added: list[tuple[str, str, pa.DataType]], function, drop: tuple[str, ...] = ()) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in {a[0] for a in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("bpe_dropout", _encoder.cache_clear)
        for whole in batches:
            values = column(whole, source)
            others = [whole.column(whole.schema.get_field_index(f.name)) for f in kept]
            for lo, hi in slices([len(x) if x is not None else 0 for x in values], BATCH_CHARS):
                new = function(values[lo:hi])
                yield pa.RecordBatch.from_arrays([*(o.slice(lo, hi - lo) for o in others), *(pa.array(n, a[2]) for n, a in zip(new, added, strict=True))], names=[*(f.name for f in kept), *(a[0] for a in added)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{a[0]}` {a[1]}" for a in added)])
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", seed: int = 0, rate: float = 0.1) -> DataFrame:
    """``df`` with a column of ids; ``model_path`` is the model file's place on every machine."""

    def function(texts: list[str | None]) -> list[list]:
        got = _encoder(model_path, seed, rate).encode([t or "" for t in texts])
        return [[None if t is None else np.frombuffer(g, "<u4").astype(np.int32) for t, g in zip(texts, got, strict=True)]]

    return _mapped(df, text, [(ids, "array<int>", pa.list_(pa.int32()))], function)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give null."""

    def function(rows: list[list[int] | None]) -> list[list]:
        model = _encoder(model_path, 0, 0.0).model
        return [[None if r is None else model.decode(r) for r in rows]]

    return _mapped(df, ids, [(text, "string", pa.string())], function)


def digests(df: DataFrame, model_path: str, text: str = "text", seed: int = 0, rate: float = 0.1) -> DataFrame:
    """``df`` without the text, with what identifies its ids and the text decoded from them."""

    def function(texts: list[str | None]) -> list[list]:
        encoder = _encoder(model_path, seed, rate)
        got = encoder.encode([t or "" for t in texts])
        plain = [encoder.model.decode(np.frombuffer(g, "<u4").tolist()) for g in got]
        return [
            [len(g) // 4 for g in got],
            [zlib.crc32(g) for g in got],
            [zlib.crc32(p.encode()) for p in plain],
            [p == (t or "") for p, t in zip(plain, texts, strict=True)],
        ]

    added = [("n_ids", "bigint", pa.int64()), ("ids_crc32", "bigint", pa.int64()), ("decoded_crc32", "bigint", pa.int64()), ("lossless", "boolean", pa.bool_())]
    return _mapped(df, text, added, function, drop=(text,))
