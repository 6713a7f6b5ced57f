"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text.  A text is
parsed greedily into phrases, each the longest match that occurs in the language's sample; the
number of phrases times the log of the sample's length, over the text's length, estimates the cross
entropy in bits a symbol.  The language that needs the fewest normalised phrases wins.

The automaton with its restarts is a complete finite automaton: where a state has no transition for
a symbol, the next phrase begins with that symbol.  So one table look-up a symbol gives
the parse, and many windows of text are parsed side by side with NumPy.  Each window is parsed as if a
phrase began with it; then the phrase that reaches into it is carried on until both parses begin a
phrase at the same symbol, from where they are one.  So the windows do not show in the result.

Every letter of a language's sample is a symbol of its automaton.  A letter that the sample lacks
makes a phrase of its own whichever it is, so one symbol stands for all of these.

Defined results: null text, or text without a letter: ``und`` with score 0.  No labelled rows at
all: ``und`` with score 0 for every row.  Ties go to the language that sorts first.  Repeated rows
are each predicted alike.  Texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.textbatch import code_points, column, slices, starts_of, sums, trimmed, use_memory

WINDOW = 1024  #: symbols that are parsed one after the other; any number gives the same phrases
DENSE = 24_000_000  #: entries of all languages' tables; the automata of larger alphabets or more languages are kept as sorted transitions
BATCH_CHARS = 3_000_000


class LanguageModel:
    """The normalised sample of each language; small enough to travel with the task."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        self.samples = []
        for lang in self.languages:
            flat, lengths = code_points([samples[lang]])
            letters, _, _ = _normalised(_letters()[flat], lengths)
            self.samples.append(np.where(letters == 0, 32, letters).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))

    @property
    def key(self) -> tuple:
        return (*self.languages, *self.samples)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of every code point; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def _normalised(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, and 0 for each run of others that follows a letter; how many of both each text has, and how many letters."""
    gap = letters == 0
    before = np.zeros(len(letters), bool)
    before[1:] = ~gap[:-1]
    before[starts_of(lengths)[lengths > 0]] = False
    keep = ~gap | before
    return letters[keep], sums(keep, lengths), sums(~gap, lengths)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all factors of ``symbols``; state 0 starts."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """One language's automaton with restarts.

    A state is twice its number, plus 1 if the last symbol began a phrase; symbol 0 is a gap, the last one
    any letter that the sample lacks.
    """

    def __init__(self, sample: str, room: int) -> None:
        known = sorted(set(sample) - {" "})
        self.bits = np.log2(len(sample) + 2)
        self.width = len(known) + 2
        number = {c: i + 1 for i, c in enumerate(known)} | {" ": 0}
        own = np.full(0x110000, self.width - 1, np.uint16 if self.width < 65536 else np.uint32)
        own[0] = 0
        own[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.symbol_of = own
        steps = suffix_automaton([number[c] for c in sample])
        self.start = 2 * len(steps)  # here, and after a symbol that the sample lacks, every symbol begins a phrase
        self.root = np.full(self.width, self.start + 1, np.int64)
        for c, s in steps[0].items():
            self.root[c] = 2 * s + 1
        self.table = None
        if (len(steps) + 1) * self.width <= room:
            self.table = np.tile(self.root.astype(np.int32), (len(steps) + 1, 1))
            for i, step in enumerate(steps):
                for c, s in step.items():
                    self.table[i, c] = 2 * s
            self.table = self.table.ravel()
        else:
            told = np.array(sorted((i * self.width + c, 2 * s) for i, step in enumerate(steps) for c, s in step.items()), np.int64).reshape(-1, 2)
            self.keys, self.next = np.append(told[:, 0], np.iinfo(np.int64).max), np.append(told[:, 1], 0)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        at = (state >> 1) * self.width + symbols
        if self.table is not None:
            return self.table.take(at)
        place = np.searchsorted(self.keys, at)
        return np.where(self.keys[place] == at, self.next[place], self.root[symbols])


@functools.lru_cache(maxsize=2)
def _parsers(key: tuple) -> list[Parser]:
    samples = key[len(key) // 2 :]
    return [Parser(s, DENSE // len(samples)) for s in samples]


def _window_phrases(parser: Parser, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Phrases that begin in each window of consecutive symbols; ``later`` windows carry on their predecessor's text."""
    order = np.argsort(-size, kind="stable")
    first, room = begin[order], size[order]
    state, count = np.full(len(order), parser.start, np.int64), np.zeros(len(order), np.int64)
    begins = np.zeros(len(symbols), bool) if later.any() else None
    open_ = len(order) - np.searchsorted(room[::-1], np.arange(room[0] if len(room) else 0), "right")
    for t, n in enumerate(open_.tolist()):
        at = first[:n] + t
        state[:n] = parser.step(state[:n], symbols[at])
        new = state[:n] & 1
        count[:n] += new
        if begins is not None:
            begins[at] = new
    if begins is None:
        out = np.zeros(len(order), np.int64)
        out[order] = count
        return out
    supposed, ends = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    supposed[order], ends[order] = count, state
    out, reached = supposed.copy(), ends.copy()
    todo = np.flatnonzero(later)
    while len(todo):
        lane, state = todo, reached[todo - 1]
        count, passed, last = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64), reached[todo]
        t = 0
        while len(lane):
            at = begin[lane] + t
            state = parser.step(state, symbols[at])
            new, old = state & 1, begins[at]
            count += new
            passed += old
            t += 1
            one = (new & old) == 1
            over = ~one & (t == size[lane])
            out[lane[one]] = (count + supposed[lane] - passed)[one]
            reached[lane[one]] = ends[lane[one]]
            out[lane[over]], reached[lane[over]] = count[over], state[over]
            on = ~(one | over)
            lane, state, count, passed = lane[on], state[on], count[on], passed[on]
        after = todo[reached[todo] != last] + 1
        after = after[after < len(later)]
        todo = after[later[after]]
    return out


def phrases(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each language and text, and each text's symbols and letters."""
    flat, lengths = code_points(texts)
    letters, kept, many = _normalised(_letters()[flat], lengths)
    windows = -(-kept // WINDOW)
    owner = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(owner)) - np.repeat(starts_of(windows), windows)
    begin = starts_of(kept)[owner] + nth * WINDOW
    size = np.minimum(kept[owner] - nth * WINDOW, WINDOW)
    out = np.zeros((len(model.languages), len(texts)), np.int64)
    for i, parser in enumerate(_parsers(model.key)):
        count = _window_phrases(parser, parser.symbol_of[letters], begin, size, nth > 0)
        out[i] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
    return out, kept, many


def predict_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a symbol of each text."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    count, kept, letters = phrases([t or "" for t in texts], model)
    cost = count * np.array([p.bits for p in _parsers(model.key)])[:, None] / np.maximum(kept, 1)
    best = np.argmin(cost, axis=0)
    cols = np.arange(len(texts))
    first = cost[best, cols]
    if len(model.languages) > 1:
        second = np.partition(cost, 1, axis=0)[1]
        score = second / np.maximum(first + second, 1e-300)
    else:
        score = np.ones(len(texts))
    known = letters > 0
    langs = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
    return langs, np.where(known, score, 0.0), np.where(known, first, 0.0)


def train(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", docs_per_language: int = 60, chars_per_language: int = 40_000) -> LanguageModel:
    """A model from a bounded sample: the ``docs_per_language`` distinct texts with a letter whose hashes are
    smallest, ``chars_per_language`` characters in equal shares of them.  Fewer texts than that: all of them.
    """
    usable = docs.where(learn & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("l"), F.xxhash64(F.lit(17), F.col(text)).alias("x"), F.col(text).alias("t"))
    hashed = F.pmod("x", F.lit(1 << 30))
    # Ranked within slices of the tasks and then over them, as every task leaves docs_per_language texts of a language.
    drawn = usable.select("l", "x").distinct().withColumn("slice", F.spark_partition_id() % 32)
    for keys in (["l", "slice"], ["l"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(hashed, "x"))
        drawn = drawn.withColumn("n", nth).where(F.col("n") <= docs_per_language).drop("n")
    drawn = drawn.select("l", "x").collect()
    if not drawn:
        return LanguageModel({})
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in drawn], "l string, x long")
    picked = usable.join(F.broadcast(wanted), ["l", "x"]).groupBy("l", "x").agg(F.min("t").alias("t"))  # copies merge before they travel
    by: dict[str, dict[str, int]] = {r["l"]: {} for r in drawn}
    for r in picked.select("l", "t", hashed.alias("h")).collect():
        by[r["l"]][r["t"]] = r["h"]
    samples = {}
    for lang, found in by.items():
        texts = sorted(found, key=lambda t: (found[t], t))[:docs_per_language]
        each = -(-chars_per_language // max(1, len(texts)))
        samples[lang] = " ".join(t[:each] for t in texts)
        spare = chars_per_language - len(samples[lang])
        for t in texts:  # short texts leave room for the rest of longer ones
            if spare <= 0:
                break
            samples[lang] += " " + t[each : each + spare]
            spare -= max(0, len(t) - each)
    return LanguageModel({k: v for k, v in samples.items() if any(c.isalpha() for c in v)})


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_symbol; columns of these names are replaced."""
    added = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_symbol", pa.float64())])
    base = docs.drop(*added.names)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("langid", _parsers.cache_clear)
        for whole in batches:
            texts = column(whole, text)
            for lo, hi in slices([len(t or "") for t in texts], BATCH_CHARS):
                langs, score, bits = predict_texts(texts[lo:hi], model)
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], names=[*names, *added.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(trimmed(run), f"{fields}, lang_pred string, score double, bits_per_symbol double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
