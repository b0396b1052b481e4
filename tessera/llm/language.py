"""Language identification: words first, backing off to shorter character n-grams.

The model is fitted on a sample of the labelled texts of at most ``TRAIN_CHARS`` characters in expectation, shared equally by
the languages and chosen by a hash of the text (copies teach once; each language keeps one text at least). Of that sample every language,
word and n-gram is learned. A known word scores the log of its smoothed relative frequency in each language; an unseen
word scores the mean of its known character n-grams of the longest length (4 down to 1) that has any. A text's score is the softmax
of its words' mean score, sharpened by the number of words up to ``EVIDENCE``.

Scores are kept sparse: each table has one vector of languages for what is absent, and each key the languages that have it. So the model grows
with the sample, not with words times languages.

Defined results: ``und`` with score 0 for null text and text without letters (and for every text if nothing is learned); a text with letters
of which no n-gram is known gets the language with the most words, with score 1 / languages; ties go to the language first in order; runs of
more than ``RUN`` letters are taken as several words, so very long texts without spaces are scored whole; repeated rows get equal results; a null
key is not held out and, as its fold is unknown, never learned from; an empty table gives an empty table; existing columns called like the new ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import map_arrow, materialise, slices, without

#: Characters of labelled text that a model is fitted on, in expectation and over all languages.
TRAIN_CHARS = 6_000_000
#: Letters of a word at most.
RUN = 64
#: Counted words whose n-grams are listed at once.
PART = 40_000
#: Entries of a task's counters before they are passed on; words whose scores a task remembers, and numbers in all.
FLUSH, CACHE, CACHE_CELLS = 100_000, 120_000, 1_000_000
#: Words beyond which more evidence doesn't sharpen the score.
EVIDENCE = 20
UNKNOWN = "und"
_WORD = re.compile(rf"[^\W\d_]{{1,{RUN}}}")
#: Numerals like ½ that patterns count among letters; and a wider, quicker class that tells which texts may have some.
_NUMERALS = "".join(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_NUMERAL = re.compile(f"[{_NUMERALS}]")
_MAYBE = re.compile(f"[{''.join(c for c in _NUMERALS if c < chr(256))}{min(c for c in _NUMERALS if c >= chr(256))}-{chr(0x10ffff)}]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    text = text.lower()
    return _WORD.findall(_NUMERAL.sub(" ", text) if not text.isascii() and _MAYBE.search(text) else text)


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, k, n``: occurrences of each word, counted in the tasks before the shuffle."""

    def emit(counters):
        langs = [lang for lang, c in counters.items() for _ in range(len(c))]
        keys, counts = [k for c in counters.values() for k in c], [n for c in counters.values() for n in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["lang", "k", "n"])

    def run(batches):
        counters: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch, "_text"):
                for lang, text in zip(part.column("_lang").to_pylist(), part.column("_text").to_pylist()):
                    counters[lang].update(words_of(text))
                if sum(map(len, counters.values())) > FLUSH:
                    yield emit(counters)
                    counters.clear()
        if counters:
            yield emit(counters)

    rows = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, k string, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", chars: int = TRAIN_CHARS) -> DataFrame:
    """Distinct ``lang, text`` of about ``chars`` characters, an equal share for each language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang", "h").agg(F.max(F.char_length("text")).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.min("h").alias("least"))
    sizes = materialise(sizes, "language-sizes")  # a row for each language
    share = chars / max(1, sizes.count())
    chosen = rows.join(sizes, "lang").where((F.pmod("h", F.lit(1 << 30)) / (1 << 30) < share / F.col("n")) | (F.col("h") == F.col("least")))
    return chosen.select("lang", "text").distinct()


def _grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' character n-grams, and the word of each; word ends are marked but for single characters."""
    marked = words if n == 1 else [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    m = max(0, len(points) - n + 1)
    h = points[:m].copy()
    for k in range(1, n):
        h = h * _STEP + points[k:m + k]
    inside = owner[:m] == owner[n - 1:n - 1 + m]
    return h[inside], owner[:m][inside]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of ranges of an array, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


def _sum_by(key: np.ndarray, lang: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and languages with the sum of their numbers, each pair once."""
    order = np.lexsort((lang, key))
    key, lang, n = key[order], lang[order], n[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])]) if len(key) else np.empty(0, np.int64)
    return key[new], lang[new], np.add.reduceat(n, new) if len(new) else n


class Table:
    """Counts of one kind of key by language, sparse: what a key adds to the score of an absent one, where it occurs."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        """``keys`` are numbers; a key and language occur once."""
        order = np.lexsort((lang, keys))
        keys, self.lang, n = keys[order], lang[order].astype(np.int32), n[order]
        self.keys, self.start, self.length = np.unique(keys, return_index=True, return_counts=True)
        totals = np.bincount(self.lang, n, langs).astype(float)  # counts are whole if there are none
        self.absent = np.log(0.5 / (totals + 0.5 * (len(self.keys) + 1)))
        self.adds = np.log((n + 0.5) / 0.5)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Model:
    """Tables 0 for words and 1 to 4 for n-grams; ``langs`` in order."""

    def __init__(self, lang, words, n):
        """Counted words: language, word and number, each pair of the first two once (sequences or Arrow columns)."""
        lang, words = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x, pa.string()) for x in (lang, words))
        coded, found = lang.dictionary_encode(), words.dictionary_encode()
        self.langs = sorted(coded.dictionary.to_pylist())
        place = np.array([self.langs.index(x) for x in coded.dictionary.to_pylist()], np.int64)
        lang, n = place[coded.indices.to_numpy()], np.asarray(n, np.int64)
        self.word = {w: i for i, w in enumerate(found.dictionary.to_pylist())}
        self.tables = [Table(found.indices.to_numpy().astype(np.int64), lang, n, len(self.langs))]
        for size in (1, 2, 3, 4):
            parts = [_sum_by(h, lang[k:k + PART][owner], n[k:k + PART][owner]) for k in range(0, len(words), PART)
                     for h, owner in [_grams(words[k:k + PART].to_pylist(), size)]]
            empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
            self.tables.append(Table(*_sum_by(*(np.concatenate(c) for c in zip(empty, *parts))), len(self.langs)))
        self.absent = np.stack([t.absent for t in self.tables])
        words_by_lang = np.bincount(lang, n, len(self.langs)) if self.langs else np.empty(0)
        self.first = self.langs[int(words_by_lang.argmax())] if self.langs else UNKNOWN

    def rows(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of each word the table that tells of it (-1: none) and the number of its entries; then all entries' languages and values."""
        kind = np.full(len(words), -1)
        at = np.fromiter((self.word.get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(at >= 0)
        kind[known] = 0
        t = self.tables[0]
        flat = _ranges(t.start[at[known]], t.length[at[known]])
        found = [(np.repeat(known, t.length[at[known]]), t.lang[flat], t.adds[flat])]
        left = np.flatnonzero(at < 0)
        for n in (4, 3, 2, 1):
            if not len(left):
                break
            t = self.tables[n]
            h, owner = _grams([words[i] for i in left.tolist()], n)
            place = t.find(h)
            owner, place = owner[place >= 0], place[place >= 0]
            sizes = np.bincount(owner, minlength=len(left))
            flat, who = _ranges(t.start[place], t.length[place]), np.repeat(owner, t.length[place])
            cell, back = np.unique(who * len(self.langs) + t.lang[flat], return_inverse=True)  # one entry for each word and language
            who, lang = cell // max(1, len(self.langs)), cell % max(1, len(self.langs))
            found.append((left[who], lang.astype(np.int32), np.bincount(back, t.adds[flat], len(cell)) / sizes[who]))
            kind[left[sizes > 0]] = n
            left = left[sizes == 0]
        owner, lang, value = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        return kind, np.bincount(owner, minlength=len(words)), lang[order], value[order]

    def predict(self, texts: list[str | None], memory: dict) -> tuple[list[str], np.ndarray]:
        """Languages and scores; ``memory`` keeps words' entries between calls, up to a bound."""
        n, width = len(texts), len(self.langs)
        if not width:
            return [UNKNOWN] * n, np.zeros(n)
        if not memory or len(memory["at"]) > CACHE or len(memory["lang"]) > CACHE_CELLS:
            memory.update(at={}, kind=np.empty(0, np.int64), start=np.empty(0, np.int64), length=np.empty(0, np.int64),
                          lang=np.empty(0, np.int32), value=np.empty(0))
        split = [words_of(t) for t in texts]
        at = memory["at"]
        new = list(set().union(*split).difference(at))
        if new:
            at.update(zip(new, range(len(at), len(at) + len(new))))
            kind, length, lang, value = self.rows(new)
            memory["start"] = np.r_[memory["start"], len(memory["lang"]) + np.cumsum(length) - length]
            for name, part in (("kind", kind), ("length", length), ("lang", lang), ("value", value)):
                memory[name] = np.concatenate((memory[name], part))
        sizes = np.fromiter(map(len, split), np.int64, n)
        flat = np.fromiter((at[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(n), sizes)
        told = memory["kind"][flat] >= 0
        flat, owner = flat[told], owner[told]
        kinds = len(self.tables)
        count = np.bincount(owner * kinds + memory["kind"][flat], minlength=n * kinds).reshape(n, kinds)
        length = memory["length"][flat]
        entry = _ranges(memory["start"][flat], length)
        cells = np.repeat(owner, length) * width + memory["lang"][entry]
        total = count @ self.absent + np.bincount(cells, memory["value"][entry], n * width).reshape(n, width)
        count = count.sum(axis=1)
        total *= (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None]
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [self.langs[b] if c else self.first if s else UNKNOWN for b, c, s in zip(best.tolist(), count.tolist(), sizes.tolist())]
        return langs, np.where(count > 0, share, np.where(sizes > 0, 1 / width, 0.0))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", chars: int = TRAIN_CHARS) -> Model:
    """Learns from a sample of the rows of ``docs`` that have a language; see ``sample``."""
    counts = count_words(sample(docs, text_col, lang_col, chars)).toArrow()  # bounded by the sample
    return Model(counts.column("lang"), counts.column("k"), counts.column("n"))


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score for each whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in without(docs, pred_col) if c in without(docs, score_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{pred_col}` string, `{score_col}` double"
    memory: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = shared.value.predict(batch.column("_text").to_pylist(), memory)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, pred_col, score_col])

    return map_arrow(docs.select(*kept, F.col(text_col).alias("_text")), run, schema, "_text", max_bytes=1 << 20)
