"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Text becomes words that no piece can cross (a run of word marks and what follows it; line feeds
apart). The symbols of all new words lie in one flat array. A round finds each word's best pair rank by
a segmented minimum, merges all its leftmost non-overlapping pairs of that rank at once, and compacts
the array; rounds go on until no word has a pair. Where a merged piece could at once take part in a
better pair, only the leftmost pair of the word is merged, so the result is that of one merge at a time.

Words of more than ``LONG`` symbols take their minimum over a neighbourhood instead: what merges within one piece's length of a pair
can change it, and nothing further off, so a pair that is the best within two lengths of the longest piece on either side is merged at once. So rounds don't grow with the word.

Model: BPE with byte fallback, identity normalisation and a dummy prefix; another kind raises
ValueError. Defined results: null text is an empty text; an empty text has no ids and decodes to '';
characters outside the vocabulary become byte pieces; repeated rows give repeated results; very long texts and words are coded whole; an empty table gives an
empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import map_arrow

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
#: Words whose ids a task remembers; the memory is emptied when full.
CACHE_WORDS = 300_000
#: Symbols beyond which a word is merged by neighbourhoods.
LONG = 256
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """Vocabulary tables of one model: symbol ids, the rank and result of each mergeable pair."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a dummy prefix is needed")
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses the bounds of words")
        self.byte_id = np.zeros(256, np.int64)
        self.bytes = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
            elif p.type == 1:
                self.bytes[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == 2:
                self.bytes[i] = " ⁇ ".encode()
        # Symbols: every piece, and single characters that only stand inside longer pieces.
        self.symbol = {p: i for p, (i, _) in normal.items()}
        for p in normal:
            for c in p:
                self.symbol.setdefault(c, len(model.pieces) + len(self.symbol))
        self.size = max(self.symbol.values()) + 1 if self.symbol else 1
        self.spare = {i: p for p, i in self.symbol.items() if i >= len(model.pieces)}
        self.n_pieces = len(model.pieces)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        keys, ranks, made = [], [], []
        best = {}
        for p, (i, s) in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(order[s])
                    made.append(i)
                    for x in (a, b):
                        best[x] = min(best.get(x, _NONE), order[s])
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[at]
        self.ranks = np.array(ranks, np.int64)[at]
        self.made = np.array(made, np.int64)[at]
        self.reach = 2 * max(map(len, normal), default=1)
        # A merge is safe to repeat at once when its piece takes part in no pair of the same or a better rank.
        self.safe = np.ones(self.size, bool)
        for p, (i, s) in normal.items():
            self.safe[i] = best.get(i, _NONE) > order[s]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting piece of each adjacent pair (no pair: rank _NONE)."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), np.where(found, self.made[at], -1)

    def _leading(self, hit: np.ndarray, made: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Of pairs of one rank, those to merge at once; ``new`` marks the first of each word or neighbourhood."""
        # Of pairs that overlap in a row, every second one is merged, counted from the leftmost.
        chain = np.r_[True, hit[1:] != hit[:-1] + 1] | new
        index = np.arange(len(hit))
        take = (index - np.maximum.accumulate(np.where(chain, index, 0))) % 2 == 0
        # A merge that may lead to a better pair stands alone, and must be the leftmost.
        safe = self.safe[made[hit]]
        first_safe = np.repeat(safe[new], np.diff(np.r_[np.flatnonzero(new), len(hit)]))
        return hit[take & (new | (safe & first_safe))]

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """Merges of one long word, in rounds over neighbourhoods."""
        rank, made = np.full(len(sym), _NONE), np.full(len(sym), -1)
        rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
        while True:
            least, width = rank.copy(), 1  # the best rank of ``width`` pairs from each on
            while width < self.reach:
                step = min(width, self.reach - width)
                least[:-step] = np.minimum(least[:-step], least[step:])
                width += step
            before = np.full(len(rank), _NONE)  # and of as many pairs before each
            before[1:] = np.minimum.accumulate(rank)[:-1]
            if len(rank) > width:
                before[width:] = least[:-width]
            hit = np.flatnonzero((rank == least) & (rank <= before) & (rank != _NONE))
            if not len(hit):
                return sym
            # Pairs of one rank wait for those before them: a row of them begins where no equal one stands before.
            new = np.r_[True, np.diff(hit) > self.reach]
            opens = np.repeat(rank[hit[new]] < before[hit[new]], np.diff(np.r_[np.flatnonzero(new), len(hit)]))
            hit, new = hit[opens], new[opens]
            hit = self._leading(hit, made, new)
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, rank, made = sym[keep], rank[keep], made[keep]
            hit = place[hit]
            at = np.unique(np.concatenate([hit[hit > 0] - 1, hit]))
            rank[at[at == len(sym) - 1]] = _NONE
            at = at[at < len(sym) - 1]
            rank[at], made[at] = self._pairs(sym[at], sym[at + 1])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words in order, and the number of ids of each.

        Symbols outside the vocabulary are negative until the end: -1 - code point.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.of_char[points].astype(np.int64)
        unknown = np.flatnonzero(sym < 0)
        sym[unknown] = -1 - points[unknown].astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if (lengths > LONG).any():
            ends = np.cumsum(lengths)
            for i in np.flatnonzero(lengths > LONG).tolist():
                merged = self._merge_long(sym[ends[i] - lengths[i]:ends[i]].copy())
                done.append((np.full(len(merged), i), merged))
            short = np.repeat(lengths <= LONG, lengths)
            sym, word = sym[short], word[short]
        rank, made = np.full(len(sym), _NONE), np.full(len(sym), -1)
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at], made[at] = self._pairs(sym[at], sym[at + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            ready = least == _NONE
            if ready.any():  # words without a pair
                live = np.repeat(~ready, counts)
                done.append((word[~live], sym[~live]))
                sym, word, rank, made = sym[live], word[live], rank[live], made[live]
                least, counts = least[~ready], counts[~ready]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, counts))
            new_word = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = self._leading(hit, made, new_word)
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            hit = place[hit]
            touched = np.zeros(len(sym), bool)  # only pairs beside a merge differ
            touched[hit] = True
            touched[hit[hit > 0] - 1] = True
            changed = np.flatnonzero(touched)
            last = changed == len(sym) - 1
            inner = ~last
            inner[~last] = word[changed[~last]] == word[changed[~last] + 1]
            rank[changed[~inner]] = _NONE
            at = changed[inner]
            rank[at], made[at] = self._pairs(sym[at], sym[at + 1])
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        odd = (sym < 0) | (sym >= self.n_pieces)
        if odd.any():  # byte fallback
            parts = [self._fallback(int(s)) for s in sym[odd]]
            sizes = np.ones(len(sym), np.int64)
            sizes[odd] = [len(p) for p in parts]
            out = np.empty(sizes.sum(), np.int64)
            place = np.repeat(odd, sizes)
            out[~place] = sym[~odd]
            out[place] = np.concatenate(parts)
            sym, word = out, np.repeat(word, sizes)
        return sym.astype(np.int32), np.bincount(word, minlength=len(words))

    def _fallback(self, s: int) -> np.ndarray:
        char = chr(-1 - s) if s < 0 else self.spare[s]
        return self.byte_id[np.frombuffer(char.encode(), np.uint8)]

    def decode(self, ids) -> str:
        """Text of a list of ids: piece bytes in order, without the dummy prefix."""
        raw = b"".join([self.bytes[i] for i in ids])
        first = self.bytes[ids[0]] if len(ids) else b""
        return (raw[1:] if first[:1] == b" " and ids[0] >= 259 else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes texts with a bounded memory of words: their places in one flat array of ids."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.ids, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts in order, and the number of ids of each text."""
        if len(self.memory) > CACHE_WORDS:
            self.forget()
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        memory = self.memory
        new = list(set().union(*split).difference(memory)) if split else []
        if new:
            ids, counts = self.model.encode_words(new)
            memory.update(zip(new, range(len(memory), len(memory) + len(new))))
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(counts) - counts]
            self.length = np.r_[self.length, counts]
            self.ids = np.r_[self.ids, ids]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((memory[w] for ws in split for w in ws), np.int64, sizes.sum())
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(self.start[at] - ends + lengths, lengths)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        return flat, np.diff(bounds)


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``ids array<int>`` of each whole text, and ``decoded``, the text of those ids.

    ``model_path`` must be readable on the executors. No shuffle: rows are coded where they are read.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string"
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "encode" not in state:
            state["encode"] = Encoder(load(model_path))
        encode = state["encode"]
        flat, counts = encode(batch.column("_text").to_pylist())
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        decode, listed = encode.model.decode, flat.tolist()
        texts = [decode(listed[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column(key), ids, pa.array(texts, pa.string())], names=[key, "ids", "decoded"])

    return map_arrow(docs.select(key, F.col(text_col).alias("_text")), run, schema, "_text")
