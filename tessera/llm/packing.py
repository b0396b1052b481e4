"""Cost-balanced packing of tokenised documents into sequences.

Each task fills pools of about ``POOL_SEQUENCES`` sequences from the documents that it reads. The cost of
a piece is estimated as linear plus quadratic (attention) in its length. Pieces are assigned in
descending length, each to the sequence of the lowest cost among those with room; where none has room
the piece is cut at the room of the lowest-cost open sequence. A pool of n tokens has n // size full
sequences, and sequences of powers of two for the rest, so nothing is padded.

No shuffle: a sequence never spans tasks, and a lost task is computed again from its own input with the
same result. Defined results: null text is an empty text (only the end id); a document longer than a
sequence is cut, however long it is; repeated rows are packed each, and null keys stay null; of sequences of equal cost the first takes the piece, of
pieces of equal length the earlier document goes first; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import slices

#: Sequences in a pool: bounds a task's memory; pools don't depend on the size of the table.
POOL_SEQUENCES = 512
#: Words or chunks of text whose ids a Python worker remembers; the memory is emptied when full.
CACHE_CHUNKS = 200_000
#: Attention cost of a token pair against the linear cost of a token.
QUADRATIC = 1 / 1024


def plan(lengths: np.ndarray, size: int, quadratic: float = QUADRATIC) -> tuple[np.ndarray, ...]:
    """Pieces of documents in sequences: (document, start, length, sequence, offset) as arrays."""
    total = int(lengths.sum())
    rest = total % size
    room = np.array([size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []
    whole = 0
    tails = []
    for doc, n in enumerate(lengths.tolist()):
        full = n // size
        for k in range(full):  # these are the largest pieces, and each fills an empty sequence
            out.append((doc, k * size, size, whole, 0))
            room[whole] = 0
            whole += 1
        if n % size:
            tails.append((n % size, doc, full * size))
    cost[:whole] = np.inf
    tails.sort(key=lambda t: (-t[0], t[1]))
    for n, doc, start in tails:
        while n:
            fits = room >= n
            at = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            take = min(n, int(room[at]))
            out.append((doc, start, take, at, int(used[at])))
            room[at] -= take
            used[at] += take
            cost[at] += take + quadratic * take * take
            start, n = start + take, n - take
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(5))


#: Characters of the plain path: printable ASCII, its white space, and Latin letters that normalisation leaves alone.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u012f\u0131-\u024f]")
_OTHER_ASCII = re.compile("[^\t\n\r\x20-\x7e]")
#: The tokenizer's own words, for texts of the plain path (a fixed pattern); and the same for ASCII.
_WORD = re.compile(r"[^\W\d_]+|\d|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+")
_WORD_ASCII = re.compile(r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers words in the order in which they are first looked up; ``new`` lists those not encoded yet."""

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at


class ChunkTokenizer:
    """Exact ids of whole texts by a tokenizer of lower-case words that never hold white space.

    Texts of plain characters are cut into the tokenizer's words, and new words go through its model alone;
    other texts are cut at spaces and line feeds, and new chunks go through the whole tokenizer. Ids are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.forget()

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words of plain texts, by the model alone."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        mapped = [w if w.isascii() else "".join([letters[c] for c in w.encode().decode("latin-1")]) for w in words]
        return [[t.id for t in tokenize(w)] for w in mapped]

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    def _split(self, text: str | None) -> tuple[list[str], bool]:
        """Words of a plain text, or chunks of any other; and which they are."""
        if not text:
            return [], True
        low, plain = text.lower(), "<|" not in text
        if text.isascii():
            if plain and not _OTHER_ASCII.search(text):
                return _WORD_ASCII.findall(low), True
        elif plain and not _OTHER.search(text) and not _OTHER.search(low):
            return _WORD.findall(low), True
        return text.replace("\n", " ").split(" "), False

    def forget(self) -> None:
        self.memory = _Numbers({"": 0})
        self.ids, self.start, self.length = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts in order, and the number of ids of each."""
        if len(self.memory) > CACHE_CHUNKS:
            self.forget()
        memory, found, coded = self.memory, [], []
        for text in texts:
            parts, plain = self._split(text)
            memory.new = []
            found.append(np.fromiter(map(memory.__getitem__, parts), np.int64, len(parts)))
            if memory.new:
                coded += (self._encode_words if plain else self._encode_chunks)(memory.new)
        if coded:
            counts = np.fromiter(map(len, coded), np.int64, len(coded))
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(counts) - counts]
            self.length = np.r_[self.length, counts]
            self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(coded), np.uint32, int(counts.sum()))]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(self.start[at] - ends + lengths, lengths)]
        return flat, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(sizes)]])


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One for all tasks of a Python worker: what it remembers only saves time."""
    return ChunkTokenizer(path)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, key: str = "doc_id",
         text_col: str = "text", quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: key, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset."""
    schema = (f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, ids binary, "
              "doc_tokens long, sequence_id long, `offset` long")
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        keys, parts, counts, held = [], [], [], 0

        def emit():
            nonlocal keys, parts, counts, held, base
            ids, lengths = np.concatenate(parts), np.concatenate(counts)
            doc, start, length, sequence, offset = plan(lengths, size, quadratic)
            first = np.cumsum(lengths) - lengths
            raw = ids.astype("<u4").tobytes()
            begin = ((first[doc] + start) * 4).tolist()
            cut = [raw[b:b + 4 * n] for b, n in zip(begin, length.tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(cut, pa.binary()),
                 pa.array(lengths[doc]), pa.array(base + sequence), pa.array(offset)], names=names)
            base += int(sequence.max()) + 1
            keys, parts, counts, held = [], [], [], 0
            return out

        for batch in batches:
            for part in slices(batch, "_text"):
                flat, n = tokenizer(part.column("_text").to_pylist())
                ends = np.cumsum(n)
                ids = np.insert(flat, ends, end_id)
                keys.append(part.column(key))
                parts.append(ids)
                counts.append(n + 1)
                held += len(ids)
                if held >= POOL_SEQUENCES * size:
                    yield emit()
        if held:
            yield emit()

    return docs.select(key, F.col(text_col).alias("_text")).mapInArrow(run, schema)
