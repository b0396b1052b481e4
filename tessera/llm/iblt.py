"""Document fingerprints as invertible Bloom lookup tables over paragraphs.

A text is cut into paragraphs (lines; long lines at sentence ends, and those at a fixed width). Each
paragraph's 64-bit digest, made distinct for repetitions, enters three cells of a small table that holds
a count, the XOR of digests and the XOR of their checks. Tables subtract cell by cell; peeling cells that
hold one digest recovers the digests that differ, with the side they are on. Where a small table can't be
peeled, both sides are built anew in a table large enough for all their paragraphs, doubled until peeling ends.

All documents of a batch are built, subtracted and peeled together in flat numpy arrays.

Defined results: null text is an empty text, with the empty table; two empty texts have likeness 1;
equal texts have equal fingerprints; texts that differ by the order of their paragraphs alone have equal ones too; very long texts are read whole, their
stored tables are retried larger; rows that repeat a key, and null keys, are rows each (see ``with_next`` for their order); an empty table gives an empty table; other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.llm.common import map_arrow, materialise

#: Cells in each of the three parts of a stored table (a power of two).
WIDTH = 16
#: Characters of a paragraph piece at most.
PIECE = 96
_CUT = re.compile(r"\n|(?<=[.!?]) ")
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser; unsigned arithmetic wraps."""
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs in flat order of texts, and each one's text index (sorted)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        if not text:
            continue
        before = len(hashes)
        for p in _CUT.split(text):
            if len(p) <= PIECE:
                if p:
                    hashes.append(digest(p))
            else:
                hashes.extend([digest(p[k:k + PIECE]) for k in range(0, len(p), PIECE)])
        counts[i] = len(hashes) - before
    flat, owner = np.array(hashes, np.uint64), np.repeat(np.arange(len(texts)), counts)
    if len(flat):  # the n-th repetition of a paragraph counts as another paragraph
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        same = np.r_[False, (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])]
        at = np.arange(len(flat))
        nth = at - np.maximum.accumulate(np.where(same, 0, at))
        flat = _mix(flat + nth.astype(np.uint64) * np.uint64(_SALTS[1]), _SALTS[2])
    return flat, owner


class Tables:
    """Lookup tables of several owners side by side: owner i has 3 * width[i] cells from offset[i]."""

    def __init__(self, widths: np.ndarray):
        self.width = widths.astype(np.int64)
        ends = np.cumsum(3 * self.width)
        self.offset, n = ends - 3 * self.width, int(ends[-1]) if len(ends) else 0
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def cells(self, keys: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        width = self.width[owner]
        return [self.offset[owner] + j * width + (_mix(keys, salt) & (width - 1).astype(np.uint64)).astype(np.int64)
                for j, salt in enumerate(_SALTS)]

    def add(self, keys: np.ndarray, owner: np.ndarray, sign) -> None:
        check = _mix(keys, 0x27D4EB2F165667C5)
        for at in self.cells(keys, owner):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (keys, owners, signs), and whether each owner's table is empty in the end."""
        owner_of = np.repeat(np.arange(len(self.width)), 3 * self.width)
        keys, owners, signs = [], [], []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _mix(self.key[look], 0x27D4EB2F165667C5))]
            if not len(pure):
                break
            key, owner, sign = self.key[pure], owner_of[pure], self.count[pure]
            order = np.lexsort((key, owner))
            key, owner, sign = key[order], owner[order], sign[order]
            first = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
            key, owner, sign = key[first], owner[first], sign[first]
            self.add(key, owner, -sign)
            keys.append(key), owners.append(owner), signs.append(sign)
            look = np.unique(np.concatenate(self.cells(key, owner)))
        left = (self.count != 0) | (self.key != 0)
        clean = np.ones(len(self.width), bool)
        clean[owner_of[left]] = False
        if not keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), clean
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(signs), clean


def build(flat: np.ndarray, owner: np.ndarray, n: int, width: int = WIDTH) -> Tables:
    tables = Tables(np.full(n, width))
    tables.add(flat, owner, 1)
    return tables


def as_strings(tables: Tables) -> list[str]:
    """Printable tables of equal width."""
    n = len(tables.width)
    count, key, check = (x.reshape(n, -1) for x in (tables.count.astype("<i4"), tables.key.astype("<u8"), tables.check.astype("<u8")))
    return [base64.b64encode(count[i].tobytes() + key[i].tobytes() + check[i].tobytes()).decode() for i in range(n)]


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tables_a: Tables, tables_b: Tables,
               n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What differs between versions a and b of n documents: digests, documents, signs (1: in a alone), and for each
    document whether its stored tables were too small and larger ones were built."""
    tables = Tables(tables_a.width)
    tables.count, tables.key, tables.check = tables_a.count - tables_b.count, tables_a.key ^ tables_b.key, tables_a.check ^ tables_b.check
    key, owner, sign, clean = tables.peel()
    retried = ~clean
    found = [(k[clean[o]], o[clean[o]], s[clean[o]]) for k, o, s in [(key, owner, sign)]]
    todo = np.flatnonzero(~clean)
    size = np.bincount(a[1], minlength=n) + np.bincount(b[1], minlength=n)
    factor = 1
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        need = np.maximum(2, factor * (size[todo] * 3 // 5 + 2))
        tables = Tables(1 << np.ceil(np.log2(need)).astype(np.int64))
        for (flat, own), s in ((a, 1), (b, -1)):
            mine = place[own] >= 0
            tables.add(flat[mine], place[own[mine]], s)
        key, owner, sign, clean = tables.peel()
        good = clean[owner]
        found.append((key[good], todo[owner[good]], sign[good]))
        todo, factor = todo[~clean], factor * 2
    return tuple(np.concatenate(x) for x in zip(*found)) + (retried,)


def likeness(n_a: np.ndarray, n_b: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Shared paragraphs over all paragraphs of both, from the number that differ."""
    both = n_a + n_b
    return np.where(both > 0, (both - differing) / np.maximum(both + differing, 1), 1.0)


def fingerprints(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``n_paragraphs`` and ``fingerprint`` of each whole text."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_paragraphs long, fingerprint string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("_text").to_pylist()
        flat, owner = digests(texts)
        prints = as_strings(build(flat, owner, len(texts)))
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(np.bincount(owner, minlength=len(texts))), pa.array(prints, pa.string())],
            names=[key, "n_paragraphs", "fingerprint"])

    return map_arrow(docs.select(key, F.col(text_col).alias("_text")), run, schema, "_text")


def compare_versions(pairs: DataFrame, old: str, new: str, key: str = "doc_id") -> DataFrame:
    """For each row with an old and a new text: likeness, the paragraph digests removed and added, and whether the
    stored tables had to be retried larger."""
    schema = f"`{key}` {pairs.schema[key].dataType.simpleString()}, likeness double, removed array<long>, added array<long>, retried boolean"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = digests(batch.column("_old").to_pylist()), digests(batch.column("_new").to_pylist())
        n = batch.num_rows
        keys, owner, sign, retried = difference(a, b, build(*a, n), build(*b, n), n)
        like = likeness(np.bincount(a[1], minlength=n), np.bincount(b[1], minlength=n), np.bincount(owner, minlength=n))
        lists = []
        for side in (1, -1):
            order = np.argsort(owner[sign == side], kind="stable")
            counts = np.bincount(owner[sign == side], minlength=n)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(keys[sign == side][order].view(np.int64))))
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(like), *lists, pa.array(retried)],
                                          names=[key, "likeness", "removed", "added", "retried"])

    rows = pairs.select(key, F.coalesce(old, F.lit("")).alias("_old"), F.coalesce(new, F.lit("")).alias("_new"))
    return map_arrow(rows, run, schema, "_old")


def with_next(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with ``next_text``, the text of the next row by descending key (after the last: of the first); the key is a number.

    Rows are dealt to key ranges, and each range also gets the first row of the range after it, so texts are
    shuffled once and no window spans the table. Ties of the key are ordered by a hash of the text, then by text; null keys come last. A key that holds
    more rows than a range should, and the null keys, are cut into ranges by that hash.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(key, F.coalesce(text_col, F.lit("")).alias("text"), F.col(key).cast("double").alias("_k")).withColumn("_h", F.xxhash64("text"))
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("_k").isNull()).alias("nulls")).first()
    found = rows.where(F.col("_k").isNotNull()).approxQuantile("_k", [i / n for i in range(1, n)], 1 / (4 * n))
    times = Counter(c for c in found if abs(c) != float("inf"))  # a key that comes up m times holds about m ranges' rows
    cuts = sorted(set(times) | {math.nextafter(c, math.inf) for c, m in times.items() if m > 1}) or [0.0]
    parts = [1] + [times.get(c, 1) for c in cuts] + [max(1, -(-total["nulls"] * n // max(1, total["n"])))]  # of each range, the nulls' last
    order = [*range(len(cuts), -1, -1), len(cuts) + 1]
    first = [0] * len(parts)
    for before, r in zip(order, order[1:]):
        first[r] = first[before] + parts[before]
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_k", outputCol="_range", handleInvalid="keep")
    keyed = cut.transform(rows).withColumn("_range", F.when(F.col("_k").isNull(), len(cuts) + 1).otherwise(F.col("_range").cast("int")) + 1)
    of_range = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_range"))
    part = F.floor((F.col("_h") / 2.0 ** 64 + 0.5) * of_range(parts)).cast("int")
    keyed = keyed.withColumn("_r", of_range(first) + F.least(part, of_range(parts) - 1)).select(key, "text", "_h", "_r")

    # The row that heads each range (one text for each) also ends the range before.
    heads = keyed.groupBy("_r").agg(F.max_by(F.struct(key, "text", "_h"), F.struct(key, F.bitwise_not("_h"))).alias("e"))
    heads = materialise(heads.select(F.col(f"e.{key}").alias(key), "e.text", "e._h", "_r"), "heads")
    ranges = W.orderBy("_r").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag("_r").over(W.orderBy("_r")), F.last("_r").over(ranges))
    dealt = keyed.withColumn("_borrowed", F.lit(0)).union(heads.select(key, "text", "_h", before.alias("_r"), F.lit(1)))
    order = W.partitionBy("_r").orderBy("_borrowed", F.col(key).desc_nulls_last(), "_h", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("_borrowed = 0").select(key, "text", "next_text")


def edit_report(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (the second half replaced from the next text), with the
    likeness of the first to the edited and to the next text's."""
    schema = (f"`{key}` {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, nexts = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
        edited = [t[:len(t) - len(t) // 2] + x[:len(t) // 2] for t, x in zip(texts, nexts)]
        n = len(texts)
        a, b, c = digests(texts), digests(edited), digests(nexts)
        ta, tb, tc = build(*a, n), build(*b, n), build(*c, n)
        na, nb, nc = (np.bincount(x[1], minlength=n) for x in (a, b, c))
        near = [likeness(na, m, np.bincount(difference(a, x, ta, t, n)[1], minlength=n)) for x, t, m in ((b, tb, nb), (c, tc, nc))]
        sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(as_strings(ta)), pa.array(as_strings(tb)),
             pa.array(near[0]), pa.array(near[1])], names=names)

    return map_arrow(with_next(docs, key, text_col), run, schema, "text")
