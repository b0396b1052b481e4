"""Each stage of the pipeline, and the whole run, against plain Python on small tables."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
from tessera.llm import language, packing, quality, surrogates  # noqa: E402
from tests.llm.test_corpus_operators import _components  # noqa: E402

GIVEN = "/root/testdata/sf0.001"
ODD = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n ", None, "s", 3), (None, "mail to a.b@c.example.com now", "en", None, 29), (None, None, None, None, None),
       (9004, "twice the same row", "en", "s", 18), (9004, "twice the same row", "en", "s", 18), (9005, "12345 !!", "en", "s", 8), (9006, "a very long text without an end " * 4000, "en", "s", None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The given documents with odd rows, repeated ids, and columns whose names clash with those of the operators."""
    given = spark.read.parquet(f"{GIVEN}/documents.parquet")
    rows = given.union(spark.createDataFrame(ODD, given.schema))
    extra = given.limit(3).withColumn("text", F.concat(F.lit("Another text of the same id. "), F.reverse("text")))
    rows = rows.union(extra)
    for name in ("score", "_quality", "kept", "moved", "ids", "lang_pred"):
        rows = rows.withColumn(name, F.lit("clash"))
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _rows(df, *drop):
    return Counter(tuple(r) for r in df.select([c for c in df.columns if c not in drop]).collect())


def _empty_stage(stage, docs, spark):
    out = stage(spark, docs.where("false"), GIVEN)
    assert out.count() == 0
    return out


def test_quality_stage(spark, docs):
    out = corpus_pipeline.quality_stage(spark, docs, GIVEN)
    model = quality.fit(docs, spark.read.parquet(f"{GIVEN}/labels.parquet"))
    want = Counter()
    for r in docs.collect():
        x, n = quality.encode([quality.passages(r.text)])
        if model.score(x, n)[0] >= corpus_pipeline.LEAST_QUALITY:
            want[tuple(r)] += 1
    assert out.columns == docs.columns and _rows(out) == want and 0 < want.total() < docs.count()
    _empty_stage(corpus_pipeline.quality_stage, docs, spark)


def test_language_stage(spark, docs):
    out = corpus_pipeline.language_stage(spark, docs, GIVEN)
    rows = docs.collect()
    known = {(r.lang, r.text) for r in rows if r.doc_id is not None and r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    counts = Counter((lang, w) for lang, text in known for w in language.words_of(text))
    model = language.Model(*zip(*sorted((*k, n) for k, n in counts.items())))
    want = Counter()
    for r in rows:
        (lang,), (score,) = model.predict([r.text], {})
        if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE:
            want[tuple(r)] += 1
    assert out.columns == docs.columns and _rows(out) == want and {r.doc_id for r in out.collect()}.isdisjoint({9001, 9002, 9003, 9005})
    assert _empty_stage(corpus_pipeline.language_stage, docs, spark).columns == docs.columns


def test_near_duplicates_stage(spark, docs):
    out = corpus_pipeline.near_duplicates_stage(spark, docs, GIVEN)
    distinct = {(r.doc_id, r.text) for r in docs.collect()}
    order = sorted(distinct, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    found = _components(dict(enumerate(t for _, t in order)))
    groups = defaultdict(set)
    for i, c in found.items():
        groups[c].add(order[i])
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == docs.columns and max(kept.values()) == 1 and len(kept) == len(groups)
    for members in groups.values():
        (one,) = members & set(kept)
        assert one[0] == min((i for i, _ in members if i is not None), default=None)
    assert len(groups) < len(distinct)
    _empty_stage(corpus_pipeline.near_duplicates_stage, docs, spark)


def test_personal_data_stage(spark, docs):
    out = corpus_pipeline.personal_data_stage(spark, docs, GIVEN)
    assert out.columns == docs.columns and _rows(out, "text", "n_chars") == _rows(docs, "text", "n_chars")
    found = {r.x for r in docs.select(F.explode(surrogates._entities(F.col("text"))).alias("e")).select("e.*").where("kind <> 'number'").collect()}
    after = {r.x for r in out.select(F.explode(surrogates._entities(F.col("text"))).alias("e")).select("e.*").where("kind <> 'number'").collect()}
    assert found and not found & after and len(found) == len(after)
    assert all((r.n_chars == len(r.text)) if r.text is not None else r.n_chars is None for r in out.collect())
    clean = {r.text for r in docs.where(F.size(surrogates._entities(F.col("text"))).isin(0, -1) | F.col("text").isNull()).collect()}
    assert clean <= {r.text for r in out.collect()}
    _empty_stage(corpus_pipeline.personal_data_stage, docs, spark)


def _check_packed(pieces, texts):
    """Every token of every text lies in one piece; sequences are gapless and full, or a power of two long."""
    tokenizer = packing.ChunkTokenizer(P.path("word_bpe_49k.json"))
    want, got, sequences = Counter(), Counter(), defaultdict(list)
    for key, text in texts:
        want[key] += int(tokenizer([text])[1][0]) + 1
    for r in pieces:
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0 and end < 2048


def test_packing_stage(spark, docs):
    out = corpus_pipeline.packing_stage(spark, docs, GIVEN)
    _check_packed(out.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    _empty_stage(corpus_pipeline.packing_stage, docs, spark)


def test_run(spark, docs, tmp_path):
    """The run equals its stages one after the other, each on what its predecessor kept."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{GIVEN}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    kept, last = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        assert kept.count() <= last
        last = kept.count()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _check_packed(out, [(r.doc_id, r.text) for r in kept.collect()])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language id", "near duplicates", "personal data", "packing"]
