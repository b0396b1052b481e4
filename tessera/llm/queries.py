"""Registered queries of the corpus operators; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import block_knn, html_extract, iblt, language, near_dedup, packing, piece_bpe, quality, surrogates, warc
from tessera.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_main_text")
def op1_main_text(spark, d):
    out = html_extract.extract_main_text(table(spark, d, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The query's key; a user passes a secret of their own.
SURROGATE_KEY = "registered-query"


@query("op2_surrogates")
def op2_surrogates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return surrogates.replace_personal_data(docs, SURROGATE_KEY, count_col="n_entities")


@query("op3_iblt_fingerprint")
def op3_iblt_fingerprint(spark, d):
    return iblt.edit_report(table(spark, d, "documents"))


@query("op4_piece_bpe")
def op4_piece_bpe(spark, d):
    coded = piece_bpe.encode_decode(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_lsh_forest")
def op5_lsh_forest(spark, d):
    found = near_dedup.near_duplicates(table(spark, d, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), "kept")
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


@query("op6_block_knn")
def op6_block_knn(spark, d):
    return block_knn.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_attention_quality")
def op7_attention_quality(spark, d):
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_word_backoff_language")
def op8_word_backoff_language(spark, d):
    docs = table(spark, d, "documents")
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~quality.held_out()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op9_cost_packing")
def op9_cost_packing(spark, d):
    pieces = packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op10_arc_to_warc", """
WITH seen AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest,
                     max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS newest FROM pages),
     bits AS (SELECT *, array_to_string(list_transform(range(40), lambda i:
                right('0000' || bin(('0x' || substr(digest, i + 1, 1))::INT), 4)), '') AS b FROM seen)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
           + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM bits""")
def op10_arc_to_warc(spark, d):
    records = warc.archive(table(spark, d, "pages"))
    return records.select(
        F.col("key").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to",
    )
