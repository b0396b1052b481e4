"""Scalar functions over the tables: text, dates, numbers, lists, structs, maps, digests, and user-defined ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.plans.register import Group
from tessera.session import table

QUERIES = Group()
query, sql = QUERIES.query, QUERIES.sql

sql("text_functions", """
SELECT p_partkey, lower(p_name) AS lo, upper(p_type) AS up, substring(p_name, 3, 4) AS sub, char_length(p_name) AS len, octet_length(p_name) AS bytes,
       contains(p_name, '1') AS has1, startswith(p_type, 'P') AS p, endswith(p_brand, '3') AS e3, replace(p_brand, '#', '-') AS rep,
       concat_ws('/', p_brand, NULL, p_type) AS cw, reverse(p_brand) AS rev, lpad(CAST(p_size AS STRING), 4, '0') AS pad FROM part""",
    """SELECT p_partkey, lower(p_name) AS lo, upper(p_type) AS up, substring(p_name, 3, 4) AS sub, length(p_name)::INT AS len, strlen(p_name)::INT AS bytes,
       contains(p_name, '1') AS has1, starts_with(p_type, 'P') AS p, suffix(p_brand, '3') AS e3, replace(p_brand, '#', '-') AS rep,
       concat_ws('/', p_brand, NULL, p_type) AS cw, reverse(p_brand) AS rev, lpad(p_size::VARCHAR, 4, '0') AS pad FROM part""")
sql("regex_functions", r"""
SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS d, array_join(regexp_extract_all(c_mktsegment, '([A-C])', 1), '') AS letters,
       array_join(split(c_mktsegment, 'E'), '|') AS parts FROM customer""",
    r"""SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS d, array_to_string(regexp_extract_all(c_mktsegment, '([A-C])', 1), '') AS letters,
       array_to_string(string_split(c_mktsegment, 'E'), '|') AS parts FROM customer""")
sql("digests", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s256, sha1(text) AS s1 FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s256, sha1(text) AS s1 FROM documents")
sql("date_parts", """
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, weekday(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy,
       date_trunc('MONTH', o_orderdate) AS month_start, date_format(o_orderdate, 'yyyy/MM/dd') AS text, datediff(o_orderdate, timestamp_ntz'1995-01-01') AS days, o_orderdate + INTERVAL 3 DAYS AS later FROM orders""",
    """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, (isodow(o_orderdate) - 1)::INT AS dow, dayofyear(o_orderdate)::INT AS doy,
       date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, strftime(o_orderdate, '%Y/%m/%d') AS text, datediff('day', TIMESTAMP '1995-01-01', o_orderdate)::INT AS days, o_orderdate + INTERVAL 3 DAYS AS later FROM orders""")
sql("arithmetic", """
SELECT l_orderkey, l_linenumber, round(abs(l_quantity - 25), 2) AS a, CAST(l_partkey % 7 AS BIGINT) AS m, CAST(l_partkey div 7 AS BIGINT) AS q, CAST(ceil(l_tax * 100) AS BIGINT) AS c,
       round(sqrt(l_quantity), 6) AS s, round(ln(l_extendedprice), 6) AS ln, round(power(l_discount, 2), 8) AS p, sign(l_quantity - 25) AS sg, greatest(l_tax, l_discount) AS g, try_divide(1.0D, l_discount) AS inv FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, round(abs(l_quantity - 25), 2) AS a, (l_partkey % 7)::BIGINT AS m, (l_partkey // 7)::BIGINT AS q, ceil(l_tax * 100)::BIGINT AS c,
       round(sqrt(l_quantity), 6) AS s, round(ln(l_extendedprice), 6) AS ln, round(power(l_discount, 2), 8) AS p, sign(l_quantity - 25)::DOUBLE AS sg, greatest(l_tax, l_discount) AS g, CASE WHEN l_discount <> 0 THEN 1.0::DOUBLE / l_discount END AS inv FROM lineitem""")
sql("lists_and_lambdas", """
SELECT item_id, size(w) AS n, array_contains(w, 'the') AS has, CAST(array_position(w, 'the') AS BIGINT) AS pos, try_element_at(w, 2) AS second, array_join(slice(w, 2, 2), ' ') AS cut,
       array_join(transform(filter(w, x -> length(x) > 6), x -> reverse(x)), ',') AS long_words, aggregate(w, 0, (a, x) -> a + length(x)) AS chars, array_join(array_sort(array_distinct(w)), ' ') AS uniq
FROM (SELECT item_id, split(text, ' ') AS w FROM benchmark) t""",
    """SELECT item_id, len(w)::INT AS n, list_contains(w, 'the') AS has, coalesce(list_position(w, 'the'), 0)::BIGINT AS pos, w[2] AS second, array_to_string(w[2:3], ' ') AS cut,
       array_to_string(list_transform(list_filter(w, lambda x: length(x) > 6), lambda x: reverse(x)), ',') AS long_words, list_sum(list_transform(w, lambda x: length(x)))::INT AS chars,
       array_to_string(list_sort(list_distinct(w)), ' ') AS uniq FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) t""")
sql("structs_and_maps", """
SELECT s_suppkey, st.name AS name, st.pos.bal AS bal, element_at(m, 'k') AS k, map_contains_key(m, 'z') AS z, CAST(size(m) AS BIGINT) AS n
FROM (SELECT s_suppkey, named_struct('name', s_name, 'pos', named_struct('bal', s_acctbal)) AS st, map('k', s_nationkey, 'l', s_nationkey + 1) AS m FROM supplier) t""",
    """SELECT s_suppkey, st.name AS name, st.pos.bal AS bal, m['k'] AS k, map_contains(m, 'z') AS z, cardinality(m)::BIGINT AS n
FROM (SELECT s_suppkey, {'name': s_name, 'pos': {'bal': s_acctbal}} AS st, MAP {'k': s_nationkey, 'l': s_nationkey + 1} AS m FROM supplier) t""")
sql("json_build", "SELECT s_suppkey, to_json(named_struct('id', s_suppkey, 'n', s_nationkey)) AS j FROM supplier", """SELECT s_suppkey, '{"id":' || s_suppkey || ',"n":' || s_nationkey || '}' AS j FROM supplier""")
sql("series", "SELECT id AS n FROM range(10, 50, 3)", "SELECT range AS n FROM range(10, 50, 3)")

HOLIDAYS = ("1996-12-25", "1997-01-01", "1997-07-04")
_OFF = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


@query("business_days", f"""
SELECT o_orderkey, (SELECT count(*) FROM range(datediff('day', DATE '1996-12-01', o_orderdate::DATE)) t(i) WHERE isodow(DATE '1996-12-01' + i::INT) < 6 AND (DATE '1996-12-01' + i::INT) NOT IN ({_OFF}))::INT AS n
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-12-01'
UNION ALL SELECT o_orderkey, -(SELECT count(*) FROM range(datediff('day', o_orderdate::DATE, DATE '1996-12-01')) t(i) WHERE isodow(o_orderdate::DATE + i::INT) < 6 AND (o_orderdate::DATE + i::INT) NOT IN ({_OFF}))::INT AS n
FROM orders WHERE o_orderdate < TIMESTAMP '1996-12-01'""")
def business_days(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalars.business_days_between(F.to_date(F.lit("1996-12-01")), F.to_date("o_orderdate"), HOLIDAYS).alias("n"))


@query("add_business_days", f"""
SELECT o_orderkey, (SELECT x FROM (SELECT (o_orderdate::DATE + i::INT) AS x, row_number() OVER (ORDER BY i) AS r FROM range(40) t(i)
  WHERE isodow(o_orderdate::DATE + i::INT) < 6 AND (o_orderdate::DATE + i::INT) NOT IN ({_OFF})) WHERE r = 8) AS due FROM orders""")
def add_business_days(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalars.add_business_days(F.to_date("o_orderdate"), 7, HOLIDAYS).alias("due"))


@query("format_parse", "SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS f, strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') AS day FROM events")
def format_parse(spark, d):
    e = table(spark, d, "events")
    back = scalars.strptime(scalars.strftime(F.col("ts"), "%Y%m%d"), "%Y%m%d").cast("timestamp_ntz")
    return e.select("event_id", scalars.strftime(F.col("ts"), "%d.%m.%Y %H:%M").alias("f"), back.alias("day"))


@query("unicode_normalise", "SELECT doc_id, strip_accents(text) AS plain, nfc_normalize(text) AS nfc, length_grapheme(text)::INT AS g FROM documents")
def unicode_normalise(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", scalars.strip_accents("text").alias("plain"), scalars.nfc_normalize("text").alias("nfc"), scalars.grapheme_length("text").alias("g"))


@query("list_helpers", "SELECT item_id, array_to_string(list_select(w, [3, 1]), ' ') AS s, array_to_string(list_resize(w[1:2], 3, 'x'), ' ') AS r FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def list_helpers(spark, d):
    w = F.split("text", " ")
    return table(spark, d, "benchmark").select("item_id", F.array_join(scalars.list_select(w, F.array(F.lit(3), F.lit(1))), " ").alias("s"),
                                               F.array_join(scalars.list_resize(F.slice(w, 1, 2), 3, F.lit("x")), " ").alias("r"))


@query("udf_vectorised", "SELECT event_id, round(value * 2 + 1, 6) AS y FROM events")
def udf_vectorised(spark, d):
    @F.pandas_udf("double")
    def twice(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return table(spark, d, "events").select("event_id", F.round(twice("value"), 6).alias("y"))


@query("udaf_grouped", "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def udaf_grouped(spark, d):
    # A reduction with a partial step: extremes per task, then their difference.
    rows = table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("a"), F.min("value").alias("b"))
    return rows.select("event_type", F.round(F.col("a") - F.col("b"), 6).alias("spread"))


@query("udtf_split", "SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark")
def udtf_split(spark, d):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in text.split(" "):
                yield (w,)

    spark.udtf.register("tessera_words", Words)
    table(spark, d, "benchmark").createOrReplaceTempView("benchmark")
    return spark.sql("SELECT item_id, word FROM benchmark, LATERAL tessera_words(text)")
