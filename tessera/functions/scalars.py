"""Scalar functions beyond Spark's own: business days, text normalisation, list and term helpers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F, types as T


def _dates(holidays: Sequence[str]) -> Column:
    return F.array(*[F.to_date(F.lit(h)) for h in holidays]) if holidays else F.expr("CAST(array() AS array<date>)")


def business_days_between(start: Column, end: Column, holidays: Sequence[str] = ()) -> Column:
    """Weekdays in [start, end) that are no holidays; negative where the end comes first. Counted from whole weeks, without
    listing the days."""
    a, b = F.least(start, end).cast("date"), F.greatest(start, end).cast("date")
    days = lambda d: F.unix_date(d) + 3  # days since Monday 1969-12-29
    upto = lambda n: F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    off = F.size(F.filter(_dates(holidays), lambda h: (h >= a) & (h < b) & (F.weekday(h) < 5)))
    n = upto(days(b)) - upto(days(a)) - off
    return F.when(start <= end, n).otherwise(-n).cast("int")


def add_business_days(start: Column, days: Column | int, holidays: Sequence[str] = ()) -> Column:
    """The date ``days`` business days after (before, if negative) a date; a start off business first moves forward."""
    days = F.lit(days) if isinstance(days, int) else days
    span = F.abs(days) * 2 + 10 + 2 * len(holidays)
    d = start.cast("date")
    after = F.filter(F.sequence(d, F.date_add(d, span.cast("int"))), lambda x: (F.weekday(x) < 5) & ~F.array_contains(_dates(holidays), x))
    before = F.filter(F.sequence(d, F.date_sub(d, span.cast("int"))), lambda x: (F.weekday(x) < 5) & ~F.array_contains(_dates(holidays), x))
    first = F.element_at(after, 1)
    back = F.filter(before, lambda x: x < first)
    return F.when(days >= 0, F.element_at(after, (days + 1).cast("int"))).otherwise(F.element_at(back, F.greatest(-days, F.lit(1)).cast("int")))


def add_days(ts: Column, days: Column | int) -> Column:
    """Keeps the time of day."""
    return ts + F.make_dt_interval(F.lit(days) if isinstance(days, int) else days)


def parse_first(text: Column, formats: Sequence[str]) -> Column:
    """A timestamp by the first format that fits, or null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


#: C-style format codes and Spark's patterns for them (fixed values).
_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%%": "%"}


def spark_format(fmt: str) -> str:
    """A C-style date format as a Spark pattern; other letters are quoted."""
    out, i, quoted = [], 0, ""
    while i < len(fmt):
        code = fmt[i:i + 2]
        if code in _CODES:
            if quoted:
                out.append(f"'{quoted}'")
                quoted = ""
            out.append(_CODES[code])
            i += 2
            continue
        if fmt[i].isalpha():
            quoted += fmt[i]
        else:
            if quoted:
                out.append(f"'{quoted}'")
                quoted = ""
            out.append(fmt[i])
        i += 1
    return "".join(out) + (f"'{quoted}'" if quoted else "")


def strftime(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, spark_format(fmt))


def strptime(text: Column, fmt: str) -> Column:
    return F.to_timestamp(text, spark_format(fmt))


def try_strptime(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(spark_format(fmt)))


#: Bytes of texts that are Python strings at once; a longer text is still whole.
SLICE_BYTES = 1 << 20
_ACCENTS = re.compile("[\u0300-\u036f]")


def _of_texts(fn: Callable, kind: pa.DataType) -> Callable:
    """``fn`` of each text but nulls, slice by slice, so that a batch of long texts is never whole as Python strings."""

    def run(texts: pa.Array) -> pa.Array:
        done, todo = [], [texts]
        while todo:
            part = todo.pop()
            if len(part) > 1 and part.nbytes > SLICE_BYTES:
                half = len(part) // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                done.append(pa.array([None if t is None else fn(t) for t in part.to_pylist()], kind))
        return pa.concat_arrays(done)

    return run


# In ASCII only a line's end of two characters is one grapheme.
nfc_normalize = F.arrow_udf(_of_texts(lambda t: unicodedata.normalize("NFC", t), pa.string()), T.StringType())
strip_accents = F.arrow_udf(_of_texts(lambda t: unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", t))), pa.string()), T.StringType())
grapheme_length = F.arrow_udf(_of_texts(lambda t: len(t) - t.count("\r\n") if t.isascii() else sum(1 for _ in __import__("regex").finditer(r"\X", t)), pa.int32()), T.IntegerType())


def list_select(values: Column, positions: Column) -> Column:
    """Elements at 1-based positions; null beyond the end."""
    return F.transform(positions, lambda i: F.try_element_at(values, i.cast("int")))


def list_where(values: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: x["v"])


def list_resize(values: Column, n: int, fill: Column) -> Column:
    return F.when(F.size(values) >= n, F.slice(values, 1, n)).otherwise(F.concat(values, F.array_repeat(fill, F.lit(n) - F.size(values))))


def constant_or_null(value, *given: Column) -> Column:
    """A constant, or null where one of the others is."""
    ok = F.lit(True)
    for c in given:
        ok = ok & c.isNotNull()
    return F.when(ok, F.lit(value))


def checked(value: Column, ok: Column, message: str) -> Column:
    """A value, or an error that stops the query where the condition doesn't hold."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def regexp_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def row_hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def register(spark: SparkSession, prefix: str = "tessera_") -> None:
    """SQL names for the functions that Spark SQL lacks."""
    for name, fn in (("nfc_normalize", nfc_normalize), ("strip_accents", strip_accents), ("grapheme_length", grapheme_length)):
        spark.udf.register(f"{prefix}{name}", fn)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}add_days(t TIMESTAMP, n INT) RETURNS TIMESTAMP RETURN t + make_dt_interval(n)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}epoch_day(d DATE) RETURNS INT RETURN unix_date(d)")
