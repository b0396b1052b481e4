"""RDF triples (``s, p, o`` strings) and their graph patterns as joins.

Terms keep their N-Triples spelling: ``<iri>``, ``"text"``, ``"text"@lang``, ``"text"^^<type>``, ``_:blank``. A pattern
is a triple of terms and variables (strings that start with ``?``); solutions are DataFrames with a column per variable.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators import graph
from tessera.session import cut

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; comments and blank lines are skipped, other lines that don't parse raise."""
    line = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND v NOT LIKE '#%'")
    full = rf"^{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*\.\s*(?:#.*)?$"
    ok = F.when(F.col("v").rlike(full), True).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), "v")).cast("boolean"))
    return line.where(ok).select(*[F.regexp_extract("v", full, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))])


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, g`` of N-Quads files; the graph is null for triples. Other lines raise as for N-Triples."""
    line = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND v NOT LIKE '#%'")
    full = rf"^{_TERM}\s+(<[^>]*>)\s+{_TERM}(?:\s+(<[^>]*>|_:\S+))?\s*\.\s*(?:#.*)?$"
    ok = F.when(F.col("v").rlike(full), True).otherwise(F.raise_error(F.concat(F.lit("not an N-Quads line: "), "v")).cast("boolean"))
    parts = [F.regexp_extract("v", full, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"), (4, "g"))]
    return line.where(ok).select(*parts).withColumn("g", F.nullif("g", F.lit("")))


#: Tokens of Turtle: strings, iris, prefixed names, numbers, punctuation; comments and white space are passed over.
_TURTLE = re.compile(r'''"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|<[^>\s]*>|@?[A-Za-z_][\w.-]*(?<!\.):?[\w.%-]*(?<!\.)|:[\w.%-]*(?<!\.)|@[A-Za-z-]+|\^\^|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|[.;,\[\]()]|#[^\n]*|\S''')


def turtle_triples(text: str) -> list[tuple[str, str, str]]:
    """Triples of one Turtle document: prefixes, base, ``a``, lists of predicates and objects, literals, blank nodes; collections raise."""
    tokens = [t for t in _TURTLE.findall(text) if not t.startswith("#")]
    prefixes, base, out, blanks, at = {}, "", [], 0, 0
    xsd = "http://www.w3.org/2001/XMLSchema#"

    def iri(t: str) -> str:
        if t.startswith("<"):
            return t if ":" in t else f"<{base}{t[1:]}"
        name, _, rest = t.partition(":")
        if name not in prefixes:
            raise ValueError(f"unknown prefix in {t}")
        return f"<{prefixes[name]}{rest}>"

    def term() -> str:
        nonlocal at, blanks
        t, at = tokens[at], at + 1
        if t == "[":
            blanks += 1
            node = f"_:t{blanks}"
            if tokens[at] != "]":
                predicates(node)
            if tokens[at] != "]":
                raise ValueError("a blank node isn't closed")
            at += 1
            return node
        if t.startswith('"'):
            body = t[3:-3].replace('"', '\\"').replace("\n", "\\n") if t.startswith('"""') else t[1:-1]
            if at < len(tokens) and tokens[at] == "^^":
                kind, at = iri(tokens[at + 1]), at + 2
                return f'"{body}"^^{kind}'
            if at < len(tokens) and tokens[at].startswith("@"):
                tag, at = tokens[at], at + 1
                return f'"{body}"{tag}'
            return f'"{body}"'
        if re.fullmatch(r"[-+]?\d+", t):
            return f'"{t}"^^<{xsd}integer>'
        if re.fullmatch(r"[-+]?\d+\.\d+", t):
            return f'"{t}"^^<{xsd}decimal>'
        if re.fullmatch(r"[-+]?\d+(\.\d+)?[eE][-+]?\d+", t):
            return f'"{t}"^^<{xsd}double>'
        if t in ("true", "false"):
            return f'"{t}"^^<{xsd}boolean>'
        if t == "a":
            return "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
        if t.startswith("_:"):
            return t
        if t.startswith("<") or ":" in t:
            return iri(t)
        raise ValueError(f"unexpected {t} in Turtle")

    def predicates(subject: str) -> None:
        nonlocal at
        while True:
            predicate = term()
            while True:
                out.append((subject, predicate, term()))
                if tokens[at] != ",":
                    break
                at += 1
            while tokens[at] == ";":
                at += 1
            if tokens[at] in ".]":
                return
            if tokens[at - 1] != ";":
                raise ValueError(f"unexpected {tokens[at]} in Turtle")

    while at < len(tokens):
        word = tokens[at].lower()
        if word in ("@prefix", "prefix"):
            prefixes[tokens[at + 1].rstrip(":")], at = tokens[at + 2][1:-1], at + 3
        elif word in ("@base", "base"):
            base, at = tokens[at + 1][1:-1], at + 2
        else:
            subject = term()
            if tokens[at] != ".":
                predicates(subject)
        if at < len(tokens) and tokens[at] == ".":
            at += 1
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files. A file's prefixes hold to its end, so each is read whole by one task; blank nodes are told apart by file."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                own = lambda t: f"_:{name}{t[2:]}" if t.startswith("_:") else t
                rows += [(own(s), p, own(o)) for s, p, o in turtle_triples(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select(F.substring(F.md5(F.input_file_name()), 1, 12).alias("name"), "value")
    return files.mapInArrow(run, "s string, p string, o string")


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.text(path)


def match(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Solutions of one pattern; a repeated variable means equality."""
    df, out = triples, {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            df = df.where(F.col(column) == term)
        elif term[1:] in out:
            df = df.where(F.col(column) == F.col(out[term[1:]]))
        else:
            out[term[1:]] = column
    return df.select(*[F.col(c).alias(v) for v, c in out.items()]) if out else df.select(F.lit(True).alias("_matched")).limit(1)


def join_solutions(a: DataFrame, b: DataFrame, how: str = "inner", unbound: Sequence[str] = ()) -> DataFrame:
    """Solutions joined on their shared variables; without any, every pair.

    ``unbound`` names shared variables that may be null on either side (after OPTIONAL or UNION): unbound agrees with every value. The sides
    are split by which of those are bound, so each part is a join on equal values.
    """
    shared = [c for c in a.columns if c in b.columns]
    loose = [c for c in unbound if c in shared]
    if not loose:
        return a.join(b, shared, how) if shared else a.join(b, F.lit(True), how)
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    a = cut(a.withColumn("_row", F.monotonically_increasing_id()))
    names = [c for c in dict.fromkeys([*a.columns, *b.columns])]
    out = None
    bound = lambda df, mask: df.where(F.lit(True) if not loose else F.expr(" AND ".join(f"`{c}` IS {'NOT ' if m else ''}NULL" for c, m in zip(loose, mask))))
    masks = [[bool(i >> k & 1) for k in range(len(loose))] for i in range(1 << len(loose))]
    for mine in masks:
        for theirs in masks:
            both = [c for c, x, y in zip(loose, mine, theirs) if x and y]
            on = [c for c in shared if c not in loose or c in both]
            left = bound(a, mine).drop(*[c for c, x, y in zip(loose, mine, theirs) if not x])
            right = bound(b, theirs).drop(*[c for c, x, y in zip(loose, mine, theirs) if x and not y])
            part = left.join(right, on) if on else left.join(right, F.lit(True))
            part = part.select(*[c if c in part.columns else F.lit(None).cast(dict([*a.dtypes, *b.dtypes])[c]).alias(c) for c in names])
            out = part if out is None else out.union(part)
    if how == "left":
        out = cut(out)
        out = out.unionByName(a.join(out.select("_row").distinct(), "_row", "left_anti"), allowMissingColumns=True)
    return out.drop("_row")


def basic_pattern(triples: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Solutions of all patterns at once; patterns that share a variable with those before are joined first, so every pair arises only
    where patterns have nothing in common at all."""
    out, left = match(triples, *patterns[0]), list(patterns[1:])
    while left:
        at = next((i for i, p in enumerate(left) if any(t.startswith("?") and t[1:] in out.columns for t in p)), 0)
        out = join_solutions(out, match(triples, *left.pop(at)))
    return out


def optional(a: DataFrame, b: DataFrame, unbound: Sequence[str] = ()) -> DataFrame:
    """a with the solutions of b that agree, or alone; ``unbound`` as in ``join_solutions``."""
    return join_solutions(a, b, "left", unbound)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared, "left_anti") if shared else a


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [c for c in a.columns if c in b.columns], "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def construct(solutions: DataFrame, template: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Triples of a template, distinct; rows with an unbound variable give none."""
    part = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    out = None
    for s, p, o in template:
        rows = solutions.select(part(s).alias("s"), part(p).alias("p"), part(o).alias("o"))
        out = rows if out is None else out.union(rows)
    return out.na.drop().distinct()


def describe(triples: DataFrame, resources: DataFrame, name: str) -> DataFrame:
    """Triples that a resource is the subject or object of."""
    r = resources.select(F.col(name).alias("r")).distinct()
    return triples.join(r, F.col("s") == F.col("r"), "left_semi").union(triples.join(r, F.col("o") == F.col("r"), "left_semi")).distinct()


# ---- property paths: DataFrames of (src, dst) ---------------------------------------------------

def step(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def sequence(a: DataFrame, b: DataFrame) -> DataFrame:
    """a then b; duplicates stay."""
    return a.select("src", F.col("dst").alias("_m")).join(b.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst")


def alternative(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def negated(triples: DataFrame, predicates: Sequence[str]) -> DataFrame:
    return triples.where(~F.col("p").isin(*predicates)).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def one_or_more(path: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    out = graph.closure(path, sources, keep_start=True)
    return out.select(F.col("start").alias("src"), F.col("finish").alias("dst"))


def zero_or_more(path: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    out = graph.closure(path, sources, low=0)
    return out.select(F.col("start").alias("src"), F.col("finish").alias("dst"))


# ---- terms --------------------------------------------------------------------------------------

def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """STR: the text of a literal or iri."""
    return F.when(is_iri(t), F.regexp_extract(t, "^<(.*)>$", 1)).when(is_literal(t), F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(t)


def lang(t: Column) -> Column:
    return F.regexp_extract(t, r'"@([A-Za-z0-9-]+)$', 1)


def datatype(t: Column) -> Column:
    d = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
    return F.when(d != "", d).when(lang(t) != "", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").when(is_literal(t), "http://www.w3.org/2001/XMLSchema#string")


def number(t: Column) -> Column:
    """Numeric value, or null."""
    return lexical(t).try_cast("double")


def literal(value: Column, kind: str | None = None) -> Column:
    text = F.concat(F.lit('"'), F.regexp_replace(value.cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
    return F.concat(text, F.lit(f"^^<http://www.w3.org/2001/XMLSchema#{kind}>")) if kind else text
