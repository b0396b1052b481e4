"""The corpus operators against brute force, exact round trips and edge cases."""

import gzip
import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import (block_knn, components, html_extract, iblt, language, near_dedup, packing, piece_bpe, quality,
                         surrogates, warc)

P = pytest.importorskip("public_tokenizers")
LONG = "many words of one very long text without an end " * 3000
EDGE = [(1, "Alpha beta, gamma delta epsilon zeta. Eta theta!\nSecond line here, with words.", "en", 9), (2, "", "en", 9), (3, None, None, 9),
        (4, " \n\t ", "en", 9), (5, LONG, "en", 9), (6, "Alpha beta, gamma delta epsilon zeta. Eta theta!\nSecond line here, with words.", "en", 9),
        (6, "Alpha beta, gamma delta epsilon zeta. Eta theta!\nSecond line here, with words.", "en", 9), (None, "no id at all, mail x@y.example.com", "en", 9),
        (8, "日本語 текст 𝒳 \u0000 mixed", None, 9)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, a int").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


# ---- main text ----------------------------------------------------------------------------------

PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=a>Home</a></nav><div class="sidebar"><p>Side, text, here, and, more, commas</p></div>
<div id=content><h2>Title &amp; more</h2><p>First  paragraph, with commas, and enough text to count as content of the page.<p>Second&nbsp;one <b>bold</b>, also long enough to be counted.
<ul><li>point one<li>point two</ul><form><p>Your name, please</p></form><script>var x = "<p>no</p>";</script></div>
<div class="comments"><p>Reader, comment, here, long, enough, to, win, over, all, others, by, commas</p></div><footer>Foot</footer></body></html>"""


def test_main_text_keeps_the_article_alone():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with commas, and enough text to count as content of the page.",
        "Second one bold, also long enough to be counted.", "point one", "point two"]


@pytest.mark.parametrize("src", [None, "", "   ", "<p>", "<!-- open", "<script>open", "<a <b <c", "<" * 500, "</p></div>", "<div>" * 3000 + "deep"])
def test_main_text_of_odd_pages(src):
    assert html_extract.main_text(src) in ("", "deep") or "<" in src


def test_main_text_query(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", "<article><h1>T</h1><p>Short</article>"), (3, "u", "<article><h1>T</h1><p>Short</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract_main_text(pages).collect()
    assert sorted(len(r.text) for r in out)[:3] == [0, 7, 7] and len(out) == 4
    assert html_extract.extract_main_text(pages.where("false")).count() == 0


@pytest.mark.parametrize("src", ["<a " * 350_000, "<a href='x\" " * 90_000 + ">", "<p title=\"" + "<i '" * 250_000, "<b>x<hr>" * 125_000, "<" * 1_000_000,
                                 "<p>a < b & c " * 70_000, "<div><td>" * 100_000, "<!-- <" * 150_000, "</p></i>" * 125_000])
def test_main_text_takes_linear_time(src):
    began = time.time()
    html_extract.main_text(src)
    assert time.time() - began < 10


def test_main_text_keeps_wrappers_and_prunes_furniture():
    body = "<p>A long paragraph, with commas, that is clearly the text of the page and nothing else.</p>" * 3
    want = "\n".join(["A long paragraph, with commas, that is clearly the text of the page and nothing else."] * 3)
    for wrapper in ("div class='content with-sidebar'", "div id=page class=no-sidebar", "div class=headerFixed", "section class='search-result-article'",
                    "div class=widget-content", "form id=aspnetForm", "div class=widget", "header"):
        tag = wrapper.split()[0]
        inner = f"<article>{body}</article>" if wrapper.endswith("=widget") else body
        assert html_extract.main_text(f"<body><{wrapper}>{inner}</{tag}><div class=ad>An advert, with, many, commas</div></body>") == want, wrapper
    ad = "<div class='ad-slot'><p>Buy, this, now, please, it, is, cheap, and, good, and, you, want, it.</p></div>"
    assert html_extract.main_text(f"<body>{ad}<article><p>Short.</p></article><ol class=comment-list><article>{body}</article></ol></body>") == "Short."
    assert html_extract.main_text("<p>Hello, <span hidden>a < b</span> world, this</p>") == "Hello, world, this"
    refs = "<ul>" + "".join(f"<li><a href={i}>Reference number {i}, a rather long title of a paper</a></li>" for i in range(4)) + "</ul>"
    menu = "<ul>" + "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(4)) + "</ul>"
    assert html_extract.main_text(f"<article>{menu}{body}{refs}</article>").count("\n") == 6


def _plain_article(src):
    """The text of pages whose article holds headings and paragraphs alone."""
    inner = src[src.index("<article>") + 9:src.index("</article>")]
    parts = re.split(r"</?(?:p|h1|ul|ol|li)[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_main_text_of_given_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(pages) == 250 and all(html_extract.main_text(p["html"]) == _plain_article(p["html"]) for p in pages)


def _brute_best(tree, path=()):
    """(points, path) of each container of a small tree by the rule of the method, from the definition."""
    tag, kids = tree
    out = {}
    if isinstance(kids, str):
        return {path: html_extract.points_of(kids, 0)} if kids else {}
    for n, kid in enumerate(kids):
        for where, points in _brute_best(kid, (*path, n)).items():
            out[where] = points
    return out


def test_main_text_scores_equal_brute_force():
    """The container with the most points, summed over its paragraphs at their distance, is the one kept."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        text = lambda: "w" * int(rng.integers(30, 300)) + "," * int(rng.integers(0, 6))
        groups = [[[text() for _ in range(rng.integers(1, 4))] for _ in range(rng.integers(1, 3))] for _ in range(rng.integers(2, 4))]
        tree = ("body", [("div", [("div", [("p", t) for t in inner]) for inner in outer]) for outer in groups])
        score = Counter()
        for where, points in _brute_best(tree).items():
            for up, share in zip(range(len(where) - 1, -1, -1), (1, 0.5, 1 / 6, 1 / 9)):
                score[where[:up]] += points * share
        best = max(score, key=lambda k: (score[k], [-x for x in k]))
        src = "<body>" + "".join("<div>" + "".join("<div>" + "".join(f"<p>{t}</p>" for t in inner) + "</div>" for inner in outer) + "</div>" for outer in groups) + "</body>"
        kept = html_extract.main_text(src).split("\n")
        node = groups
        for k in best:
            node = node[k]
        flat = lambda x: [x] if isinstance(x, str) else [z for y in x for z in flat(y)]
        assert set(flat(node)) <= set(kept)


# ---- surrogates ---------------------------------------------------------------------------------

def test_surrogates(spark, edge, empty):
    rows = [(1, "Mail bob.Smith42@mail6.example.com or BOB.SMITH42@MAIL6.EXAMPLE.COM, +1 (678) 555-5272, 4111 1111 1111 1111, 4111-1111-1111-1111."),
            (2, "Mr. John Smith, Mrs. Anna Smith, Mr. Smith, г-н Иван Петров; 240.56.125.154 123-45-6789"),
            (3, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'), (4, "clean text, Version 2.0. of 1999, 3.14")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in surrogates.replace_personal_data(df, "secret").collect()}
    mails = re.findall(r"[\w.]+@[\w.]+\w", out[1])
    assert mails[0].lower() == mails[1].lower() and mails[0] != "bob.Smith42@mail6.example.com"
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", out[1])
    assert re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1]) and cards[0][0] == "4"
    digits = [int(c) for c in re.sub(r"\D", "", cards[0])][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1]) and "678" not in out[1]
    john, anna, smith = re.match(r"Mr\. (\w+ \w+), Mrs\. (\w+ \w+), Mr\. (\w+),", out[2]).groups()
    assert john.split()[1] == anna.split()[1] == smith != "Smith" and john.split()[0] != anna.split()[0]
    assert re.search("г-н [А-Яа-я]+ [А-Яа-я]+;", out[2]) and "240.56" not in out[2] and "123-45" not in out[2]
    assert re.fullmatch('token = "[0-9a-f]{40}"', out[3]) and "2abc3" not in out[3] and out[4] == rows[3][1]
    done = surrogates.replace_personal_data(edge, "secret", count_col="n")
    assert done.columns == [*edge.columns, "n"] and done.count() == len(EDGE)
    for r in done.collect():
        assert (r.text is None) == (r.doc_id == 3) and ("@y.example.com" not in (r.text or ""))
    assert surrogates.replace_personal_data(empty, "secret").count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"host 200.{i // 250}.{i % 250}.7 asks") for i in range(12_000)]
    out = surrogates.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert len({r.text for r in out}) == 12_000


def test_surrogates_of_many_names_stay_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[i // 26 ** k % 26] for k in range(4)).capitalize()
    rows = [(i, f"Mr. {word(i)} left") for i in range(7_000)] + [(7_000 + i, f"Frau {word(i)} Smith left") for i in range(600)]
    rows.append((-1, "password: ________ left"))
    out = surrogates.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    fresh = [r.text.split(" ", 1)[1] for r in out]
    assert len(set(fresh)) == 7_601 and not set(fresh) & {t.split(" ", 1)[1] for _, t in rows}
    assert len({r.text.split()[2] for r in out if r.doc_id >= 7_000}) == 1


def test_surrogates_take_entities_whole(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,AB-CD\n\n" + "MIIEow+/" * 2000 + "\n-----END RSA PRIVATE KEY-----"
    found = ["token = " + "a1B2" * 100, "password: eyJabc.def.ghi-jkl", "0123456789abcdef" * 20, key, "sk-" + "aB3_" * 100, "2001:db8::1", "fe80:1:2::",
             "4111 1111 1111 1111", "a" * 300 + "@x.example.com"]
    clean = ["std::dead a::b 12:30", "order 9807915762804490 of 1.2.3", "-----BEGIN PRIVATE KEY----- alone. " * 50, ""]
    rows = list(enumerate(found + clean))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N", F.lit("clash"))
    out = {r.doc_id: r for r in surrogates.replace_personal_data(df, "k", count_col="n").collect()}
    for i, t in enumerate(found):
        value = re.split(r"[=:] ", t, maxsplit=1)[-1] if i < 2 else t
        assert out[i].n == 1 and value not in out[i].text
        assert i == 3 or len(out[i].text) == len(t) or "@" in t
        runs = re.findall("[A-Za-z0-9]{8,}", value)
        assert not any(run in out[i].text for run in runs if i not in (4,))
    assert all(out[len(found) + i].text == t and out[len(found) + i].n == 0 for i, t in enumerate(clean))


def test_surrogates_of_null_and_repeated_ids(spark):
    """Coreference over documents against a plain dictionary, whatever the ids are."""
    rows = [(None if i % 3 == 0 else 7, f"ask Herr Muller{chr(97 + i % 26)} or p{i % 40}@mail.example.com") for i in range(400)]
    out = surrogates.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), "k").collect()
    known, back = {}, {}
    for (_, before), r in zip(rows, out):
        for x, y in zip(before.split()[2::2], r.text.split()[2::2]):
            assert known.setdefault(x, y) == y and back.setdefault(y, x) == x
    assert len(known) == 66


# ---- fingerprints -------------------------------------------------------------------------------

def _pieces(text):
    return Counter(p[k:k + iblt.PIECE] for p in iblt._CUT.split(text or "") if p for k in range(0, len(p), iblt.PIECE))


def _like(a, b):
    a, b = _pieces(a), _pieces(b)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def test_fingerprints_equal_brute_force(spark, edge, empty):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    rows = [(int(i), "\n".join(" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(rng.integers(0, 60)))) for i in rng.permutation(300)]
    out = {r.doc_id: r for r in iblt.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text, ids = dict(rows), sorted((i for i, _ in rows), reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        n = len(text[i])
        edited = text[i][:n - n // 2] + text[nxt][:n // 2]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == n
        assert out[i].near_edited == pytest.approx(_like(text[i], edited)) and out[i].near_next == pytest.approx(_like(text[i], text[nxt]))
    done = iblt.edit_report(edge).collect()
    assert len(done) == len(EDGE) and len({r.fingerprint for r in done if r.doc_id in (1, 6)}) == 1
    assert iblt.edit_report(empty).count() == 0 and iblt.fingerprints(edge).count() == len(EDGE)


def test_next_text_of_repeated_and_null_keys(spark):
    """Every row is followed by the row after it in one global order, whatever the keys."""
    rng = np.random.default_rng(13)
    keys = [None] * 300 + [7] * 300 + [int(k) for k in rng.integers(-50, 50, 200)] + [2 ** 60 + i for i in range(5)]
    rows = [(k, f"text {i // 3} {'x' * (i % 7)}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", F.lit("clash")).repartition(6)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    want = Counter((*r, after[1]) for r, after in zip(order, order[1:] + order[:1]))
    assert Counter(tuple(r) for r in iblt.with_next(df).collect()) == want
    one = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert [tuple(r) for r in iblt.with_next(one).collect()] == [(None, "a", "a")]


def test_versions_recover_digests(spark):
    old = "\n".join(f"line {i}" for i in range(200))
    new = old.replace("line 7\n", "line seven\n") + "\nmore"
    r = iblt.compare_versions(spark.createDataFrame([(1, old, new), (2, old, LONG), (3, None, None)], "doc_id long, x string, y string"), "x", "y").collect()
    by = {x.doc_id: x for x in r}
    assert (len(by[1].removed), len(by[1].added), by[1].retried) == (1, 2, False)
    assert by[2].retried and len(by[2].removed) == 200 and by[2].likeness == 0 and by[3].likeness == 1


# ---- pieces -------------------------------------------------------------------------------------

def test_pieces_equal_the_library(edge, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(3)
    alphabet = list("abcdetinghr  \n\t_-=#*▁éñ中日𝒳\x00\r0123aaaa")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 200))) for _ in range(400)] + [t for _, t, _, _ in EDGE] + ["a" * 999, " " * 99, "ab" * 500, "=-" * 300]
    flat, counts = piece_bpe.Encoder(piece_bpe.load(path))(texts)
    for t, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == sp.encode(t or "") and piece_bpe.load(path).decode(ids.tolist()) == sp.decode(ids.tolist())
    out = piece_bpe.encode_decode(edge, path).collect()
    assert all(r.ids == sp.encode(r.decoded) for r in out) and len(out) == len(EDGE)
    assert piece_bpe.encode_decode(empty, path).count() == 0


def test_long_words_equal_the_library():
    """Words without a space, by neighbourhoods: as the library has them, in time that grows with their length."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.load(path)
    rng = np.random.default_rng(17)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ab", "=-", "01", "aeiouß中é𝒳", "ththeinger"]
    texts = ["".join(rng.choice(list(a), n)) for a in alphabets for n in (257, 300, 1000, 4000)] + ["a" * 5000, "=" * 3001, "ab" * 1500, "the" * 999]
    flat, counts = piece_bpe.Encoder(model)(texts)
    for t, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == sp.encode(t)
    began = time.time()
    piece_bpe.Encoder(model)(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))])
    assert time.time() - began < 20


# ---- near duplicates ----------------------------------------------------------------------------

def _shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i:i + 5]) for i in range(len(words) - 4)])


def _components(texts):
    sets, parent = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, edge, empty):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    texts, base = {}, [list(rng.choice(words, 60)) for _ in range(20)]
    for i in range(360):
        t = list(base[i % 20] if i >= 100 else base[0])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, 60))] = f"x{rng.integers(0, 9999)}"
        texts[i * 3] = " ".join(t).title() if i % 5 == 0 else " ".join(t)
    texts |= {2000: "", 2001: None, 2002: "two words", 2003: "TWO\twords", 2004: "other words"}
    out = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == _components(texts)
    assert {r.doc_id: r.n_shingles for r in out} == {i: len(_shingles(t)) for i, t in texts.items()}
    done = near_dedup.near_duplicates(edge).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in done if r.doc_id in (1, 2, 6)) == [(1, 1, True), (2, 2, True), (6, 1, False), (6, 1, False)]
    assert [r.kept for r in done if r.doc_id is None] == [True] and near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_template_crowd(spark, monkeypatch):
    """Different texts of one template (likeness about 0.7) with near copies among them that no pivot links."""
    rng = np.random.default_rng(21)
    own = lambda n: [f"o{x}" for x in rng.integers(0, 1 << 40, n)]
    template, texts = [f"t{i}" for i in range(86)], {}
    for i in range(700):
        tail = own(18)
        texts[2 * i] = " ".join(template + tail)
        if i % 7 == 0:
            texts[2 * i + 1] = " ".join(template + tail[:4] + own(14))
    monkeypatch.setattr(near_dedup, "BLOCK", 200, raising=False)
    monkeypatch.setattr(near_dedup, "COLUMNS", 512, raising=False)
    out = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = _components(texts)
    assert len(set(want.values())) == 700 and {r.doc_id: r.component_id for r in out} == want


def test_crowded_regions_need_no_join_by_document(spark):
    import re

    from tessera.llm import near_dedup

    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    reps = spark.range(30).select(F.col("id").alias("rep"), F.lit(bytes(2 * near_dedup.TREES * near_dedup.DEPTH)).alias("sig"))
    _, stars, _ = near_dedup._regions(reps, noted)
    assert {r.n for r in stars.collect()} and not [p for p in plans if re.search(r"\(rep#\d+L? = rep#\d+L?\)", p)]


def test_deduplicate_by_rows(spark):
    """One id on different texts, copies under null ids, repeated rows: rows go by their text, not by their id alone."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "z")
    rows = [(1, a), (2, b), (2, near), (3, b), (None, a + " end"), (None, c), (None, c.upper()), (None, c + " end"), (4, ""), (4, ""), (5, None),
            (1, a), (6, " "), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("_hash", F.lit(1)).repartition(4)
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    lonely = [t for i, t in left if i is None and t]
    assert len(lonely) == 1 and lonely[0].lower().startswith(c)
    assert left - Counter({(None, lonely[0]): 1}) == Counter({(1, a): 1, (2, b): 1, (4, ""): 1, (5, None): 1, (6, " "): 1, (None, None): 1})
    assert near_dedup.deduplicate(df.where("false")).count() == 0


@pytest.mark.parametrize("n, words, low, high", [(200, 86, 9, 13), (600, 400, 6, 9)])
def test_near_duplicates_of_template_variants(spark, n, words, low, high):
    """Variants of one template, a few linked and most not, in crowds that are cut deeper: components equal brute force."""
    rng = np.random.default_rng(n)
    texts = {}
    for i in range(n):
        t = [f"t{k}" for k in range(words)]
        for at in rng.choice(words, rng.integers(low, high), replace=False):
            t[at] = f"o{rng.integers(0, 1 << 40)}"
        texts[2 * i] = " ".join(t)
        if i % 5 == 0:
            texts[2 * i + 1] = " ".join([*t[:-6], *(f"o{x}" for x in rng.integers(0, 1 << 40, 6))])
    out = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == _components(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (5, 5), (100, 102)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in (100, 101, 102)} == {100} and len(out) == 44


# ---- nearest neighbours -------------------------------------------------------------------------

def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    odd = [(900, None), (920, []), (940, [0.0] * 8), (960, [float("nan")] * 8), (980, [1.0, None] * 4), (1000, [1.0, 2.0]), (1020, [2.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = defaultdict(list)
    for r in block_knn.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(float)
    assert set(out) == set(range(0, 700, 20)) | {1000, 1020} and [v for _, v, _ in out[1000]] == [1020]
    for q in range(0, 700, 20):
        s = (y * y[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        got = sorted(out[q])
        assert [v for _, v, _ in got] == best and [s for _, _, s in got] == pytest.approx([s[i] for i in best], abs=0)
    assert block_knn.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_crowds_and_repeated_ids(spark, monkeypatch):
    """A third of the vectors nearly equal, a third equal; double precision, many cells; rows that share an id are queries each."""
    for name, value in (("BLOCK", 50), ("GROUP", 60), ("SLICE", 150), ("TILE", 64), ("TILE_QUERIES", 16), ("PAIRS", 100)):
        monkeypatch.setattr(block_knn, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 12))
    x[:300] = x[0] + rng.normal(size=(300, 12)) * 1e-7
    x[300:600] = x[300]
    ids = np.r_[np.arange(890), np.full(10, 20)]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)] + [(2000, [1e200] * 3), (2001, [2e200, 0.0, 0.0]), (2002, [1e-300] * 3)],
                               "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in block_knn.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    want = defaultdict(list)
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        want[int(ids[q])] += [(n + 1, int(ids[i]), s[i]) for n, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:20])]
    assert sorted(v for _, v, _ in out.pop(2000)) == [2001, 2002]
    assert {q: sorted(v) for q, v in out.items()} == {q: sorted(v) for q, v in want.items()} and len(out[20]) == 220


def test_products_of_codes_are_exact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-127, 128, (20, 3000)).astype(np.int8) for _ in range(2))
    assert (block_knn.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


# ---- quality and language -----------------------------------------------------------------------

def _prose(rng, n):
    return " ".join(rng.choice("the of and house river walk stone light under bright morning".split(), n)).capitalize() + "."


def test_quality_held_out(spark, edge, empty):
    rng = np.random.default_rng(4)
    docs = []
    for i in range(600):
        t = "\n".join(_prose(rng, 20) for _ in range(4))
        docs.append((i, t if i % 3 else re.sub(r"(\w+)", r"\1###", t).upper()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    held = {r.doc_id for r in df.where(quality.held_out()).collect()}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    out = quality.score(df, model).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 3 > 0) for r in out if r.doc_id in held]) > 0.95
    done = quality.score(edge, model, score_col="q")
    assert done.columns == [*edge.columns, "q"] and all(0 <= r.q <= 1 for r in done.collect())
    assert quality.score(empty, model, score_col="q").count() == 0
    assert quality.fit(df, labels.where("false")).constant == 1.0


def _brute_score(model, text):
    """One document's score, passage by passage, from the definition of gated attention."""
    p, hs, logits = model.p, [], []
    for x in quality.encode([[q] for q in quality.passages(text)])[0]:
        h = np.tanh((x - model.mean) / model.std @ p["E"] + p["e"])
        hs.append(h)
        logits.append((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
    a = np.exp(np.array(logits) - max(logits))
    return 1 / (1 + np.exp(-((a / a.sum()) @ np.array(hs) @ p["c"] + p["b"][0])))


def test_quality_of_given_labels(spark):
    """Held-out ranking of the given labels; scores against brute force; repeated keys, and a score column already there."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    twice = docs.union(docs.where("doc_id < 100"))
    model = quality.fit(twice, labels)
    out = {r.doc_id: r for r in quality.score(docs.withColumn("SCORE", F.lit("clash")), model).join(labels, "doc_id").where(quality.held_out()).collect()}
    good, bad = ([r.score for r in out.values() if r.quality == q] for q in (1, 0))
    assert len(good) > 10 and len(bad) > 10 and np.mean([[g > b for b in bad] for g in good]) > 0.95
    for r in list(out.values())[:10]:
        assert r.score == pytest.approx(_brute_score(model, r.text))
    few = quality.fit(docs, labels, train_chars=1)
    assert few.constant is not None


def test_language_held_out(spark, edge, empty):
    rng = np.random.default_rng(6)
    vocab = {"en": "the of and house river walk stone light".split(), "de": "der die und haus fluss gehen stein licht".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang], 12)) + "!", lang) for i in range(400) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", "en"), (902, "riverside housing", None)], "doc_id long, text string, lang string")
    model = language.fit(docs.where(~quality.held_out()))
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows) and out[900].lang_pred == out[901].lang_pred == "und"
    assert out[902].lang_pred == "en" and all(0 <= r.lang_score <= 1 for r in out.values())
    assert language.predict(edge, model).count() == len(EDGE)
    assert language.predict(edge.withColumn("lang_pred", F.lit(1)), model).columns == [*edge.columns, "lang_pred", "lang_score"]
    none = language.fit(empty)
    assert {r.lang_pred for r in language.predict(edge, none).collect()} == {"und"}


def _brute_language(counts, text):
    """Word-first backoff from the definition: one word, one language, one n-gram at a time."""
    langs = sorted({lang for lang, _, _ in counts})
    tables = {0: defaultdict(Counter), 1: defaultdict(Counter), 2: defaultdict(Counter), 3: defaultdict(Counter), 4: defaultdict(Counter)}
    grams = lambda w, n: [w[i:i + n] for i in range(len(w) - n + 1)]
    for lang, w, n in counts:
        tables[0][w][lang] += n
        for size in (1, 2, 3, 4):
            for g in grams(w if size == 1 else f"<{w}>", size):
                tables[size][g][lang] += n
    totals = {k: Counter() for k in tables}
    for k, t in tables.items():
        for c in t.values():
            totals[k].update(c)

    def log(k, key, lang):
        return np.log((tables[k][key][lang] + 0.5) / (totals[k][lang] + 0.5 * (len(tables[k]) + 1)))

    rows = []
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in tables[0]:
            rows.append([log(0, w, lang) for lang in langs])
            continue
        for size in (4, 3, 2, 1):
            known = [g for g in grams(w if size == 1 else f"<{w}>", size) if g in tables[size]]
            if known:
                rows.append([np.mean([log(size, g, lang) for g in known]) for lang in langs])
                break
    if not rows:
        return None
    mean = np.mean(rows, axis=0) * min(len(rows), language.EVIDENCE)
    return langs[int(mean.argmax())], 1 / np.exp(mean - mean.max()).sum()


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    counts = Counter((r.lang, w) for r in {(r.lang, r.text): r for r in rows}.values() if r.lang for w in language.words_of(r.text))
    model = language.fit(docs)
    want = language.Model(*zip(*sorted((*k, n) for k, n in counts.items())))
    assert model.langs == want.langs and set(model.word) == set(want.word) and (model.absent == want.absent).all()
    texts = [r.text for r in rows][:40] + ["thand derein", "zzq 中 x", "o"]
    langs, scores = model.predict(texts, {})
    for t, lang, score in zip(texts, langs, scores):
        found = _brute_language([(*k, n) for k, n in counts.items()], t)
        assert found is None or (lang, score) == (found[0], pytest.approx(found[1]))


def test_language_of_many_languages_and_unseen_scripts(spark):
    rng = np.random.default_rng(12)
    words = {f"l{i:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(20)] for i in range(300)}
    rows = [(i, " ".join(rng.choice(w, 15)), lang) for i, (lang, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert [r.lang_pred for r in language.predict(docs, model).collect()] == [lang for _, _, lang in rows] and len(model.langs) == 300
    langs, scores = model.predict(["Ωμέγα λόγος", "½ ² 12", "x" * 100_000, None], {})
    assert langs[0] in model.langs and scores[0] == pytest.approx(1 / 300) and langs[1] == langs[3] == "und" and langs[2] in model.langs
    small = language.sample(docs, chars=100).collect()
    assert {r.lang for r in small} == set(words)


# ---- packing ------------------------------------------------------------------------------------

def test_packing_covers_every_token(edge, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["ä ̈b", "<|endoftext|>x", "Σας ΣΑΣ it's 'S", "a\x1cb\x85c d e", "İI 12中文", "DON'T x_y__z 1234 é×÷ǅ", "  ", "",
           "we'll I'VE it'd 's ''t _a_ don't'll a'b <| x", "é'll naïve_ß'S 12é", "a\tb\r\nc  d~`{|}"]
    flat, counts = packing.ChunkTokenizer(path)(odd)
    assert [i.tolist() for i in np.split(flat, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    rows = packing.pack(edge, path, size=256).collect()
    found, sequences = Counter(), defaultdict(list)
    for r in rows:
        found[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    want = Counter()
    for i, t, _, _ in EDGE:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert found == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 256 or end & (end - 1) == 0
    assert packing.pack(empty, path).count() == 0


def _brute_plan(lengths, size, quadratic):
    """The rule of assignment from its definition: every step looks at all sequences."""
    total = sum(lengths)
    rest = total % size
    seqs = [dict(room=size, used=0, cost=0.0) for _ in range(total // size)] + [
        dict(room=1 << b, used=0, cost=0.0) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out, pieces, whole = [], [], 0
    for doc, n in enumerate(lengths):
        for k in range(n // size):
            out.append((doc, k * size, size, whole, 0))
            seqs[whole].update(room=0, cost=float("inf"))
            whole += 1
        if n % size:
            pieces.append((n % size, doc, n // size * size))
    for n, doc, start in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while n:
            open_ = [i for i, s in enumerate(seqs) if s["room"] >= n] or [i for i, s in enumerate(seqs) if s["room"]]
            at = min(open_, key=lambda i: (seqs[i]["cost"], i))
            s = seqs[at]
            take = min(n, s["room"])
            out.append((doc, start, take, at, s["used"]))
            s.update(room=s["room"] - take, used=s["used"] + take, cost=s["cost"] + take + quadratic * take * take)
            start, n = start + take, n - take
    return out


def test_packing_assigns_by_lowest_cost():
    rng = np.random.default_rng(19)
    for _ in range(60):
        lengths = rng.integers(1, int(rng.choice([5, 40, 300])), rng.integers(1, 60))
        got = list(zip(*(x.tolist() for x in packing.plan(lengths, 64, 1 / 32))))
        assert got == _brute_plan(lengths.tolist(), 64, 1 / 32)


# ---- archives -----------------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    same, big = "<p>same \r\n\r\nWARC/1.0\r\n bytes é</p>", "x" * 5_000_000
    rows = [(1, "http://a.example/x y", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", big), (None, "u", "no key"), (7, "u", "rep"), (7, "u", "rep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = warc.archive(pages).collect()
    assert sorted((r.key or 0, r.record_type, r.refers_to) for r in out if r.key != 7) == [
        (0, "response", None), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)]
    for r in out:
        want = {i: (t or "") for i, _, t in rows}[r.key].encode()
        assert r.digest == warc.base32_sha1(want) and r.n_bytes == len(want)
    assert warc.archive(pages.where("false")).count() == 0
    path = str(tmp_path / "arc"), str(tmp_path / "warc")
    many = spark.createDataFrame([(i, "http://x/\u2003y", f"{i % 9000}" + "z" * 5000) for i in range(9_002)], "page_id long, url string, html string").coalesce(1)
    warc.write_arc(many, path[0])
    warc.convert(spark, *path)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "warc").glob("*.gz")]
    assert len(sizes) > 1 and max(sizes) < (warc.FILE_SEGMENTS + 1) * warc.SEGMENT_BYTES
    back = warc.read_warc(spark, path[1], payloads=True)
    assert back.where("target = 'http://x/%E2%80%83y'").count() == 9_002
    assert {(r.key, r.refers_to) for r in back.where("record_type = 'revisit'").collect()} == {(0, 9000), (1, 9001)}
    assert back.where("record_type = 'response'").select("key", "payload").exceptAll(many.select("page_id", "html")).isEmpty()
    v1 = b"filedesc://x 0.0.0.0 20240101000000 text/plain 70\n1 0 x\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 12 + b"\n"
    with pytest.raises(ValueError):
        list(warc.parse_arc(v1 + b"http://a 1.2.3.4 20240101000000 text/html 99\nshort\n"))
