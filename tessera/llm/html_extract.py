"""Main-text extraction from HTML by tree scoring.

The page becomes a tree of elements. Each block of text gives points for its length and its commas to
its ancestors (parent in full, grandparent half, further ones less); a container's points are
discounted by its link density. The best container is kept together with the siblings that score
like content; an enclosing ``article`` or ``main`` stands for the best container. Menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are pruned wherever they stand.

Elements that their tag, role or visibility marks as furniture are pruned at once. A class or id marks furniture if one of its names is such a word or
has one (``ad-slot``, ``left-sidebar``, but not ``with-sidebar``). Blocks so marked, forms and page headers are pruned only
once all text is known: an element that holds half of the page's points stays if it encloses an ``article`` or ``main``, or if it is no furniture by
its full name and no such element with text stands elsewhere. Reader comments never stay. Lists of links count as menus by their short link texts.

Defined results: null or empty html gives ''; a page without text gives ''; unclosed tags, comments
and scripts end where HTML ends them (the end of the page); very long pages take time in proportion to their length; of containers with equal points the first
in the page wins; repeated rows give repeated results; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import map_arrow

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>""")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul option select".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
_CONTAINER = frozenset("article main section div body td blockquote figure details center html li".split())
_KEPT = frozenset("html body article main".split())
_DROP_TAGS = frozenset("nav footer aside button select input dialog menu head option".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id values that mark page furniture.
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion related recommended replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar alert".split()
)
#: Those of reader comments; and words before one of the above that turn it into a remark on the layout.
_READERS = frozenset("comment comments commentlist disqus replies respond".split())
_LAYOUT = frozenset("with has have no not without is hide show".split())
_LINK_LIST = frozenset("ul ol dl div section nav".split())
#: How an element is marked: by its tag or a part of a name, by a full name, as reader comments.
PART, FULL, COMMENTS = 1, 2, 3
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class _Page:
    """Elements in page order (parallel lists) and the blocks of text that hang on them."""

    __slots__ = ("tag", "parent", "drop", "mark", "block", "blocks")

    def __init__(self):
        self.tag, self.parent, self.drop, self.mark, self.block = ["#root"], [-1], [False], [0], [0]
        self.blocks: list[list] = []  # [element, text, link characters]


def _named(value: str, in_article: bool) -> int:
    """How a class or id marks its element."""
    mark = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        for at, w in enumerate(words):
            if w in _DROP_WORDS and not (at and words[at - 1] in _LAYOUT) and not (in_article and w == "header"):
                mark = max(mark, COMMENTS if w in _READERS else FULL if len(words) == 1 else PART)
    return mark


def _dropped(attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is furniture by its role or visibility, and how its class and id mark it."""
    mark = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, 0
        if name == "role" and value.lower() in _DROP_ROLES:
            return True, 0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0
        if name in ("class", "id"):
            mark = max(mark, _named(value, in_article))
    return False, mark


def _parse(src: str) -> _Page:
    page = _Page()
    tags, parents, drops, marks, owners = page.tag, page.parent, page.drop, page.mark, page.block
    last, quoted = src.rfind(">"), True
    stack, depth_of = [0], {}
    parts: list[str] = []
    link = articles = 0
    n, pos = len(src), 0
    lower = None

    def flush():
        nonlocal parts, link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append([owners[stack[-1]], text, min(link, len(text))])
            parts, link = [], 0

    def pop_to(k):
        nonlocal articles
        while len(stack) > k:
            t = tags[stack.pop()]
            depth_of[t] -= 1
            articles -= t in ("article", "main")

    while pos < n:
        at = src.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            text = src[pos:at]
            if "&" in text:
                text = _html.unescape(text)
            if not drops[stack[-1]]:
                parts.append(text)
                if depth_of.get("a"):
                    link += len(text.strip())
            pos = at
        if at == n:
            break
        m = _TAG.match(src, at) if quoted and at < last else None
        if not m:
            if _OPEN.match(src, at):  # a tag that doesn't end, or ends inside a quotation that doesn't
                quoted, end = False, src.find(">", at) if at < last else -1
                if end < 0:
                    break  # the rest of the page is an unfinished tag
                m = _OPEN.match(src, at)
                closing, tag, attrs, pos = m[1], m[2].lower(), src[m.end():end], end + 1
            elif src.startswith("<!--", at):
                end = src.find("-->", at + 4)
                pos = n if end < 0 else end + 3
                continue
            elif src[at + 1:at + 2] in ("!", "?", "/"):
                end = src.find(">", at)
                pos = n if end < 0 else end + 1
                continue
            else:
                if not drops[stack[-1]]:
                    parts.append("<")
                pos = at + 1
                continue
        else:
            closing, tag, attrs, pos = m[1], m[2].lower(), m[3], m.end()
        if closing:
            if not depth_of.get(tag):
                continue
            if tag in _BLOCK:
                flush()
                k = next(k for k in range(len(stack) - 1, -1, -1) if tags[stack[k]] == tag)
                pop_to(k)
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        pop_to(k)
                        break
                    if tags[stack[k]] in _BLOCK:
                        break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not attrs.endswith("/") and pos < n:
                lower = lower if lower is not None else src.lower()
                end = lower.find(f"</{tag}", pos) if len(lower) == n else src.find(f"</{tag}", pos)
                close = src.find(">", end) if end >= 0 else -1
                pos = n if close < 0 else close + 1
            continue
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES_P and depth_of.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    t = tags[stack[k]]
                    if t == "p":
                        pop_to(k)
                        break
                    if t in _BLOCK:
                        break
            if tag in _SAME:
                for k in range(len(stack) - 1, 0, -1):
                    t = tags[stack[k]]
                    if t in _SAME[tag]:
                        pop_to(k)
                        if tag != "tr" or t == "tr":
                            break
                    elif t in _STOP[tag]:
                        break
        if attrs.endswith("/") and tag not in _BLOCK:
            continue
        top = stack[-1]
        drop, mark = drops[top] or tag in _DROP_TAGS, PART if tag == "form" or tag == "header" and not articles else 0
        if not drop and len(attrs) > 2 and tag not in _KEPT:
            drop, named = _dropped(attrs, articles > 0)
            mark = max(mark, named)
        if mark and tag not in _BLOCK:
            drop, mark = True, 0
        owners.append(len(tags) if tag in _BLOCK else owners[top])
        tags.append(tag)
        parents.append(top)
        drops.append(drop)
        marks.append(mark)
        stack.append(len(tags) - 1)
        depth_of[tag] = depth_of.get(tag, 0) + 1
        articles += tag in ("article", "main")
    flush()
    return page


def points_of(text: str, link: int) -> float:
    """Points of a block: for its length and its commas, discounted by its share of link text."""
    return (min(len(text) / 100, 3.0) + text.count(",") + 0.05) * (1 - link / len(text))


def _pruned(page: _Page) -> list[bool]:
    """Of each element whether it is pruned by its own or an ancestor's mark."""
    tags, parents, marks = page.tag, page.parent, page.mark
    count = len(tags)
    if not any(marks):
        return [False] * count
    comments, held, articles = [False] * count, [0.0] * count, [0] * count
    for i in range(1, count):
        comments[i] = comments[parents[i]] or marks[i] == COMMENTS
    for owner, text, link in page.blocks:
        if not comments[owner]:
            held[owner] += points_of(text, link)
    for i in range(count - 1, 0, -1):
        if held[i] > 0 and tags[i] in ("article", "main"):
            articles[i] = 1
        held[parents[i]] += held[i]
        articles[parents[i]] += articles[i]
    out = [False] * count
    for i in range(1, count):
        stays = marks[i] != COMMENTS and 0 < held[0] <= 2 * held[i] and (articles[i] > 0 or marks[i] == PART and articles[0] == 0)
        out[i] = out[parents[i]] or (marks[i] > 0 and not stays)
    return out


def main_text(src: str | None) -> str:
    """The main text of one page: its blocks in page order, one per line."""
    if not src:
        return ""
    page = _parse(src)
    tags, parents, pruned = page.tag, page.parent, _pruned(page)
    blocks = [b for b in page.blocks if not pruned[b[0]]]
    if not blocks:
        return ""
    count = len(tags)
    score, length, linked, links = [0.0] * count, [0] * count, [0] * count, [0] * count
    for i, t in enumerate(tags):
        if t == "a":
            links[i] = 1
    for owner, text, link in blocks:
        length[owner] += len(text)
        linked[owner] += link
        points = points_of(text, link)
        node, share = owner, 1.0
        if tags[node] not in _CONTAINER:
            node = parents[node]
        for level in range(4):
            if node <= 0:
                break
            score[node] += points * share
            node, share = parents[node], (0.5 if level == 0 else 1 / (3 * (level + 1)))
    for i in range(count - 1, 0, -1):  # children stand after their parents
        p = parents[i]
        length[p] += length[i]
        linked[p] += linked[i]
        links[p] += links[i]
    final = [s * (1 - (linked[i] / length[i] if length[i] else 0)) if s else 0.0 for i, s in enumerate(score)]
    best = max(range(count), key=lambda i: (final[i], -i))
    if final[best] <= 0:
        best = 0
    up = best
    while up > 0:
        if tags[up] in ("article", "main"):
            best = up
        up = parents[up]
    keep, semantic = {best}, tags[best] in ("article", "main")
    home = parents[best] if best else -1
    if home > 0:
        least = max(1.0, 0.2 * final[best])
        for i in range(1, count):
            if parents[i] == home and i != best and length[i]:
                density = linked[i] / length[i]
                if tags[i] in ("article", "main") or (
                    not semantic and density < 0.25 and (final[i] >= least or tags[i] in ("p", "h1", "h2", "h3", "blockquote", "pre"))
                ):
                    keep.add(i)
    inside, menu = [False] * count, [False] * count
    inside[0] = best == 0
    for i in range(1, count):
        p = parents[i]
        inside[i] = inside[p] or i in keep
        # Inside an article only short link texts make a menu: lists of references have longer ones.
        menu[i] = menu[p] or (
            inside[p] and tags[i] in _LINK_LIST and links[i] >= 3 and length[i] > 0
            and linked[i] >= (0.9 if semantic else 0.75) * length[i] and not (semantic and linked[i] > 25 * links[i])
        )
    return "\n".join(b[1] for b in blocks if inside[b[0]] and not menu[b[0]])


def extract_main_text(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every row: the key columns and ``text``.

    Runs page by page inside the scan's tasks (no shuffle), in slices of bounded size.
    """
    fields = [f for k in keys for f in [pages.schema[k]]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"
    source = pages.select(*keys, F.col(html_col).alias("_html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column("_html").to_pylist()]
        columns = [batch.column(k) for k in keys] + [pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "text"])

    return map_arrow(source, run, schema, "_html")
