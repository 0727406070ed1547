"""Main text of web pages by consensus over a host's pages.

Each page's containers are scored by the text they hold: its vote is the innermost one that holds nearly all unlinked text,
as its path of tags and classes (digits dropped). Spark adds up the votes per host, and every page is extracted again from
the containers on its host's winning path, or from its own best container where it has none there.

A text is one line per block: character references decoded, white space inside a block one space, trimmed. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role
or class name. An outermost article or main element is judged by itself, whatever encloses it, and taken whole: no container
inside it is a candidate, nor one inside a container with unlinked text of its own. A class names boilerplate by its last part, or by its first if only layout words follow: "share-price"
and "related-work" are no boilerplate, "no-sidebar" or "with-comments" name no sidebar and no comments. An element that
holds most of the unlinked text (of its article, or of a page without one) is no boilerplate by its name, unless by one of
comments; neither is a form that also encloses the page's header, footer, menu or first heading. A first-level heading stays in an
element named header. Words inside a sentence stay if their element is only called a notice.

Cases: null or empty html gives an empty text; a null URL, or one without "://", votes under the host ""; unclosed
tags and cut-off pages are read as far as they go; a quote opens a string only after "="; ties between paths go to the greater
score, then to the path first by order; repeated rows vote and are extracted each. Work and memory are linear in the page, however
deep its elements. Only id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.operators.keys import cut_lineage

# fixed values: tags of the HTML standard by their role here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BOILER = frozenset("nav header footer aside form button select dialog menu svg object head".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr").split())
CONTAINER = frozenset("article main section div td body".split())
# an opening tag on the left ends an open <p>
ENDS_P = frozenset(("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                    "hr main menu nav ol p pre section table ul li dt dd").split())
ENDS_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# class, id and role words of what isn't the article
BOILER_WORDS = frozenset(("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
                          "disclaimer disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices "
                          "pagination pager popup promo promotion related respond replies search share sharing shares sidebar social "
                          "sponsor sponsored subscribe toolbar widget complementary contentinfo").split())

NOT_NAMED = frozenset("no not has have with without".split())  # what follows says what is there or not, not what this is
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
HEADER_WORDS = frozenset("header masthead banner".split())
NOTICE_WORDS = frozenset("notice notices".split())
# what a class may add to a word without changing what it names
LAYOUT_WORDS = frozenset(("area bar block body bottom box btn button buttons col column container content dialog form group holder icon icons inner "
                          "item items left link links list main message outer overlay panel policy posts primary right row secondary section "
                          "signup slot text thread title top unit wrap wrapper").split())
HOLDS = 0.95  # share of the unlinked text that a page's container must hold
ARTICLE_BONUS = 1.5

# a quote opens a string only as the first character of a value
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?|[^>=])*+)>?|<[!?][^>]*>?|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


def _named(value: str) -> set[str]:
    """Boilerplate words that one class, id or role stands for."""
    parts = [w for w in re.split(r"[^a-z]+", value) if w]
    parts = [w for before, w in zip(["", *parts], parts) if before not in NOT_NAMED]
    if not parts:
        return set()
    first = {parts[0]} if LAYOUT_WORDS.issuperset(w for w in parts[1:] if w not in BOILER_WORDS) else set()
    return (first | {parts[-1]}) & BOILER_WORDS


def _words(attributes: str) -> tuple[list[str], set[str]]:
    """(class names, words of class, id and role that name boilerplate)."""
    names, words = [], set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role"):
            continue
        value = html.unescape("".join(values)).lower()
        if name == "class":
            names = value.split()
        for v in value.split():
            words |= _named(v)
    return names, words


class Node:
    """An open element; `block` and `holder` are the innermost ones, itself included, that are no inline element and a container."""
    __slots__ = ("tag", "step", "parent", "block", "holder", "scope", "skip", "words", "title", "wraps", "text", "worth", "direct", "out", "out_title")

    def __init__(self, tag, step, parent, skip, words=frozenset()):
        self.tag, self.step, self.parent, self.skip, self.words = tag, step, parent, skip, words
        self.block = parent.block if tag in INLINE else self
        self.holder = self if tag in CONTAINER or not parent else parent.holder
        self.scope = parent.scope if parent else None  # outermost article or main
        self.title = tag == "h1" or bool(parent and parent.title)
        self.wraps = False  # a form around the page's own parts
        self.text = self.worth = self.direct = 0
        self.out = self.out_title = False

    def path(self) -> str:
        steps = []
        n = self
        while n.parent:
            if n.block is n:
                steps.append(n.step)
            n = n.parent
        return "".join("/" + x for x in reversed(steps))


Block = tuple[Node, str, int]


def blocks(page: str) -> tuple[list[Node], list[Block]]:
    """(elements, parents first; blocks in page order without boilerplate, each as its element, text and characters inside links)."""
    nodes: list[Node] = []
    every = list(_blocks(page, nodes))
    total: dict[Node | None, int] = {}
    for n, t, linked in every:
        own = max(0, len(t) - linked)
        total[n.scope] = total.get(n.scope, 0) + own
        n.text += own
    for n in reversed(nodes):
        if n.parent and n.scope is not n:
            n.parent.text += n.text
    alone = not any(v for k, v in total.items() if k is not None)
    for n in nodes:
        if n.scope is n:
            continue  # judged by itself
        if n.parent:
            n.out, n.out_title = n.parent.out, n.parent.out_title
        if n.words:
            boiler = (not COMMENT_WORDS.isdisjoint(n.words) or not (n.scope is not None or alone) or 2 * n.text <= total.get(n.scope, 0)
                      or n.tag == "form" and not n.wraps)
            n.out |= boiler
            n.out_title |= boiler and not HEADER_WORDS.issuperset(n.words)
    return nodes, [b for b in every if not (b[0].out_title if b[0].title else b[0].out)]


def _blocks(page: str, nodes: list[Node]) -> Iterator[Block]:
    """Blocks outside elements that are boilerplate by their tag; elements go to `nodes`."""
    root = owner = Node("#", "", None, False)
    nodes.append(root)
    stack = [root]
    is_open: dict[str, int] = {}
    held: list[str] = []
    linked = 0

    def close(to: int):
        for n in stack[to:]:
            is_open[n.tag] -= 1
        del stack[to:]

    def flush():
        nonlocal held, linked
        t = " ".join(html.unescape("".join(held)).split())
        out = (owner, t, linked) if t else None
        held, linked = [], 0
        return out

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        if m[4] is not None:
            if not stack[-1].skip:
                if not held:
                    owner = stack[-1].block
                held.append(m[4])
                if is_open.get("a"):
                    linked += len(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br" or tag == "wbr":
            if tag == "br" and held:
                held.append(" ")
            continue
        if tag not in INLINE and (b := flush()):
            yield b
        if m[1]:
            if is_open.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE:
                        break  # an inline end tag doesn't close blocks
            continue
        if tag in VOID:
            continue
        ends = ENDS_SELF.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        if any(is_open.get(t) for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in CONTAINER or stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, pos)
            pos = m.end() if m else end
            continue
        if m[3].endswith("/") and tag == "svg":
            continue
        names, words = _words(m[3]) if m[3] and "=" in m[3] else ([], set())
        step = ".".join([tag, *sorted(re.sub("[0-9]+", "", c) for c in names)])
        top = stack[-1]
        outermost = tag in ("article", "main") and top.scope is None
        node = Node(tag, step, top, not outermost and (top.skip or tag in BOILER and tag != "form"))
        if outermost:
            node.scope = node
        elif tag in INLINE:
            node.skip |= bool(words - NOTICE_WORDS)
        elif tag == "form":
            node.words = words | {"form"}
        elif words and tag not in ("html", "body", "article", "main"):
            node.words = words
        if tag in ("h1", "header", "footer", "nav") and is_open.get("form"):
            for n in reversed(stack):
                if n.tag == "form":
                    n.wraps = True
                    break
        stack.append(node)
        nodes.append(node)
        is_open[tag] = is_open.get(tag, 0) + 1
    if b := flush():
        yield b


def _best(nodes: list[Node], kept: list[Block]) -> tuple[str | None, float]:
    for n, t, linked in kept:
        n.worth += len(t) - 2 * linked
        n.holder.direct += max(0, len(t) - 2 * linked)
    total = sum(max(0, len(t) - 2 * linked) for _, t, linked in kept)
    for n in reversed(nodes):
        if n.parent:
            n.parent.worth += n.worth
    best = None
    for n in nodes:  # those that qualify enclose one another
        if best and best.direct and best.tag != "body":
            break
        if n.tag in CONTAINER and n.scope in (None, n) and n.worth > 0 and n.worth * (ARTICLE_BONUS if n.scope is n else 1) >= HOLDS * total:
            best = n
    return (best.path(), float(best.worth)) if best else (None, 0.0)


def best_container(page: str | None) -> tuple[str | None, float]:
    """(path, unlinked characters) of the innermost container that holds nearly all unlinked text; text in links counts against.

    None inside an article or inside a container (but the body) with such text of its own is a candidate.
    """
    return _best(*blocks(page or ""))


def _inside(nodes: list[Node], kept: list[Block], path: str) -> list[str]:
    """Texts of the blocks inside containers on the path."""
    steps = path.split("/")[1:]
    way: dict[Node, int] = {}  # steps matched so far; -1: off the path; all of them: inside
    for n in nodes:
        at = way[n.parent] if n.parent else 0
        if n.parent and n.block is n and 0 <= at < len(steps):
            at = at + 1 if n.step == steps[at] else -1
        way[n] = at
    return [t for n, t, _ in kept if way[n] == len(steps)]


def extract(page: str | None, path: str | None) -> str:
    """Blocks inside containers on the path; without one, inside the page's own best; without any, all blocks."""
    nodes, kept = blocks(page or "")
    if path is not None and (texts := _inside(nodes, kept, path)):
        return "\n".join(texts)
    own = _best(nodes, kept)[0]
    return "\n".join((_inside(nodes, kept, own) if own is not None else []) or [t for _, t, _ in kept])


HOST = re.compile(r"://([^/?#]*)")


def host_of(url: str | None) -> str:
    m = HOST.search(url) if url else None
    return m[1].lower() if m else ""


def votes(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row per host: the path with most votes."""
    def run(batches):
        for b in batches:
            got = [(host_of(u), *best_container(h)) for u, h in zip(b.column("_url").to_pylist(), b.column("_html").to_pylist())]
            hosts, paths, scores = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())],
                                             names=["host", "path", "score"])

    each = df.select(F.col(url).alias("_url"), F.col(page).alias("_html")).mapInArrow(run, "host string, path string, score double")
    # whole numbers add up the same in any order
    sums = each.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("score").cast("bigint")).alias("s"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("s"), F.col("path"))).alias("path"))


def main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars, path (the host's winner)."""
    pages = df.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(page).alias("_html"),
                      F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1)).alias("host"))

    def run(batches):
        for b in batches:
            texts = [extract(h, p) for h, p in zip(b.column("_html").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                              b.column("path")], names=["_id", "_url", "text", "n_chars", "path"])

    kind = df.schema[page_id].dataType.simpleString()
    # written first, so that its true size decides how it is joined and pages need not be dealt by host for a small table
    return (pages.join(cut_lineage(votes(df, url, page)), "host", "left").select("_id", "_url", "_html", "path")
            .mapInArrow(run, f"_id {kind}, _url string, text string, n_chars long, path string")
            .select(F.col("_id").alias(page_id), F.col("_url").alias(url), "text", "n_chars", "path"))
