"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged into one tree. A node of it is a place
(the path of tags with their classes); it remembers the ways its children were
laid out on the pages (presentation) and what text they held (content). A node
whose presentation or content varies over the pages is important, one that is
the same everywhere is a template: importance is the entropy over the pages,
divided by that of all pages being different. Per page, branches in which all is
of low importance go, as do those whose tag or class says that they are not the
article. An article or main element is evidence, not a switch: places inside are
judged as well, and of such elements and the rest of the page those are taken
that hold the most text of importance.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved

# Element names of the HTML standard by how they are laid out or closed, and names sites use for what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas select annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav header footer aside form menu button dialog fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: A class or id with one of these words isn't the article's.
ABOUT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs comment comments disqus reply replies respond cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe signup login sidebar navbar navigation pagination pager toolbar masthead".split()
)
#: Nor is one with these, unless it has words that are not among PLACES: social-history or entry-header are the article's.
NAMES = frozenset("promotion banner nav menu aside footer header discussion notice notices search share sharing social related recommended widget skip legal copyright".split())
PLACES = frozenset(
    "site page main global top bottom left right upper lower primary secondary mobile sticky fixed wrapper wrap container inner outer box block blocks area section row col bar item items list group "
    "panel button buttons icon icons link links media posts articles stories widgets content c l m s x xl md sm lg d".split()
)
#: Start tags that end an open element of these names.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_INLINE_OPEN = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I)
_SPACES = re.compile(r"[\s ]+")
_NAME = re.compile(r"[a-z]+")
SEP = "/"
#: A path longer than this goes on from a digest.
LONG = 400


class Node:
    __slots__ = ("area", "children", "chrome", "important", "inside", "path", "tag")

    def __init__(self, tag: str, path: str, chrome: bool, inside: bool):
        self.tag, self.path, self.chrome, self.inside, self.children = tag, path, chrome, inside, []
        self.area, self.important = 0, True


def _named(value: str, anchor: bool = False) -> bool:
    """Whether one of the names in a class or id says that it isn't the article's. An anchor, the id of a heading or paragraph, is made of its text: it counts if all of it does."""
    for name in value.split():
        words = set(_NAME.findall(name))
        if anchor and not words <= ABOUT | NAMES | PLACES:
            continue
        if not ABOUT.isdisjoint(words) or (not NAMES.isdisjoint(words) and words <= NAMES | PLACES):
            return True
    return False


def _label(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """A node's part of the path, and whether its tag, role, class or id says that it isn't the article."""
    names: list[str] = []
    chrome = tag in CHROME and not (tag == "header" and inside)
    if "=" in attrs:
        for k, v in _ATTR.findall(attrs):
            k, v = k.lower(), v.strip("\"'").lower()
            if k == "class" or k == "id":
                names += _NAME.findall(v) if k == "class" else []
                chrome = chrome or _named(v, k == "id" and tag in ANCHORED)
            elif k == "role":
                chrome = chrome or v in ROLES
            elif (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in v.replace(" ", "")):
                chrome = True
    if "hidden" in attrs.lower() and _HIDDEN.search(_ATTR.sub(" ", attrs) if "=" in attrs else attrs):
        chrome = True
    return tag + "".join(f".{n}" for n in sorted(set(names))), chrome and tag not in ("html", "body", "article", "main")


def _below(path: str, part: str) -> str:
    """The path of a child; long ones go on from a digest of their beginning."""
    return f"{path}{SEP}{part}" if len(path) < LONG else f"#{_hash(path) & (1 << 64) - 1:016x}{SEP}{part}"


def _tags(text: str):
    """(text before, slash, name, attributes, end) for each tag; at the end of the page name is None.

    A tag whose quotes don't close ends at the next ">", and so do all tags after
    it, so that a broken page takes one pass as well. A tag that the page ends in is nothing.
    """
    at, n, trusted = 0, len(text), True
    begun = 0
    while (i := text.find("<", at)) >= 0:
        if text.startswith("<!--", i):
            end = text.find("-->", i + 4)
            yield text[begun:i], "", "", "", i
            begun = at = end + 3 if end >= 0 else n
        elif text.startswith("<![CDATA[", i):
            end = text.find("]]>", i)
            yield text[begun:i], "", "", "", i
            begun = at = end + 3 if end >= 0 else n
        elif text.startswith(("<!", "<?"), i):
            end = text.find(">", i)
            yield text[begun:i], "", "", "", i
            begun = at = end + 1 if end >= 0 else n
        elif not (name := _OPEN.match(text, i)):
            at = i + 1
        else:
            m = _TAG.match(text, i) if trusted else None
            if m:
                slash, tag, attrs, end = m[1], m[2], m[3], m.end()
            else:
                trusted, end = False, text.find(">", name.end())
                if end < 0:
                    yield text[begun:i], None, None, None, n
                    return
                slash, tag, attrs, end = name[1], name[2], text[name.end() : end], end + 1
            skip = yield text[begun:i], slash, tag.lower(), attrs, end
            begun = at = max(end, skip or 0)
    yield text[begun:], None, None, None, n


def parse(text: str) -> Node:
    """A tree that forgives what pages do: unclosed paragraphs and inline tags, stray end tags, cut-off ends."""
    root = Node("#", "", False, False)
    stack, opened, n = [root], Counter(), len(text)

    def close(i: int) -> None:
        opened.subtract(node.tag for node in stack[i:])
        del stack[i:]

    tags, skip = _tags(text), None
    while True:
        try:
            before, slash, tag, attrs, at = tags.send(skip)
        except StopIteration:
            return root
        skip = None
        if before:
            stack[-1].children.append(before)
        if not tag:
            continue
        if slash:
            if opened[tag] > 0:
                close(max(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
            continue
        if tag in BLOCK and opened["p"] > 0:
            # An open paragraph ends, with the inline tags in it.
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p":
                    close(i)
                    break
                if t not in _INLINE_OPEN:
                    break
        if tag in CLOSES and any(opened[t] > 0 for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        up = stack[-1]
        part, chrome = _label(tag, attrs, up.inside)
        node = Node(tag, _below(up.path, part), chrome or tag in RAW, up.inside or tag in ("article", "main"))
        up.children.append(node)
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            skip = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] += 1


def _walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children if isinstance(c, Node)]


def styles(root: Node) -> dict[str, tuple[str, str]]:
    """For each place of a page: how its children are laid out, and what text it holds itself."""
    layout: dict[str, list[str]] = {}
    for node in _walk(root):
        if node.chrome or not node.path:
            continue
        tags = [c.tag for c in node.children if isinstance(c, Node)]
        own = _SPACES.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        had = layout.setdefault(node.path, ["", ""])
        had[0] += ",".join(t for t, before in zip(tags, [None, *tags], strict=False) if t != before) + ";"
        had[1] += own + "\x00"
    return {p: (a, b) for p, (a, b) in layout.items()}


#: The rest of a page is taken for an article that has so many times less text; an article goes beside one that has so many times more.
REST, BESIDE = 2, 4


def _taken(root: Node, unimportant: frozenset[str] | set[str]) -> set[int]:
    """The areas whose text is the page's: an area is what is in an article or main element and in no other one inside it; 0 is the rest.

    Marks each node with its area and importance. Text counts if its place is of
    importance and it isn't in a link. In an article, words set off inside a block
    are as important as the block. Where all of the articles is the same on
    the host's pages, the tree can't tell what of it is the text, and all stays.
    """
    up, text, links, good = [0], [0], [0], [0]
    articles = []
    todo = [(root, 0, "", False)]
    while todo:
        node, area, block, link = todo.pop()
        if node.chrome:
            continue
        if node.tag in ("article", "main"):
            up.append(area)
            area = len(up) - 1
            for n in (text, links, good):
                n.append(0)
        block, link = node.path if node.tag in BLOCK else block, link or node.tag == "a"
        node.area, node.important = area, node.path not in unimportant or (area > 0 and block not in unimportant)
        if area:
            articles.append(node)
        size = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        (links if link else text)[area] += size
        good[area] += size if node.important and not link else 0
        todo += [(c, area, block, link) for c in node.children if isinstance(c, Node)]
    if len(up) == 1:
        return {0}
    if not any(good[1:]):
        good[1:] = text[1:] if any(text[1:]) else links[1:]
        for node in articles:
            node.important = True
    best = max(range(1, len(up)), key=lambda a: good[a])
    if good[0] > REST * good[best]:
        return {0}
    taken = {a for a in range(1, len(up)) if BESIDE * good[a] >= good[best]}
    while best:
        taken.add(best)
        best = up[best]
    return taken


def main_text(root: Node, unimportant: frozenset[str] | set[str] = frozenset()) -> str:
    """The blocks of importance of the areas that are taken, joined by an empty line."""
    taken = _taken(root, unimportant)
    blocks: list[str] = []
    buffer: list[str] = []

    def flush():
        block = _SPACES.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if block:
            blocks.append(block)

    todo: list = [root]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            buffer.append(node)
        elif isinstance(node, tuple):
            buffer.append(node[0])
        elif not node.chrome:
            if node.tag == "br":
                buffer.append(" ")
            block = node.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            own = node.area in taken and node.important
            keep = [c for c in node.children if isinstance(c, Node) or own]
            todo += keep[::-1]
    flush()
    return "\n\n".join(blocks)


def _host(url) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


_SEEN = "host string, path string, layout long, content long"


def _observe(batches):
    for batch in batches:
        out: list[tuple[str, str, int, int]] = []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = _host(url)
            for path, (a, b) in styles(parse(page or "")).items():
                out.append((host, path, _hash(a), _hash(b)))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "path", "layout", "content"])


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def style_tree(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """(host, path, pages, presentation, content): the merged tree with the entropy of each node's layouts and texts, 1 being all different.

    A node that one page alone has tells nothing and has 1; the same doubt goes
    for a page of any number: an entropy over n pages weighs n - 1, against one 1. Counting is by keys of
    host, place and hash, with sums before each shuffle, so a host with a third
    of all pages costs no more rows than its nodes have variants.
    """
    seen = pages.select(F.col(url).alias("url"), F.col(body).alias("html")).mapInArrow(_observe, _SEEN)
    kinds = seen.select("host", "path", F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("layout").alias("value")), F.struct(F.lit("c").alias("kind"), F.col("content").alias("value")))).alias("k"))
    counts = kinds.groupBy("host", "path", "k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    entropy = ((F.col("pages") - 1) * entropy + 1) / F.col("pages")
    return sums.groupBy("host", "path").agg(
        F.max("pages").alias("pages"), F.max(F.when(F.col("kind") == "p", entropy)).alias("presentation"), F.max(F.when(F.col("kind") == "c", entropy)).alias("content")
    )


def extract_text(pages: DataFrame, least_importance: float = 0.2, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A place's text goes if neither its layout nor its text reach
    ``least_importance`` over the pages of its host, which takes six pages at
    least; a branch goes if all its places do. White space inside a block
    is one space; blocks are joined by an empty line. A null or empty page has
    the empty text. Pages without a host in the url form a site of their own.
    Repeated rows are extracted each. A null page_id is passed on. Extra columns
    are ignored; an empty table gives an empty result.
    """
    tree = style_tree(pages, url, body)
    low = tree.where(F.greatest("presentation", "content") < least_importance)
    # A host's list of low places is as long as its template, however many pages it has.
    low = saved(low.groupBy("host").agg(F.collect_set("path").alias("low")), "templates")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = rows.withColumn("host", host).join(low, "host", "left").drop("host")

    def run(batches):
        for batch in batches:
            texts = [main_text(parse(page or ""), set(gone or ())) for page, gone in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def entropy(counts: list[int]) -> float:
    """The importance of a node from its variants' counts, for tests."""
    n = sum(counts)
    return 1.0 if n < 2 else ((n - 1) * (math.log(n) - sum(c * math.log(c) for c in counts) / n) / math.log(n) + 1) / n


