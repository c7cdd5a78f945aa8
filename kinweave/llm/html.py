"""Main text of web pages: site templates found by counting subtree hashes per host.

Pass 1 parses each page and hashes its element subtrees (tag, attributes, text, children). Spark counts
on how many distinct pages of a host each hash occurs; copies of a page count once. Pass 2 parses again,
walks every page from its root and deletes

- subtrees that recur on ``MIN_PAGES`` or more distinct pages of their host and on ``SHARE`` of them;
  inside an article or main element on ``INSIDE_SHARE`` of them, if they have at most ``INSIDE_CHARS``
  characters, since paragraphs of copied articles recur on a host as well;
- elements that are never part of an article by their tag, or that are hidden;
- elements whose class, id or role names a part that is not the article, unless they hold half of
  the page's text and of its articles or more: such a name on a wrapper says nothing;
- outside articles, elements of which nearly all text is links.

What is left, of all parts of the page, is the text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, few

#: Distinct pages of a host on which a subtree must recur to be template: so many (all, on a host with
#: 2 to 4 distinct pages), and this share of the host's.
MIN_PAGES, SHARE = 5, 0.02
#: Share of the host's distinct pages, and characters at most, of a subtree inside an article that is template.
INSIDE_SHARE, INSIDE_CHARS = 0.3, 300
#: Share of a page's text from which an element is kept whatever it is called.
WRAPPER = 0.5
#: Links, and their share of the text, from which an element outside articles is a menu.
LINKS, LINKED = 3, 0.8
#: Template hashes up to this number are given to every task (8 bytes each); beyond, they are joined.
BROADCAST_HASHES = 4_000_000

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg select option button canvas audio video".split())
NEVER = RAW | frozenset("head nav header footer aside form menu dialog label fieldset figcaption".split()) - {"figcaption"}
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
_LIST_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words of class, id and role that mark parts which are not the article.
ASIDE = re.compile(
    r"(?<!has-)(?<!with-)(?<!no-)(?<!without-)(?:^|(?<=[\s_-]))(?:ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|comments?|comment-list|replies|disqus|share|social|related|recommend\w*|widget|search|login|signup|complementary|navigation|contentinfo|alert)(?:$|[\s_-])"
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "kids", "key", "chars", "linked", "links", "story")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.key = tag, attrs, [], None
        self.chars = self.linked = self.links = self.story = 0


def parse(text: str) -> Node:
    """A tree of elements and strings. Never fails: unknown ends are skipped, open elements end with
    their parents, paragraphs and list items end where the next one begins."""
    root = Node("")
    stack, at, n = [root], 0, len(text)
    last = text.rfind(">")
    while at < n:
        # behind the last > nothing is a tag, and each < would be tried to the end; a comment may stay open
        m = _TOKEN.search(text, at, last + 1) if at <= last else None
        if m is None or (m.end() > last and not text.startswith("<!--", m.start()) and m[0][-1] != ">"):
            rest = text[at:]
            stack[-1].kids.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        if m.end() > last and text.startswith("<!--", m.start()) and not m[0].endswith("-->"):
            stack[-1].kids.append(text[at : m.start()])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _LIST_ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _LIST_ENDS[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE.get(tag, ()):
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in ("script", "style", "textarea", "title", "iframe", "noscript"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def hashed(root: Node) -> bytes:
    """Gives each element of a tree its subtree's hash; pages may nest as deep as they like."""
    order = [root]
    for node in order:  # grows: children come after their parents
        order.extend(kid for kid in node.kids if not isinstance(kid, str))
    for node in reversed(order):
        h = blake2b(node.tag.encode("utf-8", "replace"), digest_size=8)
        h.update(" ".join(node.attrs.split()).encode("utf-8", "replace"))
        for kid in node.kids:
            if isinstance(kid, str):
                words = " ".join(kid.split())
                if words:
                    h.update(b"t" + words.encode("utf-8", "replace"))
            else:
                h.update(b"n" + kid.key)
        node.key = h.digest()
    return root.key


def measured(root: Node) -> Node:
    """Gives each element the characters of its text, those in links and in article or main elements, and
    its number of links. Elements that are never part of an article count nothing."""
    order = [root]
    for node in order:
        order.extend(kid for kid in node.kids if not isinstance(kid, str))
    for node in reversed(order):
        node.chars = node.linked = node.links = node.story = 0
        if node.tag in NEVER and node.tag != "header":
            continue
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len(kid.strip())
            else:
                node.chars += kid.chars
                node.linked += kid.linked
                node.links += kid.links
                node.story += kid.story
        if node.tag in ("article", "main"):
            node.story = node.chars
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
    return root


def named_aside(node: Node) -> bool:
    """Whether its class, id or role names a part that is not the article."""
    if "=" not in node.attrs or node.tag in ("body", "html", "article", "main"):
        return False
    return any(name.lower() in ("class", "id", "role") and ASIDE.search("".join(values).lower()) for name, *values in _ATTR.findall(node.attrs))


def hidden(node: Node) -> bool:
    if "hidden" not in node.attrs and "none" not in node.attrs.lower():
        return False
    for name, *values in _ATTR.findall(node.attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def wrapper(node: Node, root: Node) -> bool:
    """Whether an element holds so much of its page's text, and of its articles, that it is no part of it."""
    return node.chars >= WRAPPER * root.chars and node.story >= WRAPPER * root.story


def aside(node: Node, root: Node, inside: bool) -> bool:
    """Whether an element is no part of the text of its page; ``inside``: it stands in an article or main
    element."""
    if node.tag in NEVER and not (node.tag == "header" and inside):
        return True
    if node.attrs and (hidden(node) or (named_aside(node) and not wrapper(node, root))):
        return True
    return not inside and node.links >= LINKS and node.linked >= LINKED * node.chars and node.tag in BLOCK and not wrapper(node, root)


def walked(root: Node):
    """(element, inside an article or main element) of all that is not aside, parents first."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        within = inside or node.tag in ("article", "main")
        todo.extend((kid, within) for kid in reversed(node.kids) if not isinstance(kid, str) and not aside(kid, root, within))


def blocks(root: Node, template=None) -> str:
    """The text of a measured tree, a line for each block. ``template`` says whether an element (and
    whether it is inside an article) is to be deleted."""
    out, line = [], []

    def flush():
        words = " ".join("".join(line).split())
        line.clear()
        if words:
            out.append(words)

    todo = [(kid, root.tag in ("article", "main")) for kid in reversed(root.kids)]
    while todo:
        kid, inside = todo.pop()
        if kid is None:
            flush()
        elif isinstance(kid, str):
            line.append(html.unescape(kid))
        elif not aside(kid, root, inside) and not (template and template(kid, inside)):
            if kid.tag in BLOCK:
                flush()
                todo.append((None, inside))
            within = inside or kid.tag in ("article", "main")
            todo.extend((k, within) for k in reversed(kid.kids))
    flush()
    return "\n".join(out)


@lru_cache(maxsize=10_000)
def host_key(host: str) -> bytes:
    return blake2b(host.encode("utf-8", "replace"), digest_size=16).digest()


def number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def site_key(host: str, subtree: bytes) -> int:
    return number(blake2b(subtree, digest_size=8, key=host_key(host)).digest())


def subtrees(root: Node):
    """(element, inside an article) of those that may be template: all that hold no article, without the
    document's outer shells."""
    seen = list(walked(root))
    holders = set()
    for n, _ in reversed(seen):
        if n.tag in ("article", "main") or any(id(kid) in holders for kid in n.kids if not isinstance(kid, str)):
            holders.add(id(n))
        elif n is not root and n.tag not in ("html", "body", "head") and n.kids:
            yield n, _


def _survey(batches):
    """Keys of each page's subtrees, and one row with a null key for the page itself; pages without content give none."""
    for batch in batches:
        rows, keys, hosts, contents = [], [], [], []
        for i, (host, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            root = measured(parse(page or ""))
            if not root.kids:
                continue
            content = number(hashed(root))
            own = [None, *sorted({site_key(host or "", n.key) for n, _ in subtrees(root)})]
            rows += [i] * len(own)
            keys += own
            hosts += [number(host_key(host or ""))] * len(own)
            contents += [content] * len(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(x, pa.int64()) for x in (keys, hosts, contents))],
            names=["id", "key", "site", "content"],
        )


def _extract(shared):
    """Rows (row, host, html[, keys, strong]) to (row, text): by shared sorted keys, or by each row's own."""

    def run(batches):
        if shared is not None:
            common, strong = shared.value
        for batch in batches:
            texts = []
            own = [batch.column(i).to_pylist() for i in (3, 4)] if shared is None else None
            for i, (host, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                root = measured(parse(page or ""))
                hashed(root)
                if own is not None:
                    common = np.array(own[0][i] or (), np.int64)
                    order = np.argsort(common)
                    common, strong = common[order], np.array(own[1][i] or (), bool)[order]
                open_ = {id(n) for n, _ in subtrees(root)} if len(common) else ()

                def template(n, inside, host=host or "", common=common, strong=strong, open_=open_):
                    if id(n) not in open_ or (inside and n.chars > INSIDE_CHARS):
                        return False
                    k = site_key(host, n.key)
                    at = np.searchsorted(common, k)
                    return bool(at < len(common) and common[at] == k and (strong[at] or not inside))

                texts.append(blocks(root, template))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def host_of(url):
    """Host of a URL, lower-cased, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages`` (columns page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages give an empty text. Pages without a host share the empty host. Broken
    markup is read as far as it goes; character references are decoded in each piece of text, not across
    tags. Repeated rows give repeated results; pages of one content count
    as one page of their host. An empty table gives an empty result.
    """
    row = F.struct("page_id", "url").alias("row")
    src = pages.select(row, host_of(F.col("url")).alias("host"), "html", F.xxhash64("page_id", "url", "html").alias("id"))
    keys = src.select("id", "host", "html").transform(arrow, _survey, "id long, key long, site long, content long")
    seen = cut(keys.groupBy("key", "site", "content").agg(F.lit(1).alias("one")).groupBy("key", "site").agg(F.count("*").alias("pages")).where("key is null or pages > 1"))
    hosts = seen.where("key is null").select("site", F.col("pages").alias("of"))
    least = F.greatest(F.least(F.lit(min_pages), F.col("of")), F.ceil(F.col("of") * SHARE))
    strong = (F.col("pages") >= min_pages) & (F.col("pages") >= F.col("of") * INSIDE_SHARE)
    common = cut(seen.where("key is not null").join(few(hosts), "site").where(F.col("pages") >= least).select("key", strong.alias("strong")))
    schema = f"row struct<page_id:{pages.schema['page_id'].dataType.simpleString()},url:string>, text string"
    if common.count() <= BROADCAST_HASHES:
        table = common.toArrow().sort_by("key")
        shared = pages.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["strong"].to_numpy()))
        done = src.select("row", "host", "html").transform(arrow, _extract(shared), schema)
    else:
        own = keys.join(common, "key").select("id", "key", "strong").distinct().groupBy("id").agg(F.collect_list(F.struct("key", "strong")).alias("own"))
        joined = src.join(own, "id", "left").select("row", "host", "html", F.col("own.key").alias("keys"), F.col("own.strong").alias("strong"))
        done = joined.transform(arrow, _extract(None), schema)
    return done.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
