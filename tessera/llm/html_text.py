"""HTML extraction by consensus host paths.

Each page's containers are scored by the text below them that is no boilerplate and no link; the smallest one
that holds all of the page's is the page's choice, or the article or main around it with no other such text. A first
heading's links count as text. The choice's generalised path, tags with classes in which digits count alike, gets
that text's length as a vote for its host, summed in Spark. Each page is then extracted again from the containers
with its host's winning path if they hold all of that text too, or else from its own choice.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage, utf8, slices
from .url_filter import split_url

#: Hosts with most votes, whose paths are broadcast: any other host has less than 1/HOT of them.
HOT = 1024
#: Hosts whose paths are all broadcast, about 100 bytes each, at most.
BROADCAST_HOSTS = 1 << 18

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_CONTAINER = set("html body article section main div td table center blockquote dl ul ol".split())
_DROPPED = set("head nav header footer aside form button select option input label fieldset menu dialog svg canvas object audio video map iframe search".split())
#: Class, id and role names of what is no article text: a whole name, or one of these words and _PLAIN alone (site-footer).
_NOISE = set(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted sidebar side aside
    menu nav navbar navigation breadcrumb breadcrumbs toc header masthead topbar footer foot bottom copyright legal comment comments reply replies discussion
    disqus respond notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login social share sharing
    related recommended recommendations widget widgets search pagination pager skip hidden complementary contentinfo""".split()
)
_PLAIN = {"", "site", "global"}
#: What an open element is closed by.
_CLOSED_BY = {
    "p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body", *"article div p main section nav header h1 table ul".split()},
}
#: By an element that opens, what it closes.
_CLOSES = {tag: frozenset(x for x, by in _CLOSED_BY.items() if tag in by) for tag in set().union(*_CLOSED_BY.values())}
#: Where the search for an element to close stops.
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "p": {"td", "th", "table", "button"}}


@lru_cache(1 << 16)
def _key(parent: int, name: str) -> int:
    """A path's number, from that of the path above and the last name."""
    return int.from_bytes(hashlib.blake2b(f"{parent} {name}".encode(errors="replace"), digest_size=8).digest(), "big")


def key_of(path: str) -> int:
    key = 0
    for name in path.split(">") if path else ():
        key = _key(key, name)
    return key


class _Node:
    __slots__ = ("tag", "parent", "name", "key", "dropped", "noise", "link", "text", "depth")

    def __init__(self, tag, parent, name, dropped, noise, link):
        self.tag, self.parent, self.name = tag, parent, name
        self.key = _key(parent.key, name) if parent else 0
        self.dropped, self.noise, self.link, self.text, self.depth = dropped, noise, link, 0, parent.depth + 1 if parent else 0

    @property
    def path(self) -> str:
        return ">".join(x.name for x in reversed([self, *_above(self)]) if x.parent)


class _Stack(list):
    """The open elements; how often each tag is open; and the places of those that aren't inline."""

    def __init__(self, root):
        super().__init__([root])
        self.open, self.solid = Counter(), [0]

    def push(self, node) -> None:
        if node.tag not in _INLINE:
            self.solid.append(len(self))
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, at: int) -> None:
        self.open.subtract(x.tag for x in self[at:])
        del self[at:]
        while self.solid[-1] >= at:
            self.solid.pop()

    def last(self, tag) -> int:
        return next(k for k in range(len(self) - 1, 0, -1) if self[k].tag == tag)

    def block_above(self, at: int) -> bool:
        """Whether a block is open inside the element at a place."""
        for k in reversed(self.solid):
            if k <= at:
                return False
            if self[k].tag in _BLOCK:
                return True
        return False


def _is_noise(name: str) -> bool:
    words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
    return not words <= _PLAIN and words <= _NOISE | _PLAIN


def _names_of(attributes: str) -> tuple[list[str], bool, bool]:
    """Classes; whether a name of class, id or role is noise; whether hidden."""
    classes, noise, hidden = [], False, False
    if "=" in attributes or "hidden" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value, key = next((v for v in values if v), ""), key.lower()
            if key == "class":
                classes = value.split()
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            if key in ("class", "id", "role"):
                noise = noise or any(map(_is_noise, value.split()))
    return classes, noise, hidden


def parse(page: str):
    """The text blocks of a page in order, as (node, text), and its nodes; lenient to missing and crossed tags.

    Elements with a noise name go with all below them, but not one that holds a main, or an article that is in no
    other one, or over half of the page's text where no article or main stands beside it; nor any if no text would be left.
    """
    nodes, buffers = _scan(page)
    named = [x for x in nodes if x.noise and not x.dropped]
    blocks = _blocks(nodes, buffers, set())
    if named:
        total, spared, under, homes, inside = nodes[0].text, set(), set(), set(), Counter()
        for x in nodes:  # parents come first
            if x.parent is not None and (x.parent.noise or x.parent in under):
                under.add(x)  # something above is named as noise
            if x.tag in ("article", "main") and not x.dropped:
                if x.tag == "main" or not _has(x, "article"):
                    y = x.parent
                    while y is not None and y not in spared:
                        spared.add(y)
                        y = y.parent
                if x.text and x not in under:
                    homes.add(x)
        for x in nodes[1:]:
            inside[x] = inside[x.parent] + (x.parent in homes)
        spared.update(x for x in named if 2 * x.text > total and inside[x] == len(homes))
        noise = {x for x in named if x not in spared}
        for x in nodes:  # parents come first
            if x.parent in noise:
                noise.add(x)
        if noise:
            for x in nodes:
                x.text = 0
            blocks = _blocks(nodes, buffers, noise)
            if not blocks:
                for x in nodes:
                    x.text = 0
                blocks = _blocks(nodes, buffers, set())
    return nodes, blocks


def _has(node, tag: str) -> bool:
    return any(x.tag == tag for x in _above(node))


def _above(node) -> list:
    out = []
    while (node := node.parent) is not None:
        out.append(node)
    return out


def _blocks(nodes, buffers, noise):
    """The blocks of buffers of (node, text) without what is in noise; adds their weights to the nodes."""
    blocks = []
    for buffer in buffers:
        kept = [(x, t) for x, t in buffer if x not in noise] if noise else buffer
        text = " ".join(_html.unescape("".join(t for _, t in kept)).split())
        if text:
            owner = kept[0][0]
            while owner.tag not in _BLOCK and owner.parent is not None:
                owner = owner.parent
            blocks.append((owner, text))
            owner.text += max(0, len(text) - 2 * sum(len(t) for x, t in kept if x.link))
    for x in reversed(nodes):  # parents come first in nodes
        if x.parent is not None:
            x.parent.text += x.text
    return blocks


def _scan(page: str):
    """The nodes of a page, and for each block its texts as (node, text)."""
    root = _Node("", None, "", False, False, False)
    stack, nodes, buffers, buffer, at, n = _Stack(root), [root], [], [], 0, len(page)
    lower = None

    def flush():
        nonlocal buffer
        if buffer:
            buffers.append(buffer)
        buffer = []

    def add(text):
        top = stack[-1]
        if text and not top.dropped:
            buffer.append((top, text))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if following != "/" and not following.isalpha():
            add("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1  # a tag that the page's end cuts, or </ without a name
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                add(" ")
            elif not stack.open[tag]:
                if tag == "p":
                    flush()
            else:
                k = stack.last(tag)
                if tag in _BLOCK:
                    flush()
                elif stack.block_above(k):
                    if tag in _INLINE:
                        continue  # a crossed inline end tag doesn't close blocks
                    flush()
                stack.cut(k)
            continue
        if tag in _BLOCK:
            flush()
        if any(stack.open[x] for x in _CLOSES.get(tag, ())):
            for k in reversed(stack.solid[1:]):
                x = stack[k].tag
                if tag in _CLOSED_BY.get(x, ()):
                    stack.cut(k)
                    break
                if x in _SCOPE.get(tag, ()) or x in _CONTAINER and tag not in ("body",) and x not in ("ul", "ol", "dl"):
                    break
        if tag == "br":
            add(" ")
            continue
        if tag in _VOID:
            continue
        classes, named, hidden = _names_of(m[3]) if m[3] else ([], False, False)
        name = tag + "".join("." + re.sub(r"\d+", "0", c) for c in sorted(set(classes)))
        name = name.replace(">", "_")
        parent = stack[-1]
        noise = named and tag not in ("html", "body", "article", "main", "h1")
        node = _Node(tag, parent, name, parent.dropped or tag in _DROPPED or hidden or tag in _RAW, noise, parent.link or tag == "a" and not stack.open["h1"])
        if tag in _RAW:
            if lower is None:
                lower = page.lower()
            end = lower.find(f"</{tag}", at)
            if end < 0:
                break
            close = page.find(">", end)
            at = n if close < 0 else close + 1
            continue
        if m[3].endswith("/") and tag not in _BLOCK:
            continue
        stack.push(node)
        nodes.append(node)
    flush()
    return nodes, buffers


_INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var big strike".split())


def choose(nodes):
    """The page's choice: the smallest container with all of its text, widened to an article or main that adds
    only links."""
    total = nodes[0].text
    whole = [x for x in nodes if x.tag in _CONTAINER and total and x.text == total]
    named = [x for x in whole if x.tag in ("article", "main")]
    return max([x for x in named if x.tag == "article"] or named or whole or nodes[:1], key=lambda x: x.depth)


def extract_page(page: str | None, path: str | None = None) -> tuple[str, str, int]:
    """Text, the path used and its votes. path: the host's, or None for the page's own choice."""
    nodes, blocks = parse(page or "")
    # containers of one path don't hold each other, so their texts add up
    inside = {x for x in nodes if x.key == key} if path is not None and (key := key_of(path)) is not None else set()
    if inside and nodes[0].text and sum(x.text for x in inside) == nodes[0].text:
        used, votes = path, 0
    else:
        own = choose(nodes)
        inside, used, votes = {own}, own.path, own.text
    for x in nodes:  # parents come first
        if x.parent in inside:
            inside.add(x)
    return "\n".join(t for x, t in blocks if x in inside), used, votes


def _vote(batches):
    for batch in batches:
        found = [extract_page(h)[1:] for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([v for _, v in found], pa.int64())], names=["host", "path", "votes"])


def _extract(batches):
    for batch in batches:
        _, offsets = utf8(batch.column("html"))
        for a, b in slices(offsets, 4 << 20):
            part = batch.slice(a, b - a)
            found = [extract_page(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("url"), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([u for _, u, _ in found], pa.string())],
                names=["_id", "url", "text", "n_chars", "path"],
            )


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes) of each host's path with most votes, the first by name of equal ones. pages: (host, html)."""
    votes = pages.select("host", "html").mapInArrow(_vote, "host string, path string, votes long").filter("votes > 0")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return votes.withColumn("_k", first).filter("_k = 1").drop("_k")


def _by_host(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Pages with their host's path, where hosts are too many to broadcast: those with most votes are broadcast, as one
    may hold a third of all pages, and the pages of the others are shuffled by host."""
    hot = paths.orderBy(F.desc("votes"), "host").limit(HOT).select("host", "path", F.lit(True).alias("_hot"))
    marked = pages.join(F.broadcast(hot), "host", "left")
    cold = paths.select("host", "path").join(F.broadcast(hot.select("host")), "host", "left_anti")
    rest = marked.filter("_hot IS NULL").drop("path", "_hot").join(cold, "host", "left")
    return marked.filter("_hot IS NOT NULL").drop("_hot").unionByName(rest.select(*pages.columns, "path"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: id, url, text, n_chars (code points) and the path of the containers used.

    Blocks of text in page order, character references decoded, white space as one space, joined by one \\n; a
    line break element is white space. Pages of any length or depth are read whole; of a host's paths with equal votes
    the first by name wins. A null html counts as empty, which gives an empty text; a null url has
    an empty host. Repeated rows vote each and are extracted alike. An empty df gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    host, _ = split_url(F.col(url_col))
    pages = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    paths = stage(winning_paths(pages), "host-paths")
    few = paths.count() <= BROADCAST_HOSTS
    both = pages.join(F.broadcast(paths.select("host", "path")), "host", "left") if few else _by_host(pages, paths)
    kind = pages.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, url string, text string, n_chars long, path string"
    return both.select("_id", "url", "html", "path").mapInArrow(_extract, schema).withColumnRenamed("_id", id_col)
