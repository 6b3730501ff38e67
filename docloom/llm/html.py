"""Main text of web pages by equivalence-class template deduction.

A token is an element in its role: the path of tags (with their classes) that
leads to it.  Its occurrence vector counts it on each page of a host, and tokens
with one vector are an equivalence class: they come from one piece of the host's
template.  Vectors are never built.  Each page contributes a hash of (page,
count), and the exclusive or of these over a host's pages stands for the vector;
it combines before it is shuffled, so a host of any size is a few rows.

Classes that occur on at least ``SUPPORT`` of a host's pages are valid.  A class
is nested in another if its tokens stand below one of the other's (so the items
of a list lie in the class of the page's frame); classes that hang in no other
but the page itself and those nested in them are the host's template, and text
between their tokens fills slots, a slot for each innermost template token
around it.  Slots under a menu, header, footer, sidebar, notice, advert, form or
comment section are template too.  Of the others, those under an article or main
element are the main text; on a host whose template has neither, all are, but
for text of a grouping element that is a list of links.

Text is part of the template too: a grouping element (``GROUPS``), or a block in
none and in no article, with its path and all its text is a token, and where it
stands on ``SUPPORT`` of a host's pages and on ``SEVERAL`` at least, it is left
out.  Pages of the same text count once here, so that copies of a page are no
template, and what is or holds an article or main element stays.  A page that
would be left empty keeps such text.  A page without any of its host's main slots
is read by the same rule alone.

A page is read in one pass whose cost grows with its length only, however deep
its elements are nested: a path is a node with a parent, and stands as a hash.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch

SUPPORT = 0.5
#: Pages of different text that repeat an element's text, at least, for it to be the template's.
SEVERAL = 3
#: A grouping element of so many links, and with a larger share of its own characters in them, is a list of links.
MANY, LINKS = 3, 0.5

#: Elements that hold no main text, elements whose content is no markup, void and inline elements.
OUTSIDE = set("nav header footer aside form script style noscript template iframe object svg math canvas button select option textarea input dialog menu head title".split())
RAW = set("script style textarea title iframe noembed noframes xmp noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
LISTS = set("ul ol dl menu table select".split())
CLOSED_BY_OWN = set("li dt dd tr td th option thead tbody tfoot".split())
#: Elements that group blocks, whose text is compared between pages.
GROUPS = set("div section ul ol dl table fieldset figure details address center blockquote".split())
#: Words in class, id or role that mark what is no main text.
MARKS = set(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay newsletter "
    "subscribe signup login sidebar aside related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation masthead "
    "header footer comment comments commentlist reply replies disqus discussion widget toolbar pagination hidden".split()
)
#: A comment, an end tag, a start tag with its attributes (values in quotes or bare, as the standard has them), or a declaration.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+|[=\"'])*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
#: Words that leave the name of a marked element what it is, as in site-header; others, as in has-sidebar, do not.
PLACES = set("site page main global top bottom left right primary secondary sub list item area section box bar block slot unit".split())
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_PARTS = re.compile(r"[a-z]+")


@lru_cache(maxsize=16)
def _end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


@lru_cache(maxsize=1 << 16)
def _below(parent: int, step: str) -> int:
    """The hash of a path from that of its parent."""
    return _digest(f"{parent:x}/{step}")


@dataclass
class Page:
    """A page as read: paths as nodes, blocks of text in page order, and elements whose text is compared between pages.

    A step is a tag with its class; it starts with "!" where the element holds
    no main text by its class, id or role, and with "!!" where it holds none by
    its tag or as hidden.  Node 0 is the page itself.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    step: list[str] = field(default_factory=lambda: [""])
    count: list[int] = field(default_factory=lambda: [1])
    #: (node, text, whether it stands in a list of links)
    texts: list[tuple[int, str, bool]] = field(default_factory=list)
    #: (node, first block, end)
    spans: list[tuple[int, int, int]] = field(default_factory=list)
    #: by node: the path's hash, whether it is no main text, whether it is in an article or main element
    hash: list[int] = field(default_factory=list)
    out: list[bool] = field(default_factory=list)
    inner: list[bool] = field(default_factory=list)

    def finish(self) -> None:
        bare = self._bare()
        for node, (up, step) in enumerate(zip(self.parent, self.step)):
            step = step.lstrip("!") if node in bare else step
            self.hash.append(_below(self.hash[up], step) if node else 0)
            self.out.append(bool(node) and (self.out[up] or step.startswith("!")))
            self.inner.append(bool(node) and (self.inner[up] or _is_main(step)))

    def _bare(self) -> set[int]:
        """Nodes whose class marks nothing: what holds a main element or, if all articles lie in marked ones, an article."""
        hidden, marked, mains = [False], [False], []
        for node in range(1, len(self.step)):
            up, step = self.parent[node], self.step[node]
            hidden.append(hidden[up] or step.startswith("!!"))
            marked.append(marked[up] or step.startswith("!"))
            if _is_main(step) and not hidden[node]:
                mains.append(node)
        if any(not marked[n] for n in mains):
            mains = [n for n in mains if self.step[n].split(".")[0] == "main"]
        seen: set[int] = set()
        for node in mains:
            node = self.parent[node]
            while node and node not in seen:
                seen.add(node)
                node = self.parent[node]
        return {n for n in seen if self.step[n].startswith("!")}


def read(page: str) -> Page:
    """The page's paths, blocks and groups."""
    p, nodes = Page(), {}
    stack: list[tuple[str, int, int, int]] = []  # of open block elements: tag, node, first block, mains begun before
    places: dict[str, list[int]] = defaultdict(list)  # on the stack, by tag
    lists: list[int] = []
    groups: list[int] = []  # open grouping elements, numbered
    of_group: dict[int, list[int]] = {-1: [0, 0, 0]}  # own characters, those in links, links
    owner: list[int] = []  # by block
    parts: list[str] = []
    open_links = links = anchors = begun = within = 0

    def flush() -> None:
        nonlocal links, anchors
        text = " ".join("".join(parts).split())
        if text:
            node, group = stack[-1][1] if stack else 0, groups[-1] if groups else -1
            if not groups and not within:
                p.spans.append((node, len(p.texts), len(p.texts) + 1))
            p.texts.append((node, text, False))
            owner.append(group)
            for i, x in enumerate((len(text), min(links, len(text)), anchors)):
                of_group[group][i] += x
        parts.clear()
        links = anchors = 0

    def close(depth: int) -> None:
        nonlocal within
        while len(stack) > depth:
            tag, node, first, before = stack.pop()
            places[tag].pop()
            within -= _is_main(p.step[node])
            if tag in LISTS:
                lists.pop()
            if tag in GROUPS:
                groups.pop()
                if first < len(p.texts) and before == begun:
                    p.spans.append((node, first, len(p.texts)))

    def add(raw: str) -> None:
        nonlocal links
        text = _html.unescape(raw)
        parts.append(text)
        if open_links:
            links += len(text.strip())

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag, attributes = m[2].lower(), m[3]
            if tag in INLINE:
                if tag == "a" and not attributes.endswith("/"):
                    open_links, anchors = open_links + 1, anchors + 1
                continue
            if tag == "br":
                parts.append(" ")
                continue
            flush()
            if stack and stack[-1][0] == "p":  # a paragraph holds no blocks
                close(len(stack) - 1)
            if tag in CLOSED_BY_OWN and places[tag] and not (lists and lists[-1] > places[tag][-1]):
                close(places[tag][-1])
            open_links = 0
            up, step = stack[-1][1] if stack else 0, _step(tag, attributes)
            node = nodes.setdefault((up, step), len(p.step))
            if node == len(p.step):
                p.parent.append(up)
                p.step.append(step)
                p.count.append(0)
            p.count[node] += 1
            if tag not in VOID:
                places[tag].append(len(stack))
                if tag in LISTS:
                    lists.append(len(stack))
                if tag in GROUPS:
                    groups.append(len(of_group))
                    of_group[groups[-1]] = [0, 0, 0]
                stack.append((tag, node, len(p.texts), begun))
                begun += _is_main(step)
                within += _is_main(step)
            if tag in RAW:
                end = _end(tag).search(page, at)
                at = end.start() if end else len(page)
        elif m[1]:
            tag = m[1].lower()
            if tag in INLINE:
                open_links -= tag == "a" and open_links > 0
                continue
            flush()
            if places[tag]:
                close(places[tag][-1])
                open_links = 0
    flush()
    close(0)
    listed = {g for g, (n, linked, many) in of_group.items() if g >= 0 and many >= MANY and linked > LINKS * n}
    if listed:
        p.texts = [(node, text, g in listed) for (node, text, _), g in zip(p.texts, owner)]
    p.finish()
    return p


_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_tokens(p: Page) -> tuple[int, list[int | None]]:
    """(a hash of the page's text, the token of each span); a token is a hash of the element's path and blocks."""
    sums, powers, shown = [0], [1], 0
    for node, text, _ in p.texts:
        said = _digest(text)
        sums.append((sums[-1] * _BASE + (said ^ p.hash[node])) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
        shown = shown if p.out[node] else (shown * _BASE + said) % _PRIME
    tokens: list[int | None] = []
    for node, start, end in p.spans:
        inner = (sums[end] - sums[start] * powers[end - start]) % _PRIME
        tokens.append(None if p.out[node] else _digest(f"{p.hash[node]:x} {end - start} {inner}"))
    return shown, tokens


def without(p: Page, repeated: set[int]) -> list[bool]:
    """By block: whether it lies in an element of a repeated token."""
    edge = [0] * (len(p.texts) + 1)
    for (_, start, end), token in zip(p.spans, text_tokens(p)[1] if repeated else ()):
        if token in repeated:
            edge[start] += 1
            edge[end] -= 1
    return [n > 0 for n in np.cumsum(edge[:-1]).tolist()]


def _marked(name: str) -> bool:
    """Whether a whole class name, id or role marks what is no main text."""
    parts = {x for x in _PARTS.findall(name) if len(x) > 1}
    return bool(parts & MARKS) and parts <= MARKS | PLACES


@lru_cache(maxsize=1 << 14)
def _step(tag: str, attributes: str) -> str:
    named: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        named.setdefault(k.lower(), (a or b or c).strip().lower())
    main = "main" if "main" in named.get("role", "").split() else tag
    if tag in OUTSIDE or "hidden" in named or named.get("aria-hidden") == "true":
        out = "!!"
    else:
        free = main in ("html", "body", "article", "main")
        out = "!" * (not free and any(_marked(x) for k in ("class", "id", "role") for x in named.get(k, "").split()))
    return f"{out}{main}{'.' + '.'.join(sorted(_PARTS.findall(named['class']))) if named.get('class') else ''}"


def _is_main(step: str) -> bool:
    return step.lstrip("!").split(".")[0] in ("article", "main")


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


#: What a token's path says: it may hold main text; it lies in an article or main element.
_OPEN, _INNER = 1, 2


def _observe():
    """By host and path, combined within a batch: the parent's path, flags, pages, vector hash.

    And by host, without a path: tokens of text with the page's text; a null token for the page itself.
    """

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            said: dict[tuple[str, int | None, int], None] = {}
            for page_id, url, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                host, p = _host(url), read(text or "")
                whole, tokens = text_tokens(p)
                said |= dict.fromkeys((host, t, whole) for t in [None, *(t for t in tokens if t is not None)])
                rows: dict[int, list[int]] = {}
                for node, path in enumerate(p.hash):
                    row = rows.setdefault(path, [p.hash[p.parent[node]], _OPEN * (not p.out[node]) + _INNER * p.inner[node], 0])
                    row[2] += p.count[node]
                of = np.array([hash((-1 if page_id is None else page_id, r[2])) & 0xFFFFFFFFFFFFFFFF for r in rows.values()], np.uint64)
                for (path, r), h in zip(rows.items(), W.mix(of).view(np.int64).tolist()):
                    s = seen.setdefault((host, path), [r[0], r[1], 0, 0])
                    s[2] += 1
                    s[3] ^= h
            empty, some = [None] * len(said), [None] * len(seen)
            of, tokens, wholes = zip(*said) if said else ((), (), ())
            hosts, paths = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*hosts, *of], pa.string()), pa.array([*paths, *empty], pa.int64()),
                    *(pa.array([s[i] for s in seen.values()] + empty, pa.int64()) for i in range(4)),
                    pa.array([*some, *tokens], pa.int64()), pa.array([*some, *wholes], pa.int64()),
                ],
                names=["host", "path", "parent", "flags", "pages", "vector", "token", "whole"],
            )

    return run


def nest(classes: list[list[dict]]) -> dict[int, dict]:
    """The tokens of the classes that nest in the page, by path: each token's element lies in one of its class or of a class already in."""
    inside: dict[int, dict] = {}
    waiting = [{t["path"]: t for t in tokens} for tokens in classes]
    while True:
        after = [own for own in waiting if not all(not path or t["parent"] in own or not t["parent"] or t["parent"] in inside for path, t in own.items())]
        for own in waiting:
            if own not in after:
                inside |= own
        if len(after) == len(waiting):
            return inside
        waiting = after


def main_slots(classes: list[list[dict]]) -> tuple[set[int], set[int]]:
    """(slots of the template, those that hold main text); ``classes`` are a host's valid classes."""
    tokens = nest(classes)
    open_ = {p for p, t in tokens.items() if p and t["flags"] & _OPEN}
    return set(tokens), {p for p in open_ if tokens[p]["flags"] & _INNER} or open_


def extract_text(p: Page, slots: set[int], main: set[int], repeated: set[int]) -> str:
    """The main text of one page."""
    slot = [0] * len(p.hash)  # of each node: the innermost around it
    for node in range(1, len(p.hash)):
        slot[node] = p.hash[node] if p.hash[node] in slots else slot[p.parent[node]]
    for gone in (without(p, repeated), [False] * len(p.texts)):
        open_ = [(node, text, listed) for (node, text, listed), g in zip(p.texts, gone) if not g and not p.out[node]]
        inside = [(node, text, listed) for node, text, listed in open_ if slot[node] in main]
        inside = inside or [b for b in open_ if p.inner[b[0]]] or open_
        kept = [text for node, text, listed in inside if p.inner[node] or not listed]
        if kept:
            return " ".join(kept)
    return ""


def _extract():
    def run(batches):
        known: dict[str, tuple[set[int], set[int], set[int]]] = {}
        for batch in batches:
            out = []
            for host, page, template, repeated in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "template", "repeated"))):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = (*main_slots(template or []), set(repeated or []))
                out.append(extract_text(read(page or ""), *known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A null html is an empty page, whose text is empty; pages whose url is null or
    has no host share a template; rows that repeat are extracted each; nulls in
    page_id and url are returned as such.  An empty table gives an empty one;
    other columns play no part.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    seen = base.mapInArrow(_observe(), "host string, path long, parent long, flags long, pages long, vector long, token long, whole long")
    seen = scratch.save(seen)
    tokens = seen.where("path is not null").groupBy("host", "path").agg(
        F.min("parent").alias("parent"), F.min("flags").alias("flags"), F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector")
    )
    tokens = scratch.save(tokens)
    size = tokens.where("path = 0").select("host", F.col("pages").alias("all_pages"))
    # tokens of one vector are a class; a class is on as many pages as each of its tokens
    valid = tokens.join(size, "host").where(F.col("pages") >= SUPPORT * F.col("all_pages"))
    # a token on half of the pages or more: their number follows the pages' size, not their count
    classes = valid.groupBy("host", "vector", "pages").agg(F.sort_array(F.collect_list(F.struct("path", "parent", "flags"))).alias("tokens"))
    template = classes.groupBy("host").agg(F.sort_array(F.collect_list("tokens")).alias("template"))
    # pages of different text by token; few tokens are on several
    said = seen.where("path is null").select("host", "token", "whole").distinct().groupBy("host", "token").agg(F.count("*").alias("n"))
    said = scratch.save(said.where((F.col("n") >= SEVERAL) | F.col("token").isNull()))
    texts = said.where("token is null").select("host", F.col("n").alias("all_n"))
    repeated = said.where("token is not null").join(texts, "host").where(F.col("n") >= SUPPORT * F.col("all_n"))
    repeated = repeated.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("repeated"))
    template = scratch.save(template.join(repeated, "host", "left"))
    scratch.free(seen, said)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)", 1)
    rows = base.withColumn("host", F.lower(host)).join(template, "host", "left")
    return rows.mapInArrow(_extract(), "page_id long, url string, text string, n_chars long")
