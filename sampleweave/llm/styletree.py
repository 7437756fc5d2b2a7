"""Main text of web pages by a site style tree.

The pages of a host are merged by element path (tags with their classes, ids without digits, roles). A path's style node
knows on how many pages it appears, in which presentations (sequences of children) and with which content (sentences).
Presentation importance is the entropy of its presentations over the logarithm of its pages; content importance is one less
the mean entropy of its sentences (log of the pages with the sentence over log of the pages); the composite importance of an inner node
mixes its own with that of its children by ``damping``, as deep as the tree goes. Branches of low composite importance are cut
from every page: what looks and reads alike all over a site. Elements that name their role (navigation, footer, advert,
form, comments and so on, by tag, class, id or role) have no importance at all; where a page marks its article or main part,
only that is kept and only a much lower importance is cut there.

One pass over the pages emits hashes only; they are counted before they are gathered, and the tree of a host has one row per
path. A second pass cuts and writes the text. The paths to cut are broadcast if they are few enough (``broadcast_rows``, counted),
else pages are joined with them by host in ``salts`` parts.

Defined results: a null or empty page gives an empty text; unclosed or stray tags are closed as browsers do; a page whose every
branch is of low importance keeps what the roles leave, rather than nothing; repeated rows are treated alike; a null or odd address is a host of
its own. Nothing else is dropped or shortened.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.common import column, map_rows
from sampleweave.session import cut


@dataclass(frozen=True)
class TreeSettings:
    least_pages: int = 5  # a path on fewer pages of its host says nothing about the site
    low: float = 0.3
    low_inside: float = 0.05  # within the part that a page marks as its article
    damping: float = 0.9
    broadcast_rows: int = 100_000
    salts: int = 64


#: fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article main section div".split())
#: tags, words of classes and ids, and roles that name what is not the article
NO_TEXT_TAGS = frozenset("nav footer aside form button head menu dialog fieldset".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_TEXT_WORDS = re.compile(r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|foot|header|masthead|banner|sidebar|side|widgets?|aside|ads?|adverts?|advertisement|"
                           r"advertising|adbox|sponsor(?:ed)?|promo|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|newsletter|subscribe|signup|login|search|"
                           r"form|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommended|toolbar|pagination|pager|skip|copyright|legal)(?:[^a-z]|$)")
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|main|content|post|entry|story)(?:[^a-z]|$)")

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>?")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACES = re.compile(r"[\s​﻿]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def hashed(*parts) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts)) >> 1


class Element:
    __slots__ = ("tag", "path", "parent_path", "none", "main", "children", "outer")

    def __init__(self, tag: str, path: int, outer: Element | None, none: bool, main: bool):
        self.tag, self.path, self.outer, self.none, self.main = tag, path, outer, none, main
        self.parent_path = outer.path if outer else 0
        self.children: list[int] = []


def attributes(raw: str) -> tuple[str, str, str]:
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(raw)} if "=" in raw else {}
    return " ".join(sorted(found.get("class", "").split())), re.sub(r"\d+", "", found.get("id", "")), found.get("role", "")


def blocks(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """All elements of a page in closing order, and its blocks of text (element, text) in page order."""
    root = Element("", 1, None, False, False)
    now, done, out, held = root, [], [], []

    def flush() -> None:
        if held:
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                block = now
                while block.tag in INLINE and block.outer:
                    block = block.outer
                out.append((block, text))

    at, n, low = 0, len(page), None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        if lt > at:
            held.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            held.append("<")
            at = lt + 1
            continue
        at, closing, tag = m.end(), m[1], m[2].lower()
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag == "br":
            held.append(" ")
        if closing:
            up = now
            while up is not root and up.tag != tag:
                if not inline or up.tag in INLINE:
                    up = up.outer
                else:
                    up = root  # an inline end tag closes no block
            if up is not root:
                while now is not up:
                    done.append(now)
                    now = now.outer
                done.append(up)
                now = up.outer
            continue
        if not inline:
            while now.tag in INLINE and now.outer and tag != "p" and now.tag != "a":
                break
            if now is not root:
                p = now
                while p.tag in INLINE:
                    p = p.outer
                if p.tag == "p":  # a block ends an open paragraph
                    while now is not p:
                        done.append(now)
                        now = now.outer
                    done.append(p)
                    now = p.outer
            if tag in CLOSES:
                up = now
                while up is not root and up.tag not in CLOSES[tag] and up.tag not in SCOPES:
                    up = up.outer
                if up is not root and up.tag in CLOSES[tag]:
                    while now is not up:
                        done.append(now)
                        now = now.outer
                    done.append(up)
                    now = up.outer
        css, name, role = attributes(m[3])
        words = f"{css} {name}".replace("_", "-")
        inside = now.main
        none = now.none or tag in NO_TEXT_TAGS or role in NO_TEXT_ROLES or (tag == "header" and not inside) or (
            tag not in ("html", "body", "article", "main") and bool(words.strip()) and bool(NO_TEXT_WORDS.search(words)) and not MAIN_WORDS.search(words))
        signature = hashed(tag, css, name, role)
        if tag in RAW:
            low = low if low is not None else page.lower() if len(page.lower()) == n else page
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else (low.find(">", end) + 1 or n)
            now.children.append(signature)
            continue
        if inline and not none:
            if tag not in VOID:
                now = Element(tag, now.path, now, now.none, now.main)
            continue
        now.children.append(signature)
        if tag in VOID:
            continue
        now = Element(tag, hashed(now.path, signature), now, none, inside or tag in ("article", "main") or role in ("article", "main"))
    flush()
    while now is not root:
        done.append(now)
        now = now.outer
    return done, out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


PAGE, SHAPE, CONTENT = 0, 1, 2


def style_rows(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(host, html) to (host, path, parent, kind, mark), each once per page."""
    for host, page in rows:
        done, found = blocks(page or "")
        marks = {(e.path, e.parent_path, PAGE, 0) for e in done if e.tag not in INLINE}
        marks |= {(e.path, e.parent_path, SHAPE, hashed(e.children)) for e in done if e.tag not in INLINE}
        for e, text in found:
            if not e.none:
                marks |= {(e.path, e.parent_path, CONTENT, hashed(s.strip())) for s in SENTENCE.findall(text)}
        yield from ((host, *m) for m in marks)


def importances(pages: DataFrame, s: TreeSettings) -> DataFrame:
    """(host, path, importance, pages): the composite importance of every style node."""
    counted = (map_rows(pages.select("host", "html"), style_rows, "host string, path long, parent long, kind int, mark long")
               .groupBy("host", "path", "parent", "kind", "mark").agg(F.count("*").alias("k")))
    own = (counted.groupBy("host", "path", "parent")
           .agg(F.max(F.when(F.col("kind") == PAGE, F.col("k"))).alias("pages"),
                F.sum(F.when(F.col("kind") == SHAPE, F.col("k"))).alias("shown"),
                F.sum(F.when(F.col("kind") == SHAPE, F.col("k") * F.log("k"))).alias("klogk"),
                F.avg(F.when(F.col("kind") == CONTENT, F.log("k"))).alias("content")))

    def composite(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = {r.path: r for r in frame.itertuples()}
        children: dict[int, list] = {}
        for r in nodes.values():
            children.setdefault(r.parent, []).append(r)
        value: dict[int, float] = {}
        stack = [p for p in nodes]
        while stack:  # children first, without recursion
            p = stack[-1]
            open_ = [c.path for c in children.get(p, ()) if c.path not in value and c.path != p]
            if p in value:
                stack.pop()
            elif open_:
                stack += open_
            else:
                r, m = nodes[p], max(2.0, float(nodes[p].pages or 1))
                parts = []
                if r.content == r.content and r.content is not None:
                    parts.append((1.0, max(0.0, 1 - r.content / math.log(m))))
                below = children.get(p, ())
                parts += [(min(1.0, (c.pages or 1) / m), value[c.path]) for c in below]
                inner = sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else 0.0
                if below:
                    shown = max(1.0, float(r.shown or 1))
                    entropy = max(0.0, math.log(shown) - float(r.klogk or 0) / shown) / math.log(m)
                    share = s.damping ** len(below)
                    inner = max(inner, (1 - share) * min(1.0, entropy) + share * inner)
                value[p] = inner
                stack.pop()
        return pd.DataFrame({"host": frame["host"], "path": frame["path"], "importance": [value[p] for p in frame["path"]], "pages": frame["pages"].fillna(0).astype("int64")})

    return own.groupBy("host").applyInPandas(composite, "host string, path long, importance double, pages long")


def main_text(page: str, cut_outside: set[int], cut_inside: set[int]) -> str:
    _, found = blocks(page)
    roles = [(e, t) for e, t in found if not e.none]
    marked = [(e, t) for e, t in roles if e.main]

    def kept(pairs, low):
        out = []
        for e, t in pairs:
            up = e
            while up is not None and up.path not in low:
                up = up.outer
            if up is None:
                out.append(t)
        return out
    if marked:
        return "\n".join(kept(marked, cut_inside) or [t for _, t in marked])
    return "\n".join(kept(roles, cut_outside) or [t for _, t in roles])


def extract(pages: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """page_id, url, text and n_chars for every row."""
    s = settings
    rows = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), column(pages, "html", "string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    nodes = cut(importances(rows, s).where((F.col("pages") >= s.least_pages) & (F.col("importance") < s.low)).select("host", "path", "importance"))

    def texts(low_of):
        def run(batch: Iterable[tuple]) -> Iterator[tuple]:
            for page_id, url, page, *more in batch:
                outside, inside = low_of(*more)
                text = main_text(page or "", outside, inside)
                yield page_id, url, text, len(text)
        return run

    result = "page_id long, url string, text string, n_chars long"
    few = nodes.limit(s.broadcast_rows + 1).collect()
    if len(few) <= s.broadcast_rows:
        low: dict[str, tuple[set, set]] = {}
        for r in few:
            both = low.setdefault(r.host, (set(), set()))
            both[0].add(r.path)
            if r.importance < s.low_inside:
                both[1].add(r.path)
        sent = pages.sparkSession.sparkContext.broadcast(low)
        return map_rows(rows.select("page_id", "url", "html", "host"), texts(lambda host: sent.value.get(host, ((), ()))), result)
    by_host = (nodes.groupBy("host").agg(F.collect_set("path").alias("outside"), F.collect_set(F.when(F.col("importance") < s.low_inside, F.col("path"))).alias("inside"))
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1)))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(s.salts)).cast("int")).join(by_host, ["host", "salt"], "left")
    return map_rows(salted.select("page_id", "url", "html", "outside", "inside"), texts(lambda a, b: (set(a or ()), set(b or ()))), result)
