"""Main text of HTML pages by tree scoring.

A page is read once into a light tree of block elements. Each paragraph passes points for its
length and its commas to its ancestors, halved at each level and discounted by the share of its
characters that are links. Elements like nav, footer or form are left out. What a class, id or role
says against an element (menu, footer, advert, notice, comments and the like) is weighed against
the share of the page's characters that it holds: one with most of them, while no article stands
elsewhere, is text all the same. The container with most points (or the article around it) is kept
with those siblings that also read as text.

Defined results: a null or empty page, or one without text, gives the empty string; markup that is
never closed is read as far as it goes, a tag that is cut off by the page's end is dropped; each row has its own result, repeated or not;
other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quoted value stands behind an equals sign; a quote that is never closed is a character like others.
_REST = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|template|svg|iframe|xmp|noframes)(?=[\s/>]){_REST}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_REST})>|<[!?/][^>]*>|(?P<text>[^<]+)|<",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
#: Elements by what they do to the text around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head nav footer aside form menu dialog button select option input object canvas map audio video".split())
ENDED_BY_OWN_KIND = frozenset("p li dt dd tr td th option".split())
AGAINST = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs crumbs footer foot header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond disqus discussion related recommended recommendations widget form search toolbar pagination pager copyright legal disclaimer skip tags toc".split())
FOR = frozenset("article articles body content contents entry main page post story text prose".split())
PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


#: The share of a page's characters outside of links from which an element is text whatever its name, by how sure the name is.
SURE, UNSURE, ARTICLE = 0.8, 0.5, 0.3
HIDDEN = re.compile(r"style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
DOUBTFUL = frozenset("banner promo promotion promoted rail side header masthead notice notices notification alert popup modal overlay share sharing social widget form search legal disclaimer copyright tags skip related".split())


def limit_of(attrs: str) -> float | None:
    """The share of characters that outweighs what class, id or role say against an element (2: none
    does); None where they say nothing against it."""
    limit = None
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2.0
        if name == "role":
            if value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
                limit = max(limit or 0, SURE)
            continue
        for word in value.split():
            parts = [p for p in PART.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", word).lower()) if p]
            if not parts or parts[0] in ("has", "with", "no", "without"):
                continue
            bad = [p for p in parts if p in AGAINST]
            if bad and (parts[0] in AGAINST or parts[-1] in AGAINST or not any(p in FOR for p in parts)):
                mixed = any(p in FOR for p in parts) or all(p in DOUBTFUL for p in bad)
                limit = max(limit or 0, UNSURE if mixed else SURE)
    return limit


def speaks_for(attrs: str) -> bool:
    """Whether a whole word of a class or id says that this is the text, and nothing against it."""
    for name, value in ATTRIBUTE.findall(attrs):
        for word in value.strip("\"'").lower().split() if name.lower() in ("class", "id") else ():
            parts = [p for p in PART.split(word) if p]
            if any(p in FOR for p in parts) and not any(p in AGAINST for p in parts):
                return True
    return False


class Page:
    """Blocks of text and the tree they stand in. Each character is looked at a bounded number of
    times, however deep, wrong or unclosed the markup is."""

    def __init__(self, source: str):
        self.tags, self.parents, self.limits = ["html"], [-1], [None]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.open: dict[str, int] = {"html": 1}
        self.stack, self.parts, self.linked, self.links = [0], [], 0, 0
        # What follows the last ">" is text up to a tag that is cut off.
        end = source.rfind(">") + 1
        self.read(source[:end])
        self.say(re.split(r"<[a-zA-Z/!?]", source[end:], maxsplit=1)[0])
        self.flush()

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def flush(self) -> None:
        if self.parts:
            if text := " ".join(html.unescape("".join(self.parts)).split()):
                self.blocks.append((self.stack[-1], text, self.linked))
            self.parts, self.linked = [], 0

    def add(self, tag: str, limit: float | None) -> None:
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.limits.append(limit)
        self.stack.append(len(self.tags) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def leave(self) -> str:
        tag = self.tags[self.stack.pop()]
        self.open[tag] -= 1
        return tag

    def read(self, source: str) -> None:
        for m in TOKEN.finditer(source):
            if m["text"] is not None or m[0] == "<":
                self.say(m[0])
            elif tag := m["tag"]:
                if m["close"]:
                    self.closed(tag.lower())
                else:
                    self.opened(tag.lower(), m["attrs"])

    def closed(self, tag: str) -> None:
        top = self.tags[self.stack[-1]]
        if tag in INLINE:
            if tag == "a":
                self.links = 0
            if top == tag:  # only inline elements with names against them stand in the tree
                self.flush()
                self.leave()
        elif self.open.get(tag) and tag != "html":
            self.flush()
            while self.leave() != tag:
                pass
            self.links = 0

    def opened(self, tag: str, attrs: str) -> None:
        limit = limit_of(attrs) if attrs else None
        if attrs and HIDDEN.search(attrs):
            limit = max(limit or 0, SURE)
        if tag == "br":
            self.say(" ")
        elif tag in INLINE:
            self.links |= tag == "a"
            if limit and tag not in VOID:
                self.flush()
                self.add(tag, limit)
        else:
            self.flush()
            self.links = 0
            if tag in VOID:
                return
            while (top := self.tags[self.stack[-1]]) == "p" or tag in ENDED_BY_OWN_KIND and top == tag:
                self.leave()
            if tag in ("html", "body"):
                return
            if tag in ("article", "main"):
                # What is said against it is weighed as anywhere else, and less if its name speaks for it too.
                if limit and limit < 1 and speaks_for(attrs):
                    limit = ARTICLE
            elif tag[0] == "h" and tag[1:].isdigit() and top in ("header", "hgroup") and (self.open.get("article") or self.open.get("main")):
                # The article's own heading stands outside of its header.
                self.add(tag, None)
                self.parents[-1] = self.parents[self.stack[-2]]
                return
            elif tag == "form":
                limit = max(limit or 0, SURE)  # a whole page may stand in one
            elif tag in LEFT_OUT or tag == "header":
                limit = 2.0
            self.add(tag, limit)

    def sums(self, own: list[float], share: float = 1.0) -> list[float]:
        """What each node has and, by that share, what its children have."""
        total = own.copy()
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += share * total[k]
        return total

    def judge(self) -> tuple[list[bool], list[float]]:
        """Which nodes are left out, and each node's points."""
        n = len(self.tags)
        given, length, linked = ([0.0] * n for _ in range(3))
        for node, text, in_links in self.blocks:
            length[node] += len(text)
            linked[node] += min(in_links, len(text))
            if len(text) >= 25:
                points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(in_links / len(text), 1))
                given[self.parents[node] if self.tags[node] in ENDED_BY_OWN_KIND | {"blockquote", "pre"} else node] += points
        never = [False] * n  # left out whatever it holds
        article = [False] * n
        for k in range(1, n):
            up = self.parents[k]
            never[k] = never[up] or self.limits[k] == 2.0
        plain = [0.0 if never[k] else length[k] - linked[k] for k in range(n)]
        held = self.sums(plain)
        for k in range(1, n):
            large = not self.limits[k] or held[k] > self.limits[k] * held[0]
            article[k] = not never[k] and (article[self.parents[k]] or self.tags[k] in ("article", "main") and large)
        inner = self.sums([x if article[k] else 0.0 for k, x in enumerate(plain)])
        out = never.copy()
        for k in range(1, n):
            if not out[k] and (out[self.parents[k]] or self.limits[k] and (held[k] <= self.limits[k] * held[0] or inner[0] > inner[k])):
                out[k] = True
        total = self.sums([0.0 if out[k] else g for k, g in enumerate(given)], 0.5)
        length, linked = self.sums(length), self.sums(linked)
        return out, [t * (1 - linked[k] / length[k]) if length[k] else 0.0 for k, t in enumerate(total)]

    def text(self) -> str:
        out, points = self.judge()
        usable = [k for k in range(len(self.tags)) if not out[k]]
        best = max(usable, key=lambda k: (points[k], -k), default=0)
        at = best
        while at > 0:
            if self.tags[at] in ("article", "main"):
                best = at
                if self.tags[at] == "article":
                    break
            at = self.parents[at]
        kept = {best}
        if best and self.tags[best] not in ("article", "main"):
            least = max(10.0, 0.2 * points[best])
            kept |= {k for k in usable if self.parents[k] == self.parents[best] and (points[k] >= least or self.tags[k] in ("p", "h1", "h2", "h3", "blockquote"))}
        inside = [False] * len(self.tags)
        for k in range(len(self.tags)):
            inside[k] = k in kept or self.parents[k] >= 0 and inside[self.parents[k]]
        chosen = [text for node, text, _ in self.blocks if inside[node] and not out[node]]
        return " ".join(chosen or [text for node, text, _ in self.blocks if not out[node]])


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_main_text(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages)
