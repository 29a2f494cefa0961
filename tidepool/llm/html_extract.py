"""Main text of web pages by composite text density (operator 2).

A page becomes a tree in one pass of a tokenizer that accepts any markup:
unclosed and crossed tags, attributes without quotes, pages cut short. Elements
that are page furniture by their tag, role, class or id are set aside. For every
other node, characters and tags are summed upwards, with those of links beside
them. The composite density of a node is its characters per tag, scaled by a
logarithm that falls as the share of links grows. The node whose children's
densities have the largest sum is the core; the least density on its path to the
body is the threshold. Every other subtree beside the path that reaches the
threshold, and is not mostly links, adds its own core: the node of the largest
density sum in it. A core that is a single block stands for its container.

An article or main element breaks ties only: a core inside one is widened to it
if it, too, reaches the threshold, and articles beside a core's article are parts
like it. Headings that lead to a core belong to it. Lists of links are left out
beside the core's own blocks, never inside an article that is kept.

Blocks are the runs of text between block tags (and line breaks): references
decoded run by run, white space made one space, trimmed, empty ones left out,
joined by a line feed in page order.

Edge cases: null and empty pages, and pages without text, give the empty string;
pages of any length and depth are read whole, in time near linear; of nodes with
equal sums the first in the page is the core; repeated rows each get their row;
an empty table gives an empty result; other columns are not read. Text outside
any body counts as body.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "option", "optgroup", "caption", "tbody", "thead", "tfoot", "tr", "legend", "summary"}
_SCOPE = frozenset("html body table td th caption button object article section main div aside nav footer header form ul ol dl blockquote li dd dt template".split())
_P_SCOPE = _SCOPE - {"p"}
_CONTAINER = frozenset("div section ul ol dl table menu tbody center".split())
_CORE = frozenset("article main".split())
_HEADING = frozenset("h1 h2 h3".split())
#: Elements, roles and parts of class names and ids that mark page furniture.
_FURNITURE = frozenset("nav footer aside form button select input menu dialog svg canvas object embed template label fieldset datalist audio video".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: A name that begins or ends with one of these is furniture, unless a word before denies it.
_STRONG = frozenset(
    """ad ads adbox advert adverts advertisement advertising adsense advertorial sponsored promo promotion
    cookie cookies consent gdpr sidebar aside nav navbar navigation breadcrumb breadcrumbs footer masthead
    comment comments commentlist disqus newsletter popup modal paywall""".split()
)
_DENIED = frozenset("has no not without with non hide hidden".split())
#: A name made of these and of words that say nothing of their own is furniture.
_WEAK = frozenset(
    """sponsor banner notice notices notification alert warning disclaimer rail menu topbar toolbar reply replies respond
    discussion share sharing social related recommended recommendations recirc subscribe subscription signup login overlay
    widget widgets pagination pager hidden copyright legal teaser teasers tags tagcloud skip search""".split()
)
_NEUTRAL = frozenset(
    """site page web box bar wrap wrapper container holder block section area panel inner outer top bottom left right
    main primary secondary global list item items group row col column link links button buttons icon icons text title
    header head body content form field post posts article articles entry user reader readers story stories more
    bottom float sticky fixed desktop mobile small large module unit slot the to and for us""".split()
)


#: Of the text outside furniture tags, so much makes a set-aside element its sole holder, if no article or main is there.
SOLE_SHARE = 0.9


#: Only elements that hold blocks, or inline ones outside the flow of text, are furniture by name.
_NAMED = frozenset("div section ul ol dl table tbody tr td header span details center blockquote figure iframe ins".split())


@lru_cache(maxsize=10_000)
def _names_furniture(name: str) -> bool:
    """Whether a class name or id says that its element is furniture: by its first or last word, or by all its words."""
    parts = [p.lower() for p in _PART.findall(name)]
    words = [p for p in parts if not p.isdigit()]
    if not words or words[0] in _DENIED and len(words) > 1:
        return False
    if words[0] in _STRONG or words[-1] in _STRONG:
        return True
    return any(w in _WEAK for w in words) and all(w in _WEAK or w in _NEUTRAL or w in _STRONG for w in words)


class Page:
    """The tree of a page, as parallel lists in page order; parents come before children."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.aside = ["#page"], [-1], [False]
        self.runs: list[tuple[int, str | None]] = []  # (node, text), None: a block ends
        self.last: list[int] = [0]
        self._build(source)
        self._set_holders_back()
        self._measure()

    def _build(self, source: str) -> None:
        runs, stack = self.runs, [0]
        self.open: dict[str, list[int]] = {}  # where in the stack each tag is open
        at, end, lowered = 0, source.rfind(">") + 1, None
        while at < len(source):
            m = _TOKEN.search(source, at, end) if at < end else None
            upto = m.start() if m else len(source)
            if upto > at:
                runs.append((stack[-1], source[at:upto]))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing = name.lower(), m[1] or m[4]
            if tag in _BLOCK:
                runs.append((stack[-1], None))
            if closing:
                self._close(stack, tag)
                continue
            if tag in _CLOSES_P:
                self._close(stack, "p", _P_SCOPE)
            if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
                self._close(stack, tag, frozenset(("ul", "ol", "dl", "menu", "select", "table")) if tag not in ("td", "th") else frozenset(("tr", "table")))
                if tag in ("td", "th"):
                    runs.append((stack[-1], " "))
            attributes = m[3] or m[6] or ""
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.aside.append(self._is_furniture(tag, attributes))
            self.last.append(node)
            if tag in _RAW:
                if lowered is None:
                    lowered = source.lower() if source.isascii() else "".join(c.lower() if c.isascii() else c for c in source)
                stop = lowered.find(f"</{tag}", at)
                at = len(source) if stop < 0 else stop
                if stop >= 0:
                    close = source.find(">", stop)
                    at = len(source) if close < 0 else close + 1
            elif tag not in _VOID and not attributes.endswith("/"):
                self.open.setdefault(tag, []).append(len(stack))
                stack.append(node)

    def _close(self, stack: list[int], tag: str, within: frozenset = frozenset()) -> None:
        """Close the nearest open ``tag``, and what is open inside it, unless one of ``within`` holds it."""
        opened = self.open
        at = opened.get(tag)
        if not at or any(opened[x][-1] > at[-1] for x in within if opened.get(x)):
            return
        last = at[-1]
        for node in stack[last:]:
            opened[self.tag[node]].pop()
        del stack[last:]

    def _is_furniture(self, tag: str, attributes: str) -> bool:
        if tag in _FURNITURE:
            return True
        if tag == "header" and not any(self.open.get(t) for t in _CORE):
            return True
        if not attributes or tag in ("html", "body", "article", "main", "a"):
            return False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            if key == "role" and value.strip().lower() in _ROLES:
                return True
            if key in ("class", "id") and tag in _NAMED and any(_names_furniture(name) for name in value.split()):
                return True
        return False

    def _set_holders_back(self) -> None:
        """What holds an article or main element isn't furniture, whatever its name; nor is a sole holder of all text."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        fixed = [t in _FURNITURE and t != "form" for t in tag]
        holds = [t in _CORE for t in tag]
        for i in range(n - 1, 0, -1):
            if holds[i] and tag[i] not in _FURNITURE:
                holds[parent[i]] = True
                if tag[i] not in _CORE:
                    self.aside[i] = False
        if not holds[0]:
            size = [0] * n
            for node, text in self.runs:
                if text is not None:
                    size[node] += len(text) - text.count(" ") - text.count("\n")
            for i in range(n - 1, 0, -1):
                if not fixed[i]:
                    size[parent[i]] += size[i]
            for i in range(1, n):
                if not fixed[i] and size[i] and size[i] >= SOLE_SHARE * size[0]:
                    self.aside[i] = False
        for node in range(1, len(self.tag)):
            if self.aside[self.parent[node]]:
                self.aside[node] = True

    def _measure(self) -> None:
        n, parent = len(self.tag), self.parent
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or self.tag[i] == "a"
        for node, text in self.runs:
            if text is not None and not self.aside[node]:
                size = len(text) - text.count(" ") - text.count("\n")
                chars[node] += size
                if in_link[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if self.aside[i]:
                continue
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = link_chars[body] / max(chars[body], 1)
        density = [0.0] * n
        for i in range(n):
            c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], link_tags[i]
            if c and not self.aside[i]:
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                density[i] = c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-9) / math.log(base + 1e-9) if base > 1.0000001 else c / t * math.log(c * t + 1)
        sums = [0.0] * n
        for i in range(1, n):
            if not self.aside[i]:
                sums[parent[i]] += density[i]
        # a leaf that holds text counts as its own child
        self.sums = [s if s or not d else d for s, d in zip(sums, density, strict=True)]
        self.chars, self.link_chars, self.link_tags, self.density, self.body = chars, link_chars, link_tags, density, body

    def cores(self) -> set[int]:
        """Nodes whose subtrees are the main text."""
        n = len(self.tag)
        usable = [i for i in range(n) if not self.aside[i] and self.chars[i]]
        if not usable:
            return set()
        best = max(usable, key=lambda i: (self.sums[i], -i))
        threshold, up = self.density[best], self.parent[best]
        while up > 0 and up != self.body:
            threshold = min(threshold, self.density[up])
            up = self.parent[up]
        # subtrees beside the core's whose density reaches the threshold add their own best node
        on_path, up = {best}, self.parent[best]
        while up >= 0:
            on_path.add(up)
            up = self.parent[up]
        top: dict[int, int] = {}
        owner = [-1] * n
        for i in range(1, n):
            p = self.parent[i]
            if self.aside[i]:
                continue
            if owner[p] >= 0:
                owner[i] = owner[p]
            elif p in on_path and i not in on_path and self._reaches(i, threshold):
                owner[i] = i
            if owner[i] >= 0 and (owner[i] not in top or self.sums[i] > self.sums[top[owner[i]]]):
                top[owner[i]] = i
        out = {self._widened(self._container(best), threshold)} | {self._widened(i, threshold) for i in top.values()}
        # and so does every article, of however many below one such subtree; one next to a core article is a part like it,
        # whose density is lower than that of the whole just because it is smaller
        beside = {self.parent[i] for i in out if self.tag[i] == "article"}
        out |= {i for i in usable if self.tag[i] == "article" and self._reaches(i, 0.0 if self.parent[i] in beside else threshold)}
        return out | self._headings(out)

    def _reaches(self, node: int, threshold: float) -> bool:
        return self.density[node] >= threshold and self.chars[node] > 2 * self.link_chars[node]

    def _widened(self, node: int, threshold: float) -> int:
        """The nearest article, else main element, around the node if it reaches the threshold."""
        main, up = node, node
        while up > 0:
            if self.tag[up] in _CORE and self._reaches(up, threshold):
                if self.tag[up] == "article":
                    return up
                main = up if main == node else main
            up = self.parent[up]
        return main

    def _container(self, node: int) -> int:
        """Single blocks give way to what holds them."""
        while node > 0 and self.tag[node] not in _CONTAINER | _CORE | {"body"} and self.parent[node] > 0:
            node = self.parent[node]
        return node

    def _headings(self, cores: set[int]) -> set[int]:
        """Headings that are children of a core's ancestors below the body, or of the body itself, and stand before it."""
        first = min(cores)
        line, up = set(), self.parent[first]
        while up >= 0:
            line.add(up)
            up = self.parent[up]
        return {i for i in range(1, first) if self.tag[i] in _HEADING and self.parent[i] in line and not self.aside[i]}

    def _link_lists(self, cores: set[int]) -> list[bool]:
        """Containers made of links, and all below them; none inside an article or main element that is a core."""
        n = len(self.tag)
        out, kept = [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            kept[i] = kept[p] or (i in cores and self.tag[i] in _CORE)
            out[i] = out[p] or (not kept[i] and self.tag[i] in _CONTAINER and self.link_tags[i] >= 3 and self.link_chars[i] > 0.6 * self.chars[i])
        return out

    def text(self) -> str:
        cores = self.cores()
        if not cores:
            return ""
        links, inside = self._link_lists(cores), [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = i in cores or (i > 0 and inside[self.parent[i]])
        blocks, parts = [], []

        def end() -> None:
            if parts:
                block = _SPACE.sub(" ", "".join(map(_html.unescape, parts))).strip()
                if block:
                    blocks.append(block)
                parts.clear()

        for node, run in self.runs:
            if run is None:
                end()
            elif inside[node] and not self.aside[node] and not links[node]:
                parts.append(run)
        end()
        return "\n".join(blocks)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page. A narrow map: a page at a time, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), text_of(html_column).alias("html"))
    return mapped(rows, run, "page_id long, url string, text string, n_chars long")
