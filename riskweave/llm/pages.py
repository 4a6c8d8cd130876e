"""Main text of web pages: containers are scored per page, voted on per host, and read again by the winning path."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import emptied, filled, materialise

#: Hosts whose paths are sent to every executor, at most; beyond it pages and paths meet by host in a shuffle.
BROADCAST_HOSTS = 100_000
_LONGEST_PATH = 400

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>",
    re.S,
)
#: A tag that the page breaks off in.
_UNENDED = re.compile(r"<[a-zA-Z!?/][^>]*\Z")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg".split())
_CONTAINERS = frozenset("html body div main article section td center table tbody tr".split())
_BLOCKS = _CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption hr address details summary header footer nav aside form fieldset th thead tfoot caption hgroup".split()
)
_CELLS = frozenset(("td", "th"))
_SKIPPED = frozenset("nav header footer aside button select option datalist dialog menu head object canvas audio video map".split())
#: Words in a class, id or role that mark menus, headers, footers, sidebars, notices, adverts and reader comments.
_BOILERPLATE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer contentinfo sidebar aside complementary notice notices cookie cookies consent gdpr alert"
    " ad ads advert adverts advertisement advertising sponsor sponsored promo promotion popup modal newsletter subscribe signup login share sharing social related recommended"
    " comment comments respond disqus pagination pager toolbar search skip widget".split()
)
#: Of these, words that a page's own frame has too, and words that mean nothing inside main or article.
_FRAME = frozenset("header masthead banner footer".split())
_OUTSIDE = frozenset("search skip toolbar widget".split())
#: Words that say where or how; a name of others as well ("search-results-table", "related-work") marks nothing.
_PLACES = frozenset("site page main global top bottom left right primary secondary sticky fixed mobile desktop wrapper wrap container box area section block bar inner outer row column col".split())
_PARTS = _PLACES | frozenset("post entry article content list item items link links icon icons button buttons form text title message messages policy user reader".split())
#: Of these, words for what follows an article and may hold articles of its own.
_AFTER = frozenset("comment comments respond disqus related recommended".split())
_ANCHORS = frozenset(("main", "article"))
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _unwanted(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _SKIPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.I):
        return True
    return False


def _marks(tag: str, attributes: dict[str, str], inside: bool) -> set[str]:
    """Why an element is boilerplate unless it holds the article: words of a whole class, id or role, or form."""
    if tag in ("html", "body", "main", "article"):
        return set()
    if tag == "form":
        return {"form"}
    found: set[str] = set()
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
        marks = words & _BOILERPLATE
        if marks and words - marks <= (_PLACES if marks <= _FRAME else _PARTS):
            found |= marks - _OUTSIDE if inside else marks
    return found


class Page:
    """Containers as (parent, path) and text blocks as (container, text, characters in links).

    A second parse reads the marked elements that hold the article, if there are any.
    """

    def __init__(self, source: str):
        held = self._read(source, frozenset())
        if held:
            self._read(source, held)

    def _read(self, source: str, wanted: frozenset[int]) -> frozenset[int]:
        """Marked elements count as wanted if their number, in the order of the page, is in `wanted`. Those that should be."""
        self.parents, self.paths, self.blocks, self.anchored = [-1], [""], [], [False]
        # marked elements: parent, characters outside links, holds main or article, follows an article, anchors around it
        marked: list[list] = []
        # main and article elements outside marked ones: characters outside links
        anchors: list[int] = []
        total = 0
        # open elements: (tag, container, unwanted, in a link, never wanted, innermost marked element, anchors)
        stack: list[tuple[str, int, bool, bool, bool, int, tuple[int, ...]]] = [("", 0, False, False, False, -1, ())]
        open_tags: Counter[str] = Counter()
        held: list[str] = []
        at, links, size = 0, 0, len(source)

        def flush() -> None:
            nonlocal links
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1][1], text, links))
                held.clear()
            links = 0

        def add(text: str) -> None:
            nonlocal links, total
            top = stack[-1]
            if text and not top[3] and not top[4]:
                n = len(text.strip())
                total += n
                if top[5] >= 0:
                    marked[top[5]][1] += n
                elif top[6]:
                    anchors[top[6][-1]] += n
            if text and not top[2]:
                text = entities.unescape(text) if "&" in text else text
                held.append(text)
                links += len(text) if top[3] else 0

        def close(k: int) -> None:
            if any(x[0] in _BLOCKS for x in stack[k:]):
                flush()
            for x in stack[k:]:
                open_tags[x[0]] -= 1
            del stack[k:]

        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                add(_UNENDED.sub("", source[at:]))
                break
            add(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if m["end"]:
                if tag == "p" and not open_tags["p"]:
                    flush()
                if open_tags[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        if tag not in _BLOCKS and stack[k][0] in _BLOCKS:
                            break  # an inline end tag does not close blocks
                        k -= 1
                    if stack[k][0] == tag:
                        close(k)
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if tag in _CELLS:
                add(" ")
            if tag in _BLOCKS:
                if open_tags["p"] and tag != "p" or tag == "p":
                    self._imply(stack, open_tags, {"p"}, _CONTAINERS - {"p"}, close)
                if tag in _CLOSES:
                    self._imply(stack, open_tags, *_CLOSES[tag], close)
                flush()
            if tag in _VOID:
                if tag == "br":
                    add(" ")
                continue
            if m["rest"].endswith("/") and tag not in _BLOCKS:
                continue
            top = stack[-1]
            _, node, unwanted, _, never, mark, around = top
            if not never:
                attributes = _attributes(m["rest"]) if m["rest"] else {}
                never = _unwanted(tag, attributes)
                if not never and (marks := _marks(tag, attributes, bool(around))):
                    marked.append([mark, 0, False, not marks.isdisjoint(_AFTER), around])
                    mark = len(marked) - 1
                    unwanted = unwanted or mark not in wanted
                unwanted = unwanted or never
                if tag in _ANCHORS and not never:
                    if mark >= 0:
                        marked[mark][2] = True
                    else:
                        anchors.append(0)
                        around = (*around, len(anchors) - 1)
                if tag in _CONTAINERS and not unwanted:
                    node = self._container(node, tag, attributes)
            stack.append((tag, node, unwanted, top[3] or tag == "a", never, mark, around))
            open_tags[tag] += 1
        flush()
        for parent, n, holds, _, _ in reversed(marked):
            if parent >= 0:
                marked[parent][1] += n
                marked[parent][2] |= holds
        out = set()
        for k, (parent, n, holds, after, around) in enumerate(marked):
            apart = any(x and a not in around for a, x in enumerate(anchors))
            if (holds and not (after and apart) or 2 * n > total and not apart) and (parent < 0 or parent in out):
                out.add(k)
        return frozenset(out)

    @staticmethod
    def _imply(stack, open_tags, closed, walls, close) -> None:
        """Close the nearest of these elements unless one of the walls stands before it."""
        if not any(open_tags[t] for t in closed):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closed:
                close(k)
                return
            if stack[k][0] in walls:
                return

    def _container(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
        path = f"{self.paths[parent]}>{'.'.join([tag, *classes])}"
        if len(path) > _LONGEST_PATH:
            path = hashlib.md5(path.encode("utf-8", "replace")).hexdigest()
        self.parents.append(parent)
        self.anchored.append(tag in _ANCHORS or self.anchored[parent])
        self.paths.append(path)
        return len(self.paths) - 1

    def scores(self) -> list[int]:
        """Per container, its characters outside links less those inside, with all below it."""
        out = [0] * len(self.paths)
        for node, text, links in self.blocks:
            out[node] += len(text) - 2 * min(links, len(text))
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += max(0, out[k])
        return out

    def _held(self) -> list[int]:
        """Per container, how many blocks of more text than links it holds, with all below it."""
        out = [0] * len(self.paths)
        for node, text, links in self.blocks:
            out[node] += len(text) > 2 * links
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out

    def best(self) -> tuple[str, int]:
        """Path and score of the page's container: the innermost that holds every block of more text than links."""
        held = self._held()
        at = max((k for k, n in enumerate(held) if n == held[0]), default=0) if held[0] else 0
        return self.paths[at], max(0, self.scores()[at])

    def fits(self, path: str) -> bool:
        """There are containers of this path, and no text of main or article is outside them."""
        inside = self._inside(path)
        return any(inside) and all(inside[node] for node, text, links in self.blocks if self.anchored[node] and len(text) > 2 * links)

    def _inside(self, path: str) -> list[bool]:
        inside = [False] * len(self.paths)
        for k, p in enumerate(self.paths):
            inside[k] = p == path or k > 0 and inside[self.parents[k]]
        return inside

    def text(self, path: str) -> str:
        inside = self._inside(path)
        return "\n\n".join(text for node, text, _ in self.blocks if inside[node])


def host_of(url):
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(found, F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the container path that most pages of a host score best; ties go to more text, then the smaller path."""

    def run(batches):
        for pdf in batches:
            found = [Page(x).best() if x else None for x in pdf["html"]]
            rows = [(h, *f) for h, f in zip(pdf["host"], found, strict=True) if f is not None and h]
            yield pd.DataFrame(rows, columns=["host", "path", "score"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = rows.mapInPandas(run, "host string, path string, score long").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")).alias("best")
    return votes.groupBy("host").agg(best).select("host", "best.path")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    text holds the blocks of the host's winning container without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments, joined by a blank line. A page that lacks the path, has text of main or article
    outside it, or has no host, uses its own best container. Class words and forms do not make boilerplate of what holds
    main, article or most of the page's text outside links; beside an article with text of its own, they do so of comments,
    related matter, and elements with most of the text. Null and empty pages give empty
    text; malformed markup is read as far as it goes. A host's votes tie by more text, then by the smaller path. Repeated rows
    vote and come out as often as they stand there; a long or deeply nested page takes memory in proportion to itself.
    """
    paths = materialise(host_paths(pages, url_col, html_col))
    rows = pages.select(filled(F.col(id_col)).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    small = paths.count() <= broadcast_hosts
    joined = rows.join(F.broadcast(paths) if small else paths, "host", "left").select("page_id", "url", "html", "path")

    def run(batches):
        for pdf in batches:
            texts = []
            for source, path in zip(pdf["html"], pdf["path"], strict=True):
                page = Page(source or "")
                texts.append(page.text(path if path is not None and page.fits(path) else page.best()[0]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long").withColumn("page_id", emptied(F.col("page_id")))
