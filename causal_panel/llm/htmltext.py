"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes blocks of text (what stands between block-level tags). A linear classifier of a block's containers, links and length gives the
cost of either label; the costs are the capacities of the block's edges to the two terminals. Neighbours in page order and in one
container are tied by smoothness edges, the weaker the further apart they are in the DOM. A maximal flow finds the cheapest labelling.
"""
from __future__ import annotations

import html
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements without any text of the page; with their end tags they are skipped whole. But for scripts and styles, one that is never closed is not skipped.
SKIPPED = frozenset("script style template noscript iframe svg object canvas head title".split())
#: Elements that begin and end a block. Fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
#: Attributes that end in a slash which closes the element, not in one of an unquoted value.
_CLOSED = re.compile(r"(?:\A|[\s\"'])[^\s\"'=]*/\Z")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the left kind ends where one of the right kind begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: The classifier: evidence of content (above 0) or boilerplate (below) from a container's tag, and from words in its class, id and role.
TAG_EVIDENCE = {
    "article": 3.0, "main": 3.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "header": -6.0, "menu": -8.0, "dialog": -8.0, "button": -8.0,
    "select": -8.0, "option": -8.0, "textarea": -8.0, "fieldset": -8.0, "p": 0.5, "blockquote": 0.5, "pre": 0.5, "h1": 1.0, "h2": 0.5, "h3": 0.5,
}
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright "
    "dialog disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "recommend recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Of the boilerplate words, those that also name subjects or parts of an article: they count alone or among words for places and boxes only.
WEAK_WORDS = frozenset("alert banner dialog disclaimer form header login notice notices recommend recommended related reply respond search share sharing skip social".split())
PLACE_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content global group icons inner items left link links list main media outer page panel posts "
    "articles stories right row section site top wrap wrapper".split())
#: A class that begins so tells of a state of the element, not what it is.
STATE_WORDS = frozenset("has is no not with without".split())
NAMED_BOILERPLATE, NAMED_CONTENT, LINKED = -10.0, 2.0, -4.0
#: What all containers of a block may say for content together, so that one word against it is heard inside an article, too.
MOST_CONTENT = 3.5
#: Smoothness of neighbours in page order and of the next block in the same container.
ORDER_TIE, CONTAINER_TIE = 1.2, 0.6


def _named(token: str) -> float:
    """Evidence of one class, id or role. Words of an article's own parts (`entry-header`, `related-work`) are no boilerplate."""
    words = [w.lower() for w in _NAME_PARTS.findall(token)]
    if not words or words[0] in STATE_WORDS:
        return 0.0
    against = [w for w in words if w in BOILERPLATE_WORDS]
    if any(w not in WEAK_WORDS for w in against) or against and all(w in BOILERPLATE_WORDS or w in PLACE_WORDS for w in words):
        return NAMED_BOILERPLATE
    return NAMED_CONTENT if any(w in CONTENT_WORDS for w in words) else 0.0


def _attributes(text: str) -> float:
    """Evidence of an element's own attributes."""
    score = 0.0
    for name, *values in _ATTR.findall(text):
        value = "".join(values)
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true" or name.lower() == "style" and re.search(r"display\s*:\s*none", value):
            return NAMED_BOILERPLATE
        if name.lower() in ("class", "id", "role"):
            for token in value.split():
                own = _named(token)
                score = min(score, own) if own < 0 else score or own
    return score


class _Page:
    """Blocks of a page in order: text, evidence of its containers, their path, and the share of its text in links.

    What speaks against a container (its tag or name) is void if it is the page itself, a form that holds most of the page's text, or if most of
    that text is in one article or main part inside of it.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, float, tuple[int, ...], float]] = []
        self.found: list[tuple[str, tuple[int, ...], float]] = []
        self.nodes: list[tuple[int, str, float]] = [(0, "", 0.0)]  # parent, tag, evidence of the attributes; 0 stands for the page
        self.stack: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.linked, self.in_link = 0, 0
        at, unclosed = 0, set()
        while at < len(source):
            m = _TAG.match(source, at)
            at = m.end()
            if m["text"] is not None:
                self.parts.append(m["text"])
                self.linked += len(m["text"]) if self.in_link else 0
            elif m["name"]:
                name = m["name"].lower()
                if name in SKIPPED and not m["end"]:
                    if name in unclosed or name == "svg" and _CLOSED.search(m["attrs"]):
                        continue
                    end = re.compile(rf"</{name}\s*>|</{name}\Z|<body\b" if name in ("head", "title") else rf"</{name}\s*>", re.I).search(source, at)
                    if end is None and name not in ("script", "style"):
                        unclosed.add(name)  # nor is any later one
                        continue
                    at = len(source) if end is None else end.start() if end[0].lower().startswith("<body") else end.end()
                elif m["end"]:
                    self._close(name)
                else:
                    self._open(name, m["attrs"])
        self._flush()
        weighed = self._weigh()
        self.blocks = [(text, weighed[path[-1]] if path else 0.0, path, linked) for text, path, linked in self.found]

    def _weigh(self) -> list[float]:
        """Evidence of each element and all that it stands in."""
        held, void = [0] * len(self.nodes), [False] * len(self.nodes)
        for text, path, _ in self.found:
            held[path[-1] if path else 0] += len(text)
        for k in range(len(self.nodes) - 1, 0, -1):
            held[self.nodes[k][0]] += held[k]
        for k, (parent, name, _) in enumerate(self.nodes):
            if 2 * held[k] <= held[0]:
                continue
            void[k] = void[k] or name == "form"
            while name in ("article", "main") and parent and not void[parent]:
                void[parent] = True
                parent = self.nodes[parent][0]
        weighed = [0.0] * len(self.nodes)
        for k, (parent, name, named) in enumerate(self.nodes[1:], 1):
            above, own = weighed[parent], TAG_EVIDENCE.get(name, 0.0)
            if name == "header" and (above > 0 or named > 0):  # an article's own head
                own = 0.0
            own += named if name not in ("html", "body") else 0.0
            weighed[k] = min(MOST_CONTENT, above + (max(0.0, own) if void[k] else own))
        return weighed

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.found.append((text, tuple(x[1] for x in self.stack), self.linked / max(1, sum(map(len, self.parts)))))
        self.parts, self.linked = [], 0

    def _open(self, name: str, attrs: str) -> None:
        if name == "br":
            self.parts.append(" ")
        elif name == "a":
            self.in_link = 1
        if name not in BLOCK_TAGS:
            return
        self._flush()
        if any(x[0] == "p" for x in self.stack[-1:]):
            self.stack.pop()
        if self.stack and name in ENDED_BY.get(self.stack[-1][0], ()):
            self.stack.pop()
        if name not in VOID:
            self.nodes.append((self.stack[-1][1] if self.stack else 0, name, _attributes(attrs) if attrs else 0.0))
            self.stack.append((name, len(self.nodes) - 1))

    def _close(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
        if name in BLOCK_TAGS:
            self._flush()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    del self.stack[k:]
                    break


def evidence(text: str, containers: float, linked: float) -> float:
    """The classifier's evidence that a block is content."""
    score = containers + LINKED * linked + min(len(text), 120) / 60
    return score - (1.0 if "©" in text else 0.0)


def smoothness(paths: list[tuple[int, ...]]) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours in order, weaker with their distance in the DOM, and the next block of the same container."""
    edges, last = [], {}
    for k, path in enumerate(paths):
        if k:
            shared = 0
            for a, b in zip(paths[k - 1], path, strict=False):
                if a != b:
                    break
                shared += 1
            edges.append((k - 1, k, ORDER_TIE / (1 + (len(paths[k - 1]) + len(path) - 2 * shared) / 2)))
        home = path[-2:-1]
        if home in last and last[home] < k - 1:
            edges.append((last[home], k, CONTAINER_TIE))
        last[home] = k
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    A node of score s > 0 hangs on the source with capacity s, one of s < 0 on the sink with -s; edges bind both ways. Capacities are
    whole hundredths. Flow is pushed along shortest paths, all of one length at a time. Nodes that can't reach the sink are the source's.
    """
    left = [round(100 * s) for s in scores]
    to, room, out = [], [], [[] for _ in scores]
    for a, b, c in edges:
        for x, y in ((a, b), (b, a)):
            out[x].append(len(to))
            to.append(y)
            room.append(round(100 * c))
    while True:
        level = [0 if s > 0 else -1 for s in left]
        queue, reached = deque(k for k, s in enumerate(left) if s > 0), None
        while queue:
            k = queue.popleft()
            if left[k] < 0:
                reached = level[k] if reached is None else reached
            if reached is not None and level[k] >= reached:
                continue
            for e in out[k]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[k] + 1
                    queue.append(to[e])
        if reached is None:
            break
        tried = [0] * len(left)
        for start in [k for k, s in enumerate(left) if s > 0]:
            path, k = [], start
            while left[start] > 0:
                if left[k] < 0:  # the sink takes what the path carries
                    push = min([left[start], -left[k], *(room[e] for e in path)])
                    left[start], left[k] = left[start] - push, left[k] + push
                    for e in path:
                        room[e], room[e ^ 1] = room[e] - push, room[e ^ 1] + push
                    path, k = [], start
                    continue
                while tried[k] < len(out[k]) and not (room[out[k][tried[k]]] and level[to[out[k][tried[k]]]] == level[k] + 1):
                    tried[k] += 1
                if tried[k] < len(out[k]):
                    path.append(out[k][tried[k]])
                    k = to[path[-1]]
                elif path:
                    k = to[path.pop() ^ 1]
                    tried[k] += 1
                else:
                    break
    side = [True] * len(left)
    queue = deque(k for k, s in enumerate(left) if s < 0)
    for k in queue:
        side[k] = False
    while queue:
        k = queue.popleft()
        for e in out[k]:
            if room[e ^ 1] and side[to[e]]:
                side[to[e]] = False
                queue.append(to[e])
    return side


def main_text(source: str | None) -> str:
    """The text of the blocks labelled content, in page order, one a line."""
    blocks = _Page(source or "").blocks
    scores = [evidence(text, score, linked) for text, score, _, linked in blocks]
    if min(scores, default=0) < 0 < max(scores, default=0):
        side = minimum_cut(scores, smoothness([b[2] for b in blocks]))
    else:
        side = [s >= 0 for s in scores]
    return "\n".join(b[0] for b, content in zip(blocks, side, strict=True) if content)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(`id_col`, url, text, n_chars): one row per row of `pages`, from the whole of its html.

    A null or empty page, and one without content, gives the empty text. Repeated rows are read each; other columns are left out.
    """
    text = F.pandas_udf(lambda pages: pages.map(main_text), "string")
    return pages.select(F.col(id_col), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
