"""Main text of web pages by consensus of each host.

Each page's containers are scored by the text of their blocks without links. A container is named by
its generalised path: tags and classes from the body down, with numbers in classes made alike. The
pages of a host vote with the shares of their scores, Spark adds the votes up (in every task before
the shuffle), and the text of each page is taken from its containers that lie on the winning path,
or whole from the article or other container of text that these stand in.
A page that lacks it, or has most of its text elsewhere, uses its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from skyloom.llm.common import by_value, table, texts_of, with_columns
from skyloom.llm.url_rules import host_and_path

by_value(__name__)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*>", re.S)  # of an element only up to its name
CLOSES = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed lists of HTML: elements without content, with raw content, that begin a block, that hold blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HOLDER = frozenset("article body div main section td".split())
HEADINGS = frozenset("h1 h2 h3".split())
ENDS_ITSELF = {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
# What is not the article: elements, roles, and words in classes and ids.
DROPPED = frozenset("aside button dialog footer iframe label nav noscript script select style svg template textarea".split())
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog menu navigation search".split())
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related"
    " share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Names of a class or id that only tell of a page's layout, state or topic, by their first or last word.
STATES_FIRST = frozenset("with without no not has have is hide hides show shows hidden before after category tag topic format type".split())
STATES_LAST = frozenset("open opened closed on off enabled disabled active inactive allowed layout".split())
# "related" and the like name what is listed; alone, or before one of these
LISTED = frozenset("related promoted sponsored".split())
LISTS = frozenset(
    "article articles box block content item items link links list news post posts product products reading section"
    " sidebar stories story topics videos widget".split()
)
HEADER_WORDS = frozenset("header site-header page-header topbar".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
PROPER = 40  # unlinked characters of a block that is a text; shorter ones are mostly labels and dates
WHOLLY, PARTLY = 2, 1  # a name of a class or id is a dropped word, or a dropped word begins or ends it
MOST = {WHOLLY: 0.9, PARTLY: 0.5}  # of the unlinked text: where more of it stands is no side matter
PATH = 240  # letters of a path; deeper down it goes on from its hash
ENOUGH = 0.5  # of the best container's text; below it a page does not follow its host


@dataclass
class Node:
    tag: str
    path: str
    parent: Node | None
    dropped: bool
    good: bool
    named: int = 0  # dropped by its class or id, unless the page's text is in it: WHOLLY or PARTLY
    within: int = 0  # of such a one: unlinked characters in it
    text: int = 0  # characters of own blocks outside links
    blocks: list[int] = field(default_factory=list)


def words_of(attributes: dict[str, str]) -> set[str]:
    return set(re.findall(r"[a-z]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))


def named(attributes: dict[str, str]) -> int:
    """Whether a class or an id names something that is not the article."""
    found = 0
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split():
        if name in DROPPED_WORDS:
            return WHOLLY
        words = re.findall("[a-z]+", name)
        if not words or words[0] in STATES_FIRST or words[-1] in STATES_LAST:
            continue
        if words[0] in LISTED:
            found = max(found, PARTLY * (len(words) == 1 or words[-1] in LISTS))
        elif words[0] in DROPPED_WORDS or words[-1] in DROPPED_WORDS:
            found = PARTLY
    return found


class TagEnds:
    """Where tags end: at the first '>' outside quotes, however long those are. Linear over a page."""

    def __init__(self, source: str):
        self.source, self.dead, self.dead_to = source, set(), -1

    def after(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``; -1 if it never ends. Calls go forward."""
        if at <= self.dead_to:
            return -1
        quotes, first, start = [], None, at
        while m := CLOSES.search(self.source, start):
            here = m.start()
            first = here if first is None else first
            if m[0] == ">":
                return here + 1
            quotes.append(here)
            close = -1 if here in self.dead else self.source.find(m[0], here + 1)
            if close < 0:
                break
            start = close + 1
        self.dead.update(quotes)
        self.dead_to = len(self.source) if first is None else first
        return -1


class Page:
    """The blocks of a page and the containers they stand in."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, str]] = []  # (nearest holder, text)
        self.proper: list[bool] = []  # of each block: a heading or a text, no boilerplate
        root = Node("", "", None, False, False)
        self.stack, self.open, self.links = [root], [], 0
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.found: list[tuple[Node, str, int]] = []  # (innermost element, text, unlinked characters)
        self.linked = 0
        at = search = 0
        ends = TagEnds(source)
        while m := TAG.search(source, search):
            name = (m[2] or "").lower()
            end = ends.after(m.end()) if name else m.end()
            if end < 0:  # a quote stays open: this is text
                search = m.end()
                continue
            self._text(source[at : m.start()])
            at = search = end
            if not name:
                continue
            if m[1]:
                self._end(name)
            elif name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = search = close.end() if close else len(source)
            else:
                self._start(name, source[m.end() : end - 1])
        self._text(source[at:])
        self._break()
        self._settle()

    def _text(self, text: str) -> None:
        if text and not self.stack[-1].dropped:
            self.open.append(text)
            if self.links:
                self.linked += len(text)

    def _break(self) -> None:
        """End the block that is open."""
        if self.open:
            text = " ".join(html.unescape("".join(self.open)).split())
            if text:
                self.found.append((self.stack[-1], text, max(0, len(text) - self.linked)))
            self.open.clear()
        self.linked = 0

    def _settle(self) -> None:
        """Drop what is named so, but not where the text of the page is, and give the rest to its holders."""
        names: dict[int, list[Node]] = {}

        def above(node: Node | None) -> list[Node]:
            """The named elements around a node, the outermost first."""
            way = []
            while node and id(node) not in names:
                way.append(node)
                node = node.parent
            known = names[id(node)] if node else []
            for n in reversed(way):
                known = [*known, n] if n.named else known
                names[id(n)] = known
            return known

        every, good, outer = 0, False, {}
        for node, _, own in self.found:
            every += own
            around = above(node)
            for n in around:
                n.within += own
                outer[id(n)] = n
            if not around and own:
                while node and not node.good:
                    node = node.parent
                good = good or node is not None
        for n in outer.values():
            # a whole name is believed as long as there is another place for the article
            n.named *= n.within <= MOST[n.named] * every or (n.named == WHOLLY and good)
        for node, text, own in self.found:
            if any(n.named for n in names[id(node)]):
                continue
            heading = False
            while node.parent and node.tag not in HOLDER:
                heading = heading or node.tag in HEADINGS
                node = node.parent
            self.proper.append(2 * own >= len(text) and (heading or own >= PROPER))
            node.text += own
            node.blocks.append(len(self.blocks))
            self.blocks.append((node, text))
        self.nodes = [n for n in self.nodes if not any(x.named for x in above(n))]
        self.found.clear()

    def _start(self, name: str, rest: str) -> None:
        if name == "br" or name == "td" or name == "th":
            self._text(" ")
        if name in BLOCK:
            self._break()
            self._close("p", ())
        if name in ENDS_ITSELF:
            self._close(name, ENDS_ITSELF[name].split())
        if name in VOID:
            return
        attributes = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)} if rest else {}
        words = words_of(attributes) if attributes else set()
        above = self.stack[-1]
        inside = self.opened["article"] + self.opened["main"] > 0
        dropped = (
            above.dropped
            or name in DROPPED
            or attributes.get("role", "").lower() in DROPPED_ROLES
            or (not inside and name == "header")
            or "hidden" in attributes
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        ) and name not in ("html", "body")
        by_name = 0
        if attributes and not dropped and name not in ("html", "body", "article", "main"):
            by_name = named(attributes)
            if attributes.get("role", "").lower() == "form":
                by_name = by_name or PARTLY
            if not inside and HEADER_WORDS & set(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()):
                by_name = WHOLLY
            if by_name and name not in BLOCK and name != "td":
                dropped, by_name = True, 0  # inside a line there is no container to keep
        if name == "form" and not dropped:
            # a form goes with all it holds, but not where it is wrapped around the page or an article
            by_name = by_name or PARTLY
        elif name in ("article", "main") and self.opened["form"]:
            for n in self.stack:
                n.named *= n.tag != "form"
        if by_name:
            self._break()
        classes = sorted(re.sub("[0-9]+", "#", c) for c in attributes.get("class", "").lower().split())
        path = f"{above.path}/{'.'.join([name, *classes])}" if name in BLOCK or name == "td" else above.path
        if len(path) > PATH:
            path = f"#{blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"
        node = Node(name, path, above, dropped, name in ("article", "main") or bool(words & GOOD_WORDS), by_name)
        self.stack.append(node)
        self.opened[name] += 1
        self.links += name == "a"
        if name in HOLDER and not dropped:
            self.nodes.append(node)

    def _pop(self) -> None:
        if self.stack[-1].named:
            self._break()
        gone = self.stack.pop()
        self.opened[gone.tag] -= 1
        self.links -= gone.tag == "a"

    def _close(self, name: str, stops) -> None:
        """Close an open ``name`` that no block (or one of ``stops``) stands in the way of."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag == name:
                self._break()
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in stops or (not stops and tag in BLOCK):
                return

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._break()
        if not self.opened[name]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if name not in BLOCK and self.stack[k].tag in BLOCK:
                return  # an inline end inside a block does not close the block
            if self.stack[k].tag == name:
                while len(self.stack) > k:
                    self._pop()
                return

    def scores(self) -> dict[str, float]:
        """Score by path: own text, and half of the text of the containers right below."""
        score = {id(n): float(n.text) for n in self.nodes}
        for n in self.nodes:
            above = n.parent
            while above and above.tag not in HOLDER:
                above = above.parent
            if above and id(above) in score:
                score[id(above)] += n.text / 2
        out: dict[str, float] = {}
        for n in self.nodes:
            if score[id(n)] > 0:
                out[n.path] = out.get(n.path, 0.0) + score[id(n)] * (1.25 if n.good else 1.0)
        return out

    def _whole(self, node: Node) -> tuple[Node, Node | None]:
        """The container that holds all of the article of ``node``, and a body whose own blocks belong to it.

        That is the nearest article or main, else the outermost container with own text that is no
        boilerplate. A body also holds the rest of the page: of it only such own blocks are taken.
        """
        holder, body, above = node, None, node
        while above:
            if above.tag in ("article", "main"):
                return above, None
            if above.tag in HOLDER and any(self.proper[k] for k in above.blocks):
                if above.tag == "body":
                    body = above
                else:
                    holder = above
            above = above.parent
        return holder, body

    def text_on(self, path: str) -> str:
        """The blocks of the articles that the containers of a path stand in, in page order."""
        wholes, bodies, kept, seen = set(), set(), [], {}
        for n in self.nodes:
            if n.path == path:
                whole, body = self._whole(n)
                wholes.add(id(whole))
                bodies.add(id(body))

        def inside(node: Node | None) -> bool:
            way = []
            while node and id(node) not in seen and id(node) not in wholes:
                way.append(id(node))
                node = node.parent
            found = node is not None and seen.get(id(node), True)
            seen.update(dict.fromkeys(way, found))
            return found

        for k, (node, text) in enumerate(self.blocks):
            if inside(node) or id(node) in bodies and self.proper[k]:
                kept.append(text)
        return "\n".join(kept)

    def main_text(self, voted: str | None) -> str:
        """The text on the voted path, or that of the page's own best container."""
        scores = self.scores()
        if not scores:
            return "\n".join(text for _, text in self.blocks)
        own = self.text_on(max(sorted(scores), key=scores.__getitem__))
        text = self.text_on(voted) if voted in scores else ""
        return text if text and len(text) >= ENOUGH * len(own) else own


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: what each page's containers have of its score, added up by host."""

    def make():
        def compute(column):
            out = []
            for source in texts_of(column):
                scores = Page(source).scores()
                total = sum(scores.values())
                out.append([(p, s / total) for p, s in sorted(scores.items())])
            return [out]

        return compute

    share = T.StructType([T.StructField("path", T.StringType()), T.StructField("share", T.DoubleType())])
    fields = [T.StructField("shares", T.ArrayType(share))]
    host, _ = host_and_path(F.col("url"))
    cast = with_shares(pages.select(host.alias("host"), "html"), fields, make)
    return cast.select("host", F.inline("shares")).groupBy("host", "path").agg(F.sum("share").alias("votes"))


def with_shares(pages: DataFrame, fields, make) -> DataFrame:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("path", pa.string()), ("share", pa.float64())]))

    def typed():
        compute = make()
        return lambda column: [
            pa.array([[{"path": p, "share": s} for p, s in row] for row in compute(column)[0]], kind)
        ]

    return with_columns(pages, ["html"], fields, typed, keep=["host"])


def winners(cast: DataFrame) -> DataFrame:
    """``host, voted``: the path with the most votes; of equals the first in order."""
    # rounded, as sums of doubles depend on the order of the tasks
    return cast.groupBy("host").agg(F.min_by("path", F.struct(-F.round("votes", 6), F.col("path"))).alias("voted"))


def main_texts(pages: DataFrame, voted: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row.

    Null html is empty and gives ''. Pages without a host vote and are read as one host. Repeated rows
    each get their result; other columns are not looked at.
    """
    host, _ = host_and_path(F.col("url"))
    voted = winners(votes(pages)) if voted is None else voted
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(voted, "host", "left")

    def make():
        def compute(source, path):
            out = [Page(s).main_text(p) for s, p in zip(texts_of(source), path.to_pylist())]
            return [out, np.array([len(t) for t in out], dtype=np.int64)]

        return compute

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return with_columns(rows, ["html", "voted"], fields, make, keep=["page_id", "url"])


def op5_html(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
