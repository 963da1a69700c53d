"""Main-text extraction by consensus host paths.

Each page's containers are scored by the text they hold against its links; the best one's
generalised tag-class path is a vote. Votes are summed per host in Spark, and every page is
read again under the path that won its host (its own best container where the host's path does
not occur). Inside the chosen container, menus, notices, adverts, comments and the like go.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage
from .urls import host_and_path

#: Fixed values of the HTML syntax.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no article text, wherever they stand.
DROPPED = frozenset("head script style noscript template nav footer aside form iframe button select textarea input label fieldset dialog menu svg math object audio video canvas title noembed noframes xmp".split())
CONTAINERS = frozenset("article main section div td body center blockquote".split())
#: Opening one of these ends an open p.
ENDS_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot option legend summary".split())
#: An open element of the left kind ends where one of the right kinds opens in the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDERS = frozenset().union(*ENDS.values())
#: Within which an open item is not looked for.
SCOPES = frozenset("ul ol dl table select div section article body".split())
#: Words of class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted outbrain taboola nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sidebar aside rail widget widgets header masthead topbar footer copyright "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus replies reply respond discussion form search skip hidden".split()
)
#: Of these, what marks reader comments, which hold headings of their own.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
#: What marks an article element as a comment, and words that may follow it in a name ("comment-body"; not "comments-open").
REMARKS, REMARK_PARTS = frozenset("comment comments commentlist reply replies disqus".split()), frozenset("item body entry list thread child node box wrap wrapper content container text".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")


#: Words that turn a noise word after them into a matter of layout, as in "has-sidebar" or "overflow-hidden".
LAYOUT = frozenset("has no with without is not overflow long text visually".split())
#: Elements whose presence shows that the class of a container around them speaks of layout, not of noise.
TELLING = frozenset("article main h1".split())


class Node:
    """An element; ``paragraph`` and ``item`` are the open p, and the open list or table item, that it stands in or is.

    ``noise`` is True for what is dropped wherever it stands, "worded" if only a class, id or role says so.
    """

    __slots__ = ("article", "children", "classes", "inside", "item", "name", "noise", "paragraph", "parent", "tag", "told")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.paragraph = self if tag == "p" else None if tag in BLOCK or parent is None else parent.paragraph
        self.item = self if tag in ENDS else None if tag in SCOPES or parent is None else parent.item
        self.article = None if parent is None else parent if parent.tag in ("article", "main") else parent.article
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.classes, self.name, self.told, self.noise = (), "", "", tag in DROPPED or (tag == "header" and not self.inside)
        if attributes.strip():
            self._read(attributes)
        if tag in TELLING and not self.noise:
            self._reprieve()

    def _read(self, attributes: str) -> None:
        found = {}
        for name, a, b, c in _ATTR.findall(attributes):
            found.setdefault(name.lower(), unescape(a or b or c))
        self.classes = tuple(sorted(found.get("class", "").split()))
        self.name = " ".join([found.get("id", ""), found.get("role", "")])
        names = [*self.classes, *self.name.split()]
        if self.tag not in ("body", "html", "article", "main") and any(_is_noise(x) for x in names):
            self.noise = self.noise or "worded"
        if (self.tag == "article" and any(_is_remark(x) for x in names)) or found.get("itemprop", "").lower() == "comment" or found.get("itemtype", "").endswith("/Comment"):
            self.noise = True
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            self.noise = True

    def _reprieve(self) -> None:
        """A word in a container's class makes no noise of it if it holds an article or a main part, nor does "header" if it
        holds the heading. Comments and dropped elements keep what is in them from telling."""
        up, heading = self.parent, self.tag == "h1"
        while up is not None and not (up.told if heading else up.told == "main") and up.noise is not True:
            if up.noise == "worded":
                words = {w for c in (*up.classes, up.name) for w in _words(c)} & NOISE
                if words & COMMENTS or (heading and words != {"header"}):
                    return
                up.noise = False
            up.told = "h1" if heading else "main"
            up = up.parent

    def step(self) -> str:
        """The tag and its classes, digits generalised, so that pages of one template agree."""
        return ".".join([self.tag, *(re.sub(r"\d+", "0", c).replace(">", "") for c in self.classes)])

    def path(self) -> str:
        steps, up = [], self
        while up is not None and up.tag:
            steps.append(up.step())
            up = up.parent
        return ">".join(reversed(steps))


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _is_noise(name: str) -> bool:
    words = _words(name)
    return any(w in NOISE and (i == 0 or words[i - 1] not in LAYOUT) for i, w in enumerate(words))


def _is_remark(name: str) -> bool:
    words = _words(name)
    while words and words[-1] in REMARK_PARTS:
        words.pop()
    return bool(words) and words[-1] in REMARKS and not (len(words) > 1 and words[-2] in LAYOUT)


class _Parser:
    """The open element and how many of each tag are open, so that a stray end tag costs no walk up."""

    def __init__(self) -> None:
        self.root = self.here = Node("", None)
        self.open = Counter()

    def up_to(self, node: Node) -> None:
        while self.here is not node:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and self.here.paragraph is not None:
            self.up_to(self.here.paragraph.parent)
        item = self.here.item if tag in ENDERS else None
        while item is not None:
            above = item.parent
            if tag in ENDS[item.tag]:
                self.up_to(above)
            item = above.item
        node = Node(tag, self.here, attributes)
        self.here.children.append(node)
        if tag not in VOID and not (attributes.rstrip().endswith("/") and tag not in BLOCK):
            self.here = node
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        up = self.here
        while up.tag != tag:
            if up.tag in ("article", "main", "body", "table") and tag not in BLOCK:
                return
            up = up.parent
        self.up_to(up.parent)


def parse(html: str) -> Node:
    """A forgiving tree: unclosed, stray and cut-off tags do no harm; comments and declarations go."""
    made, at, size = _Parser(), 0, len(html)
    while at < size:
        open_at = html.find("<", at)
        match = _TOKEN.match(html, open_at) if open_at >= 0 else None
        if match is None:
            # Plain text to the end, or up to and with a "<" that opens nothing; a tag cut off by the end goes.
            stop = size if open_at < 0 else open_at if re.match(r"</?[a-zA-Z!]", html[open_at : open_at + 3]) and html.find(">", open_at) < 0 else open_at + 1
            made.here.children.append(html[at:stop])
            at = size if open_at < 0 or stop == open_at else stop
            continue
        if open_at > at:
            made.here.children.append(html[at:open_at])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            made.end(tag)
            continue
        made.start(tag, match[3])
        if tag in RAW and made.here.tag == tag:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            made.up_to(made.here.parent)
    return made.root


def text_of(root: Node) -> str:
    """Blocks in page order, white space made single spaces, joined by two line ends."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if joined := _SPACE.sub(" ", unescape("".join(run))).strip():
            blocks.append(joined)
        run.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif x.tag == "br":
            run.append(" ")
        elif not x.noise:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return "\n\n".join(blocks)


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        if not isinstance(x, str):
            if not x.noise:
                yield x
                stack.extend(reversed(x.children))


def scores(root: Node) -> list[tuple[float, Node]]:
    """Containers by the characters they hold directly outside links.

    An article's or main part's count twice, but not an article's in a main part that holds text
    itself; an article in an article that does is no candidate, as the syntax means such for remarks.
    """
    held = [(_direct(x), x) for x in _walk(root) if x.tag in CONTAINERS]
    own, out = {id(x): m for m, x in held}, []
    for m, x in held:
        below = x.article is not None and own.get(id(x.article), 0) > 0
        if x.tag == "article" and below and x.article.tag == "article":
            continue
        out.append((m * (2 if x.tag == "main" or (x.tag == "article" and not below) else 1), x))
    return sorted(((m, x) for m, x in out if m > 0), key=lambda y: -y[0])


def _direct(x: Node) -> float:
    """Characters outside links less those inside, without what containers inside ``x`` hold for themselves."""
    total, stack = 0.0, [(c, False) for c in x.children]
    while stack:
        y, linked = stack.pop()
        if isinstance(y, str):
            total += -len(y.strip()) if linked else len(y.strip())
        elif not y.noise and y.tag not in CONTAINERS - {"blockquote", "center"}:
            stack.extend((c, linked or y.tag == "a") for c in y.children)
    return total


def best_container(root: Node) -> Node:
    """The first by ``scores``, widened to its parent while siblings of it hold text too."""
    ranked = scores(root)
    if not ranked:
        return root
    best = ranked[0][1]
    if best.tag in ("article", "main"):
        return best
    holders, own = Counter(id(n.parent) for _, n in ranked), {id(n) for _, n in ranked}
    while best.parent and best.parent.tag in CONTAINERS - {"body"} and holders[id(best.parent)] > (id(best) in own):
        best = best.parent
    return best


def find(root: Node, path: str) -> list[Node]:
    """The containers at a path, followed down step by step."""
    at = [root]
    for step in path.split(">"):
        at = [c for x in at for c in x.children if not isinstance(c, str) and not c.noise and c.step() == step]
    return [x for x in at if x.tag in CONTAINERS]


def extract(html: str, path: str | None = None) -> str:
    """A page's text under its host's winning path, or else from its own best container.

    Reader comments go wherever they stand: what a class, id, role or item type marks as such,
    article elements included. An unmarked article within an article is text like the rest of it.
    """
    root = parse(html)
    texts = [t for n in (find(root, path) if path else []) if (t := text_of(n))]
    return "\n\n".join(texts) or text_of(best_container(root))


def vote(html: str) -> tuple[str, float]:
    """The path of the page's best container and how strongly the page speaks for it (its text's share)."""
    root = parse(html)
    best = best_container(root)
    return best.path(), 1.0 + min(1.0, len(text_of(best)) / 1000)


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: the path that won each host; ties go to the least path."""

    def run(batches):
        for batch in batches:
            found = [vote(h.as_py()) if h.is_valid else ("", 0.0) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([int(1000 * x[1]) for x in found], pa.int64())], ["host", "path", "weight"])

    host, _ = host_and_path(F.col("url"))
    votes = pages.select(host.alias("host"), "html").mapInArrow(run, "host string, path string, weight long")
    tally = votes.where("path <> ''").groupBy("host", "path").agg(F.sum("weight").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return tally.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Null and empty html give an empty text; null and hostless urls vote together as host ''.
    Repeated rows are read alike. Hosts, not pages, are broadcast or shuffled as adaptive
    execution finds them small or not; html stays where it was read.
    """
    winners = stage(host_paths(pages), "host-paths").df.withColumnRenamed("host", "_host")
    host, _ = host_and_path(F.col("url"))
    joined = pages.select("page_id", "url", "html", host.alias("_h")).join(winners, F.col("_h") == F.col("_host"), "left")

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py(), p.as_py()) if h.is_valid else "" for h, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long"), "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
