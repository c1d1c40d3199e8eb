"""Main text of web pages by minimum cut.

A page becomes a list of text blocks with the elements around them. A logistic classifier gives every block its log-odds of being
main text: its capacity to the content terminal or, if negative, to the boilerplate terminal. Neighbouring blocks are tied
to each other, more strongly the closer they stand in the element tree, in the same unit. The minimum cut of that graph is the
labelling of least total cost. Words in class names are features like any other and decide nothing alone.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tesserae.runtime import ship

# Fixed vocabularies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe title textarea select".split())
#: Their text is no markup: without an end tag it goes on to the end of the page.
RAW = frozenset("script style title textarea iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br-block button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3"))
#: Elements whose texts are short by nature: alone they say nothing for or against main text.
SHORT = frozenset("li dt dd td th caption figcaption h4 h5 h6".split())
#: Parts of a list or table: what they hold counts for the element around the whole of it.
INNER = frozenset("table tbody thead tfoot tr td th caption ul ol li dl dt dd".split())
#: Their ids are slugs of what they say.
SLUGGED = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset search".split())
#: Words for what stands around a text; those that texts also use of themselves cost less.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar aside nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup pagination pager".split()
)
EVERYDAY_WORDS = frozenset(
    "menu header notice alert subscription login share sharing social related recommended recommendation trending widget copyright disclaimer legal "
    "search skip".split()
)
#: With one of these, a word such as sidebar tells what stands beside the element, not what it is.
LAYOUT_WORDS = frozenset("layout with has no without".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: Readers' words in a thread, but also an author's own.
ANSWER_WORDS = frozenset("reply replies respond discussion".split())
INSIDE_TAGS = frozenset(("article", "main"))
INSIDE_WORDS = frozenset("article content post entry story body text main".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
INSIDE_ROLES = frozenset(("main", "article"))
#: An open p ends where one of these starts (a block) or closes.
P_SCOPE = frozenset("article aside blockquote body button details div fieldset figure footer form header html li main nav section table td th".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?a-zA-Z][^>]*\Z|([^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
HUMP = re.compile(r"([a-z])([A-Z])")


@dataclass(slots=True)
class Element:
    """An open element: its own verdict (-1 outside, 1 inside, 0 none; by name: -2 reader comments, -3 outside, -4 perhaps
    outside) and its place in the tree."""

    tag: str
    verdict: int
    depth: int
    parent: Element | None


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    linked: int


#: What the classifier looks at, in the order of the weights.
FEATURES = (
    "bias", "words", "few", "links", "sentence", "paragraph", "heading", "short", "inside", "in_article", "outside", "named",
    "named_few", "everyday", "everyday_few", "comment", "mass", "mass_above", "dominant", "bulk",
)

#: Found by ``fit_costs`` on the pages that the tests make (seeds 0 to 599), rounded.
WEIGHTS = (-7.25, 0.85, -1.68, -3.78, -1.23, 3.67, 6.78, 3.78, 4.26, -1.47, -4.82, -4.83, -2.49, 0.54, -4.82, -7.02, 3.67, -2.45, 1.47, 4.48)


@dataclass(frozen=True)
class Costs:
    """``weights`` of FEATURES, as ``fit_costs`` finds them, and the smoothness of neighbours one and two places apart."""

    weights: tuple[float, ...] = WEIGHTS
    adjacent: float = 1.0
    near: float = 0.5


def _words(name: str) -> set[str]:
    return set(WORDS.findall(HUMP.sub(r"\1 \2", name).lower()))


def _verdict(tag: str, attributes: str, parent: Element) -> int:
    if attributes and not attributes.isspace():
        names = {}
        for m in ATTRIBUTE.finditer(attributes):
            names.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        if "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "").lower():
            return -1
        role = names.get("role", "").strip().lower()
        if tag not in ("html", "body"):
            tokens = [_words(t) for t in names.get("class", "").split()]
            slug = _words(names.get("id", ""))
            # Of a slug, only an id that says nothing but comments is a name.
            if slug <= COMMENT_WORDS or not (tag in SLUGGED or (tag == "section" and _inside(parent))):
                tokens.append(slug)
            named = set().union(*tokens)
            inside = tag in INSIDE_TAGS or role in INSIDE_ROLES
            for t in tokens:
                # An article is a comment if a whole class name says so; comments-open tells what stands beside it.
                if t & COMMENT_WORDS and not t & LAYOUT_WORDS and (not inside or t <= COMMENT_WORDS | INSIDE_WORDS):
                    return -2
            if role in OUTSIDE_ROLES:
                return -1
            if not inside and not named & LAYOUT_WORDS:
                if named & OUTSIDE_WORDS:
                    return -1 if tag in OUTSIDE_TAGS else -3
                if named & (EVERYDAY_WORDS | ANSWER_WORDS):
                    return -1 if tag in OUTSIDE_TAGS else -4
            if role in INSIDE_ROLES or (named & INSIDE_WORDS and tag not in OUTSIDE_TAGS):
                return 1
    if tag in OUTSIDE_TAGS:
        return -1
    return int(tag in INSIDE_TAGS)


def _inside(e: Element | None) -> bool:
    """Whether the nearest element with a verdict says so."""
    while e is not None and not e.verdict:
        e = e.parent
    return e is not None and e.verdict == 1


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order: character references decoded, white space turned into single spaces, none empty."""
    root = Element("", 0, 0, None)
    here, out = root, []
    pieces: list[str] = []
    linked, links = 0, 0
    skip_to = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append(Block(here, text, linked))
            pieces.clear()
        linked = 0

    for m in TOKEN.finditer(html):
        if m.start() < skip_to:
            continue
        if m[7] is not None:
            pieces.append(m[7])
            if links:
                linked += len(m[7])
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                flush()
                at = here
                while at is not root and at.tag != tag and not (tag == "p" and at.tag in P_SCOPE):
                    at = at.parent
                if at is not root and at.tag == tag:
                    here = at.parent
            continue
        if tag in DROPPED:
            if not attributes.endswith("/") or tag != "svg":
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, m.end())
                skip_to = end.end() if end else len(html) if tag in RAW else m.end()
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links += 1
        elif tag == "hr":
            flush()
        elif tag in BLOCK:
            flush()
            links = 0
            at = here
            while at is not root and at.tag not in P_SCOPE and at.tag != "p":
                at = at.parent
            if at is not root and at.tag == "p":
                here = at.parent
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and here.tag == tag:
                here = here.parent
            here = Element(tag, _verdict(tag, attributes, here), here.depth + 1, here)
    flush()
    return out


@dataclass(slots=True)
class _Around:
    """What the elements around a text say: innermost decisive verdict, name within it, and both as a heading sees them."""

    element: Element
    decided: int = 0
    named: int = 0
    title_decided: int = 0
    title_named: int = 0
    article: bool = False
    comment: bool = False
    dominant: bool = False
    words: float = 0.0
    blocks: int = 0


def _around(e: Element, known: dict[int, _Around]) -> _Around:
    """Of ``e``, and of all elements around it that are not ``known`` yet, from the outside in."""
    chain = []
    at: Element | None = e
    while at is not None and id(at) not in known:
        chain.append(at)
        at = at.parent
    for x in reversed(chain):
        up = known[id(x.parent)] if x.parent is not None else _Around(x)
        new = _Around(x, up.decided, up.named, up.title_decided, up.title_named, up.article or x.tag in INSIDE_TAGS, up.comment or x.verdict == -2)
        if x.verdict < -2:
            new.named = -3 if -3 in (x.verdict, up.named) else -4
            # Nor does a name such as post-header speak against the heading in it.
            if not (x.verdict == -4 and up.title_decided == 1):
                new.title_named = -3 if -3 in (x.verdict, up.title_named) else -4
        elif abs(x.verdict) == 1:
            new.decided, new.named = x.verdict, 0
            # A heading in an article's own header is its title.
            if not (x.tag == "header" and up.article):
                new.title_decided, new.title_named = x.verdict, 0
        known[id(x)] = new
    return known[id(e)]


def _holder(e: Element) -> Element:
    at = e.parent or e
    while at.tag in INNER and at.parent is not None:
        at = at.parent
    return at


def features_of(blocks: Sequence[Block]) -> np.ndarray:
    """One row of FEATURES per block.

    ``inside`` and ``outside`` tell what the innermost decisive element around it says (a heading in an article's own header is the
    article's title), ``named`` and ``everyday`` that a name within it hints at what stands around a text, ``mass`` how many
    words without links the element around it holds (lists and tables count for what is around them), as a share of the most that any
    does, ``mass_above`` the same one step up, and ``bulk`` whether these words are many at all. ``dominant`` blocks lie in the innermost element with several blocks that holds most such words of all elements around it.
    """
    free = [(b.text.count(" ") + 1) * (1.0 - b.linked / max(1, len(b.text))) for b in blocks]
    held: dict[int, float] = {}
    above: dict[int, float] = {}
    known: dict[int, _Around] = {}
    for b, n in zip(blocks, free, strict=True):
        around = _around(b.element, known)
        around.words, around.blocks = around.words + n, around.blocks + 1
        one = _holder(b.element)
        two = _holder(one)
        held[id(one)] = held.get(id(one), 0.0) + n
        above[id(two)] = above.get(id(two), 0.0) + n
    most, most_above = max(held.values(), default=0.0) or 1.0, max(above.values(), default=0.0) or 1.0
    # Sums go from the innermost elements outwards; then the way back in, as long as one child holds most.
    heaviest: dict[int, _Around] = {}
    top = None
    for x in sorted(known.values(), key=lambda x: -x.element.depth):
        parent = x.element.parent
        if parent is None:
            top = x
            continue
        up = known[id(parent)]
        up.words, up.blocks = up.words + x.words, up.blocks + x.blocks
        if x.blocks > 1 and (id(parent) not in heaviest or x.words > heaviest[id(parent)].words):
            heaviest[id(parent)] = x
    while top is not None and (best := heaviest.get(id(top.element))) is not None and best.words > top.words / 2 and best.element.tag not in INNER:
        top = best
    if top is not None:
        for x in sorted(known.values(), key=lambda x: x.element.depth):
            x.dominant = x is top or (x.element.parent is not None and known[id(x.element.parent)].dominant)
    out = np.zeros((len(blocks), len(FEATURES)))
    for row, b in zip(out, blocks, strict=True):
        words = b.text.count(" ") + 1
        enough, few = min(1.0, words / 30), words <= 5
        x, heading = known[id(b.element)], b.element.tag in HEADINGS
        decided, named = (x.title_decided, x.title_named) if heading else (x.decided, x.named)
        one = _holder(b.element)
        two = _holder(one)
        row[:] = (
            1.0, enough, few, b.linked / max(1, len(b.text)), words > 3 and b.text[-1] in ".!?:;\"'”»…)",
            b.element.tag in ("p", "blockquote", "pre"), heading, b.element.tag in SHORT, decided == 1, x.article, decided == -1,
            named == -3, (named == -3) * (1.0 - enough), named == -4, (named == -4) * (1.0 - enough), x.comment,
            (held[id(one)] / most) ** 0.5, (above[id(two)] / most_above) ** 0.5, x.dominant, min(1.0, held[id(one)] / 40),
        )
    return out


def scores_of(blocks: Sequence[Block], c: Costs) -> list[float]:
    """Log-odds of each block; above 0: more likely main text."""
    return (features_of(blocks) @ np.array(c.weights)).tolist()


def fit_costs(pages: Sequence[tuple[Sequence[Block], Sequence[bool | None]]], l2: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Weights by logistic regression (Newton's method) on blocks with a known label."""
    x = np.concatenate([features_of(blocks)[[t is not None for t in truth]] for blocks, truth in pages if blocks])
    y = np.array([float(t) for _, truth in pages for t in truth if t is not None])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
    return tuple(w.tolist())


def tree_distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class FlowGraph:
    """Dinic's maximum flow; the nodes that still reach from the source form its side of a minimum cut."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, forth: float, back: float) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(forth)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def saturate(self, s: int, t: int) -> list[bool]:
        to, room, out = self.to, self.room, self.out
        while (level := self.levels(s))[t] >= 0:
            cursor = [0] * len(out)
            path: list[int] = []
            at = s
            while True:
                if at == t:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    path, at = [], s
                while cursor[at] < len(out[at]):
                    e = out[at][cursor[at]]
                    if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                        break
                    cursor[at] += 1
                else:
                    if not path:
                        break
                    at = to[path.pop() ^ 1]
                    cursor[at] += 1
                    continue
                path.append(e)
                at = to[e]
        return [x >= 0 for x in level]


def label(blocks: Sequence[Block], c: Costs | None = None) -> list[bool]:
    """True for main text: the content side of the minimum cut (ties count as boilerplate)."""
    c = c or Costs()
    scores = scores_of(blocks, c)
    if all(s > 0 for s in scores):
        return [True] * len(blocks)
    if all(s <= 0 for s in scores):
        return [False] * len(blocks)
    n = len(blocks)
    g = FlowGraph(n + 2)
    s, t = n, n + 1
    for i, x in enumerate(scores):
        if x > 0:
            g.edge(s, i, x, 0.0)
        elif x < 0:
            g.edge(i, t, -x, 0.0)
    for step, weight in ((1, c.adjacent), (2, c.near)):
        for i in range(n - step):
            # Siblings are two steps apart in the tree, and a block and its own element's text are none.
            far = max(1, tree_distance(blocks[i].element, blocks[i + step].element) - 1)
            w = weight / far**2
            g.edge(i, i + step, w, w)
    return g.saturate(s, t)[:n]


def main_text(html: str | None, c: Costs | None = None) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, c), strict=True) if keep)


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html", costs: Costs | None = None) -> DataFrame:
    """The columns ``keep``, ``text`` (main text of the whole page) and ``n_chars`` (its code points), one row per page.

    A null or empty page, or one without main text, gives an empty text. Pages stand alone: repeated rows give equal
    results, an empty table an empty result.
    """
    ship(pages.sparkSession)
    width = len(keep)
    source = pages.select(*[F.col(f"`{k}`").alias(f"k_{i}") for i, k in enumerate(keep)], F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), costs) for x in b.column(width)]
            arrays = [*b.columns[:width], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:width], "text", "n_chars"])

    schema = StructType([*source.schema.fields[:width], StructField("text", StringType()), StructField("n_chars", LongType())])
    return source.mapInArrow(run, schema).select(*[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)], "text", "n_chars")
