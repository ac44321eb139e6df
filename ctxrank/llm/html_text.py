"""Main text of web pages by minimum-cut labelling (operator 7).

A page is cut into blocks of text with the elements around them. A logistic classifier over the form of a block
(its words, links, punctuation and kind of element) gives each block the log-odds of being content: these, with what
the page's own markup says, are the capacities to the two terminals. Neighbouring blocks, and blocks that share a
parent, are tied by edges whose capacity is half the log-ratio at which such blocks were seen to agree. The
minimum cut (max-flow after exact removal of blocks whose terminal outweighs all their edges) separates content from boilerplate.

Classifier and ties are fitted by fit() on about SAMPLE pages, chosen by a hash of the row. Pages bear no labels:
blocks that the markup names (in an article or main part; in navigation, footers, adverts, forms and the like) are the
examples, and the form of those in it is learned for blocks and pages without such markup. The fit is drawn to PRIOR,
which alone holds where nothing was learned: in an empty table or one without such markup.

Defined results: a null or empty page gives an empty text with 0 characters, as does one without content;
markup may be broken or unclosed; repeated rows stay; other columns are ignored; nothing is dropped or capped
within the content; an empty table gives no rows. Time is linear in a page's length, however deep its elements lie.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, trimmed

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "template", "svg", "math", "object", "canvas", "audio", "video", "map", "noscript", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: An opening tag of the first kind ends open elements of the second kind up to one of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"}
TOWARDS = {"article", "main"}
BAD_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "recommended", "related", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toc", "toolbar", "widget"}
GOOD_NAMES = {"article", "articlebody", "content", "entry", "main", "post", "story", "text"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "menu", "menubar", "alert"}


#: Pages that the classifier is fitted on, about; all when there are fewer.
SAMPLE = 5000
#: Log-odds of content in a block of a page with an article or main part that lies outside it.
OUTSIDE = -3.0
#: And in any block of a page that marks no such part: its content has no other place.
UNMARKED = 1.5
ITEMS = {"li", "dt", "dd", "td", "th"}
#: Weights before any page is seen: a constant; 1, 2, 3, 5, 9, 17, 33 words and more; share of the text in links from 0, 0.01, 0.34,
#: 0.67 on; an end of a sentence; a comma; heading, item of a list or table, other (paragraphs or not: authors differ).
PRIOR = (0.0, -1.4, -1.3, -1.1, -0.9, -0.3, 0.7, 2.5, 0.0, -1.0, -3.0, -6.0, 1.0, 0.3, 1.5, -0.5, 0.3)
#: Neighbours seen to agree and to differ before any page is seen: of one parent, near in the tree, far, of one parent with others between.
SEEN = ((20.0, 2.0), (6.0, 3.0), (3.0, 3.0), (10.0, 5.0))


@dataclass
class Block:
    text: str
    depth: int  #: elements around it, inline ones left out
    shared: int  #: how many of them the block before lies in too
    parent: int
    away: float
    towards: float
    links: int
    heading: bool
    kind: str


@dataclass
class Model:
    """Weights of the classifier and the capacities of ties, in the order of SEEN."""

    weights: tuple[float, ...] = PRIOR
    ties: tuple[float, ...] = tuple(max(0.5 * math.log(a / b), 0.05) for a, b in SEEN)


class Open:
    """An open element with what it and all around it add up to."""

    __slots__ = ("name", "own", "inline", "away", "towards", "unseen", "link", "heading", "depth", "node", "parent", "kind")

    def __init__(self, name: str, own: tuple[int, float, float, bool], above: Open | None) -> None:
        number, away, towards, unseen = own
        self.name, self.own, self.inline = name, own, name in INLINE
        self.away = away + (above.away if above else 0.0)
        self.towards = towards + (above.towards if above else 0.0)
        self.unseen = unseen or above is not None and above.unseen
        self.link = name == "a" or above is not None and above.link
        self.heading = name in HEADINGS or above is not None and above.heading
        self.depth = (above.depth if above else 0) + (not self.inline)
        if self.inline:
            self.node, self.parent, self.kind = (above.node, above.parent, above.kind) if above else (0, 0, "")
        else:
            self.node, self.parent, self.kind = number, above.node if above else 0, name


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROOT = Open("span", (0, 0.0, 0.0, False), None)


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    out: list[Block] = []
    stack: list[Open] = []
    among: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    links = lowest = 0  # characters in links; the least depth since the last block

    def flush() -> None:
        nonlocal links, lowest
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                e = stack[-1] if stack else ROOT
                out.append(Block(text, e.depth, min(lowest, e.depth), e.parent, e.away, e.towards, links, e.heading, e.kind))
                lowest = e.depth
            parts.clear()
        links = 0

    def close(upto: int) -> None:
        nonlocal lowest
        if (stack[-1].depth if stack else 0) > (stack[upto - 1].depth if upto else 0):
            flush()
        for e in stack[upto:]:
            among[e.name] -= 1
        del stack[upto:]
        lowest = min(lowest, stack[-1].depth if stack else 0)

    def say(text: str) -> None:
        nonlocal links
        if text and not (stack and stack[-1].unseen):
            parts.append(text)
            if stack and stack[-1].link:
                links += len(text)

    at, number, low = 0, 0, None
    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if name:
            if name in VOID:
                if name in INLINE:
                    if name == "br":
                        say(" ")
                else:
                    flush()
                continue
            if name not in INLINE:
                kinds, stop = ENDS.get(name, (set(), set()))
                if any(among[k] for k in kinds) or among["p"] and name not in ENDS:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k].name in stop:
                            break
                        if stack[k].name in kinds or (stack[k].name == "p" and name not in ENDS):
                            close(k)
                            break
                flush()
            away, towards, unseen = judge(name, m[2] or m[4] or "", bool(stack) and stack[-1].towards > 0)
            if name in RAW or name in UNSEEN:
                unseen = True
            if name in RAW:
                low = page.lower() if low is None else low
                end = low.find(f"</{name}", at) if len(low) == len(page) else page.find(f"</{name}", at)
                at = len(page) if end < 0 else end
                stop_at = page.find(">", at)
                at = len(page) if stop_at < 0 else stop_at + 1
                continue
            if not (m[2] or m[4] or "").rstrip().endswith("/") or name in INLINE or name in TOWARDS | AWAY | {"div", "p"}:
                number += 1
                stack.append(Open(name, (number, away, towards, unseen), stack[-1] if stack else None))
                among[name] += 1
        elif m[5]:
            name = m[5].lower()
            if name == "br":
                say(" ")
            if not among[name]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    if name in INLINE and stack[-1].depth > stack[k].depth:
                        among[name] -= 1
                        rest = stack[k + 1 :]
                        del stack[k:]
                        for e in rest:
                            stack.append(Open(e.name, e.own, stack[-1] if stack else None))
                    else:
                        close(k)
                    break
                if name in INLINE and not stack[k].inline and k < len(stack) - 12:
                    break
    say(page[at:])
    flush()
    return out


def judge(name: str, attributes: str, inside: bool) -> tuple[float, float, bool]:
    """Costs that an element adds for the blocks in it: against content, for content; whether it is unseen."""
    away = 20.0 if name in AWAY else 3.0 if name == "header" and inside else 20.0 if name == "header" else 0.0
    towards, unseen = (8.0 if name in TOWARDS else 0.0), False
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            unseen = True
        elif key in ("class", "id", "itemprop") and name not in ("body", "html"):
            words = {*WORDS.findall(value), *value.split()}
            if words & BAD_NAMES:
                away += 20.0
            elif words & GOOD_NAMES:
                towards += 4.0
        elif key == "role":
            away += 20.0 * (value in BAD_ROLES)
            towards += 8.0 * (value in ("main", "article"))
    return away, towards, unseen


def form(b: Block) -> tuple[int, ...]:
    """The form of a block in bins: words, share of links, end of a sentence, comma, kind."""
    words, share = b.text.count(" ") + 1, b.links / len(b.text)
    kind = 0 if b.heading else 1 if b.kind in ITEMS else 2
    return min((words - 1).bit_length(), 6), 0 if share < 0.01 else min(int(share * 3) + 1, 3), int(b.text[-1] in ".!?…:;"), int("," in b.text), kind


def active(f: tuple[int, ...]) -> list[int]:
    """The weights that a form takes part with."""
    words, share, end, comma, kind = f
    return [0, 1 + words, 8 + share, *([12] if end else []), *([13] if comma else []), 14 + kind]


def terminals(b: Block, marked: bool, model: Model, hidden: bool = False) -> float:
    """Log-odds of content: of the block's form and, unless hidden, of the markup; marked: the page has an article or main part."""
    own = sum(model.weights[i] for i in active(form(b)))
    if hidden:
        return own
    return own + min(b.towards, 12.0) - b.away + (0.0 if b.towards else OUTSIDE if marked else UNMARKED)


def label_of(b: Block) -> bool | None:
    """Whether the markup names the block as content (True) or boilerplate (False)."""
    return False if b.away >= 20 else True if b.towards and not b.away else None


def neighbours(found: list[Block]) -> list[tuple[int, int, int]]:
    """Pairs of blocks that are tied, with their relation in the order of SEEN."""
    out: list[tuple[int, int, int]] = []
    last_in: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            near = 2 * b.shared >= max(b.depth, found[i - 1].depth)
            out.append((i - 1, i, 0 if b.parent == found[i - 1].parent else 1 if near else 2))
        if (j := last_in.get(b.parent)) is not None and j != i - 1:
            out.append((j, i, 3))
        last_in[b.parent] = i
    return out


def examples(page: str | None) -> Counter[tuple[int, ...]]:
    """Counts of (0, label, *form) over named blocks and of (1, whether the labels agree, relation) over tied pairs of them."""
    found = blocks(page or "")
    said = [label_of(b) for b in found]
    out = Counter((0, int(y), *form(b)) for b, y in zip(found, said) if y is not None)
    out.update((1, int(said[i] == said[j]), r) for i, j, r in neighbours(found) if said[i] is not None and said[j] is not None)
    return out


def learn(counts: dict[tuple[int, ...], int]) -> Model:
    """Logistic regression by Newton's method, drawn to PRIOR with unit variance; ties from the pairs counted."""
    seen = [list(x) for x in SEEN]
    rows = []
    for key, n in sorted(counts.items()):
        if key[0]:
            seen[key[2]][0 if key[1] else 1] += n
        else:
            rows.append((key[1], n, active(key[2:])))
    prior = np.array(PRIOR)
    x, y, n = np.zeros((len(rows), len(PRIOR))), np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    for i, r in enumerate(rows):
        x[i, r[2]] = 1.0

    def loss(w):
        z = x @ w
        return float(n @ (np.logaddexp(0.0, z) - y * z) + 0.5 * (w - prior) @ (w - prior))

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (n * (p - y)) + w - prior
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return Model(tuple(w.tolist()), tuple(max(0.5 * math.log(a / b), 0.05) for a, b in seen))


def cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks are on the content side of the minimum cut. A cost over 0 speaks for content."""
    unit = 100
    t = [round(c * unit) for c in costs]
    ties: list[dict[int, int]] = [{} for _ in costs]
    for a, b, c in edges:
        c = round(c * unit)
        ties[a][b] = ties[a].get(b, 0) + c
        ties[b][a] = ties[b].get(a, 0) + c
    label: list[bool | None] = [None] * len(costs)
    todo = deque(range(len(costs)))
    while todo:  # a block whose terminal outweighs all its edges has that label in a minimum cut
        i = todo.popleft()
        if label[i] is None and abs(t[i]) >= sum(ties[i].values()):
            label[i] = t[i] > 0
            for j, c in ties[i].items():
                t[j] += c if label[i] else -c
                ties[j].pop(i)
                todo.append(j)
            ties[i] = {}
    free = [i for i, x in enumerate(label) if x is None]
    if free:
        reached = flow({i: t[i] for i in free}, {i: dict(ties[i]) for i in free})
        for i in free:
            label[i] = i in reached
    return [bool(x) for x in label]


def flow(t: dict[int, int], ties: dict[int, dict[int, int]]) -> set[int]:
    """Dinic's max-flow from blocks with t > 0 to blocks with t < 0; the blocks that the source still reaches."""
    give, take = {i: c for i, c in t.items() if c > 0}, {i: -c for i, c in t.items() if c < 0}
    while True:
        level = {i: 0 for i, c in give.items() if c > 0}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            found |= take.get(i, 0) > 0
            for j, c in ties[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return set(level)
        edges = {i: iter(list(ties[i])) for i in level}
        for s in [i for i, c in give.items() if c > 0]:
            path = [s]
            while path and give[s] > 0:
                i = path[-1]
                if take.get(i, 0) > 0:
                    push = min([give[s], take[i], *(ties[a][b] for a, b in zip(path, path[1:]))])
                    give[s] -= push
                    take[i] -= push
                    back = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:])):
                        ties[a][b] -= push
                        ties[b][a] = ties[b].get(a, 0) + push
                        if not ties[a][b]:
                            back = min(back, k + 1)
                    del path[back:]
                    continue
                for j in edges[i]:
                    if level.get(j) == level[i] + 1 and ties[i][j] > 0:
                        path.append(j)
                        break
                else:
                    level[i] = -1
                    path.pop()


def chosen(found: list[Block], model: Model, hidden: bool = False) -> list[bool]:
    """Which blocks are content; hidden: by form and ties alone, without what the markup says."""
    if not found:
        return []
    marked = any(b.towards for b in found)
    return cut([terminals(b, marked, model, hidden) for b in found], [(i, j, model.ties[r]) for i, j, r in neighbours(found)])


def extract(page: str | None, model: Model = Model()) -> str:
    """The main text: content blocks in page order, joined by two line ends."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, k in zip(found, chosen(found, model)) if k)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Model:
    """The model of about `sample` pages. What reaches the driver is at most 680 rows of counts, whatever the pages."""
    ship(pages.sparkSession)
    total = pages.count()
    if total > sample:
        by = F.xxhash64(*[F.col(f"`{f.name}`") for f in pages.schema.fields if f.dataType.typeName() in ("string", "long", "integer")])
        pages = pages.where(F.pmod(by, F.lit(1_000_003)) < F.lit(math.ceil(1_000_003 * sample / total)))

    def run(batches):
        counts: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(examples(x.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["k", "n"])

    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(trimmed(run), "k array<int>, n bigint")
    return learn({tuple(r.k): r.n for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect()})


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """The columns in keep, with text and n_chars (code points). Without a model one is fitted on these pages."""
    model = fit(pages.select(*keep, html_col), html_col) if model is None else model
    ship(pages.sparkSession)
    rows = pages.select(*keep, F.col(f"`{html_col}`").cast("string").alias("__html"))

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(trimmed(run), f"{schema}, text string, n_chars bigint")
