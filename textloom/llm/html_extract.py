"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is read as a stream of tags and text; blocks are runs of text between block-level tags, each with its chain of
open elements. A logistic score of a block (its elements, class names, links, length) gives the costs of calling it
content or boilerplate: the capacities to the two terminals. Neighbours in page order and blocks of the same parent
are tied by smoothness edges, stronger the more of the chain they share. The minimum cut, by augmenting paths, is the
labelling of least total cost; blocks on the content side are the text.

Null and empty html gives an empty text. Broken markup is read as far as it goes: unclosed elements end with their
parent, stray end tags are ignored, an unclosed comment, script, style, textarea or title runs to the end. A tag ends at
its '>'; a quote hides one only around a value, after '=', and if it is closed. What a button, select, object and the
like (HIDDEN) hold isn't text; one without an end tag of its own ends with its parent or before the next block-level
tag. Where the cut leaves nothing, as on a page of a few words, the blocks that neither an element nor a name speaks
against are the text. Each row is judged alone, so repeated rows give equal texts; pages are read whole, however long; an
empty table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops as T

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
HIDDEN = frozenset("noscript iframe noembed noframes template svg math select option button object canvas audio video map".split())
PLAIN = frozenset("noscript iframe noembed noframes".split())  # hidden ones whose tags aren't tags
NESTS = frozenset("template object svg math".split())  # hidden ones that may hold their like
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "table"), "th": ("td th", "table")}
# Weights of the block score (positive: content).
AWAY = {"nav": -9, "footer": -9, "aside": -9, "form": -9, "fieldset": -9, "dialog": -9, "menu": -9, "header": -9, "head": -9, "address": -3, "figure": -1}
TOWARDS = {"article": 5, "main": 5}
NAMES = re.compile(
    r"(?<![a-z])(?:(ads?|adverts?|advertis\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w*|sign-?up|log-?in|register|shar(?:e|ing)|socials?|related|recommend\w*|side-?bar|side|widgets?|menus?|nav(?:bar|igation)?|breadcrumbs?|pag(?:er|ination)|foot(?:er)?|head(?:er)?|masthead|comments?|commentlist|disqus|repl(?:y|ies)|respond|reactions?|toolbar|search|copyright|legal|disclaimer|hidden|skip)"
    r"|(article|main|content|story|post-?(?:body|content|text)|entry(?:-content)?|body-?text|article-?body|prose))(?![a-z])"
)
SUBJECTS = frozenset("article main section".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
TAGS = re.compile(rf"<(/?)({'|'.join(sorted(HIDDEN))})(?=[\s/>])", re.I)
SPACE = re.compile(r"\s+")
UNIT = 16  # capacities are whole numbers of 1 / UNIT


def named(tag: str, names: str) -> list[tuple[str, str]]:
    """What of the names of an element speaks against it, or for it.

    An article, main or section may be named by its subject or state (related-work, comments-enabled): there a name counts
    as a whole or by its last part, elsewhere by any part.
    """
    if tag not in SUBJECTS:
        return NAMES.findall(names)
    parts = (x for name in names.strip("\"'").split() for x in dict.fromkeys((name, name.replace("_", "-").rsplit("-", 1)[-1])))
    return [m.groups(default="") for m in map(NAMES.fullmatch, parts) if m]


class Element:
    __slots__ = ("tag", "parent", "depth", "bias", "inside")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.inside = bool(parent and parent.inside) or tag in TOWARDS
        own = AWAY.get(tag, 0) + TOWARDS.get(tag, 0)
        if tag == "header" and parent and parent.inside:
            own = 0  # an article's own header holds its heading
        if attributes:
            for k, v in ATTRIBUTE.findall(attributes):
                k = k.lower()
                if k in ("class", "id", "role"):
                    for bad, good in named(tag, entities.unescape(v).lower()):
                        if good:
                            own += 2
                        elif not (bad.startswith("head") and parent and parent.inside) and tag not in ("body", "html"):
                            own -= 9
                elif k == "hidden" or k == "style" and UNSEEN.search(v.lower()) or k == "aria-hidden" and "true" in v.lower():
                    own -= 20
        self.bias = own + (parent.bias if parent else 0)
        if own <= -9 and parent and parent.bias > 0:
            self.bias = own  # what is set apart inside an article is no part of it


class Block:
    __slots__ = ("text", "element", "links")

    def __init__(self, text: str, element: Element, links: float):
        self.text, self.element, self.links = text, element, links


def ended(page: str) -> dict[int, int]:
    """Where the hidden elements that have an end tag of their own begin, and where that tag begins."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for m in TAGS.finditer(page):
        tag = m[2].lower()
        starts = begun.setdefault(tag, [])
        if not m[1]:
            if tag not in NESTS:
                starts.clear()
            starts.append(m.start())
        elif starts:
            out[starts.pop()] = m.start()
    return out


def blocks_of(page: str) -> list[Block]:
    root = Element("#", "", None)
    stack, out, parts, links = [root], [], [], [0]
    state = {"a": 0}
    hidden: list[tuple[int, bool]] = []  # places on the stack, and whether a block-level tag ends the element
    ends: dict[int, int] | None = None

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                seen = range((hidden[0][0] if hidden else len(stack)) - 1, -1, -1)
                where = next(stack[i] for i in seen if stack[i].tag in BLOCK or stack[i].tag == "#")
                out.append(Block(text, where, min(1.0, links[0] / len(text))))
            parts.clear()
        links[0] = 0

    def close(i: int) -> None:
        for e in stack[i:]:
            if e.tag == "a":
                state["a"] -= 1
        del stack[i:]
        while hidden and hidden[-1][0] >= i:
            hidden.pop()

    def add(raw: str) -> None:
        if raw and not hidden:
            text = entities.unescape(raw)
            parts.append(text)
            if state["a"]:
                links[0] += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                if not hidden:
                    flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if (not hidden or i < hidden[0][0]) and any(e.tag in BLOCK for e in stack[i:]):
                        flush()
                    close(i)
                    break
                if tag not in BLOCK and tag not in HIDDEN and stack[i].tag in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in BLOCK:
            while hidden and hidden[-1][1]:
                close(hidden[-1][0])
        if tag == "br":
            if not hidden:
                parts.append(" ")
            continue
        if tag in BLOCK and not hidden:
            flush()
            if tag in CLOSES:
                same, limit = (x.split() for x in CLOSES[tag])
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in same:
                        close(i)
                        break
                    if stack[i].tag in limit:
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in VOID:
            continue
        alone = m[3].rstrip().endswith("/")
        if tag in RAW:
            if not hidden:
                parts.append(" ")
            if not alone:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if end or not any(stack[i].tag in ("svg", "math") for i, _ in hidden):
                    at = end.end() if end else n
            continue
        if tag in HIDDEN:
            if not hidden:
                parts.append(" ")
            if alone:
                continue
            if tag == "option" and stack[-1].tag == "option":
                close(len(stack) - 1)
            if ends is None:
                ends = ended(page)
            if tag in PLAIN and m.start() in ends:
                at = max(at, ends[m.start()])  # the end tag is read next
            hidden.append((len(stack), m.start() not in ends))
        elif hidden and alone:
            continue
        if tag == "a":
            state["a"] += 1
        stack.append(Element(tag, "" if hidden else m[3], stack[-1]))
    flush()
    return out


def block_score(b: Block) -> float:
    """Log odds that a block is content."""
    words = b.text.count(" ") + 1
    score = b.element.bias + min(words, 60) / 15 - 1.5 - 5 * b.links
    if b.text[-1] in ".!?:;…\"'”»)":
        score += 1
    if b.element.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 1.5
    return max(-12.0, min(12.0, score))


def smoothness(a: Element, b: Element) -> float:
    """Strength of the tie of two blocks, from how near their elements are in the document tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return 1.2 / (1 + steps)


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side. Capacities are whole; edges go both ways. Shortest augmenting paths."""
    n = len(source)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if c and a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    left = [s - t for s, t in zip(source, sink, strict=True)]  # a node's own path is augmented first
    while True:
        came = [-2] * n
        queue = deque(i for i in range(n) if left[i] > 0)
        for i in queue:
            came[i] = -1
        end = -1
        while queue:
            i = queue.popleft()
            if left[i] < 0:
                end = i
                break
            for j, c in near[i].items():
                if c > 0 and came[j] == -2:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            return [c != -2 for c in came]
        path, i = [end], end
        while came[i] >= 0:
            i = came[i]
            path.append(i)
        path.reverse()
        flow = min(left[path[0]], -left[end], *(near[a][b] for a, b in zip(path, path[1:], strict=False)))
        left[path[0]] -= flow
        left[end] += flow
        for a, b in zip(path, path[1:], strict=False):
            near[a][b] -= flow
            near[b][a] += flow


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    scores = [round(block_score(b) * UNIT) for b in blocks]
    edges = [(i, i + 1, round(smoothness(a.element, b.element) * UNIT)) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):  # the next block of the same parent, if others lie between
        key = id(b.element.parent)
        if key in last and last[key] != i - 1:
            edges.append((last[key], i, round(0.4 * UNIT)))
        last[key] = i
    keep = minimum_cut([max(s, 0) for s in scores], [max(-s, 0) for s in scores], edges)
    if not any(keep):  # a page of a few words: all that no element or name speaks against
        keep = [b.element.bias >= 0 and b.links < 0.5 for b in blocks]
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, "html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
