"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with its root-to-leaf path of block elements. For each path the text length and the
punctuation per block are aggregated, smoothed along the page and fused to one score. Elements of menus, adverts and the like,
by tag or by name, weaken the score of what stands in them; but a name says nothing where the element holds most of the page's text. Paths over the
threshold are content. The element that holds most of the content is the article: from it come, besides content paths, its headings,
lists and short paragraphs, but no paths of links and nothing weakened: an article may well be shorter than its footer.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import prepare, sliced

#: Fixed sets of names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CUT = frozenset("script style noscript template iframe svg math canvas object embed audio video head title button select textarea input xmp noembed noframes".split())
WEAK = frozenset("nav header footer aside form dialog menu".split())
WEAK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations comment comments disqus respond "
    "replies widget toolbar login search pagination pager complementary contentinfo alert".split()
)
#: Names of readers' comments, which may be longer than the article.
COMMENTS = frozenset("comment comments disqus respond replies".split())
#: Parts of class names that tell a state or a layout of an element, not what it is: has-sidebar, no-header, content-with-comments, menu-open.
STATES = frozenset("has have had no not without with is are show shows hide hides open opened closed enabled disabled active fixed sticky".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of these names, unless one of the fences lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
FENCES = frozenset("ul ol dl table".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¿¡]")


#: What the score of a block in a weak element is multiplied by.
WEAKENED = 0.02
#: The share of all content that the article's element holds; an element with as much of the page's text isn't weak for its name alone.
HELD = 0.7
#: Why an element is weak: its tag, a name, or a name of comments.
TAG, NAME, COMMENT = 1, 2, 3


class Block:
    """path: labels from the root; at: the elements' numbers in the page; linked: characters in links; weak: in an element that is weak; mass: what it adds to the text of its elements."""

    __slots__ = ("path", "at", "text", "linked", "weak", "mass")

    def __init__(self, path: tuple[str, ...], at: tuple[int, ...], text: str, linked: int, weak: bool) -> None:
        self.path, self.at, self.text, self.linked, self.weak, self.mass = path, at, text, linked, weak, 0


def _named(value: str) -> int:
    """What the tokens of a class, an id or a role say: NAME, COMMENT or nothing."""
    why = 0
    for token in value.split():
        parts = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()))
        if STATES.isdisjoint(parts) and (names := parts & WEAK_NAMES):
            why = max(why, NAME if COMMENTS.isdisjoint(names) else COMMENT)
    return why


def _kind(tag: str, attributes: str) -> tuple[bool, int, str]:
    """(whether the element has no text to show, why it is weak or 0, its name in paths: tag and classes)."""
    if tag in CUT:
        return True, 0, tag
    # a form may well be the whole page's
    label, weak = tag, 0 if tag not in WEAK else NAME if tag == "form" else TAG
    for name, value in _NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, 0, tag
        if name in ("class", "id", "role"):
            if tag not in ("html", "body", "article", "main") and weak != TAG:
                weak = max(weak, _named(value))
            if name == "class":
                label = tag + "." + ".".join(sorted(value.lower().split()))
    return False, weak, label


def _past(page: str, tag: str, at: int) -> int:
    """Where the element that was opened before `at` ends: past its own end tag, not that of one within it; the same place if it has none."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def blocks(page: str) -> list[Block]:
    """The blocks of text that shows, in page order; character references are decoded, white space is one space."""
    found: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, label, cut, number
    weak: dict[int, int] = {}  # why an element is weak, by number
    opened = 0
    parts: list[str] = []
    links, linked, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                found.append(Block(tuple(x[1] for x in stack), tuple(x[3] for x in stack), text, linked, False))
            parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1][2]):
            parts.append(text)
            linked += len(text) if links else 0

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        attributes = m[3] or m[6] or ""
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                put(" " if tag == "br" else "")
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif not closing and not (stack and stack[-1][2]) and any(_kind(tag, attributes)[:2]):  # an inline element that is hidden or has the name of an advert
                at = _past(page, tag, at)
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        links = 0
        inside_cut = bool(stack and stack[-1][2])
        if tag != "p" and tag in CLOSES or tag == "p" or tag not in INLINE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, ()):
                    del stack[i:]
                    inside_cut = bool(stack and stack[-1][2])
                    if tag not in CLOSES:
                        break
                elif stack[i][0] in FENCES or tag not in CLOSES:
                    break
        if tag in RAW:
            over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("div", "p", "span"):
            continue
        cut, why, label = _kind(tag, attributes)
        opened += 1
        if why:
            weak[opened] = why
        stack.append((tag, label, cut or inside_cut, opened))
    flush()
    held = dict.fromkeys(weak, 0)
    for b in found:
        b.mass = max(0, len(b.text) - b.linked) * (1 + len(_PUNCTUATION.findall(b.text)))
        for n in b.at:
            if n in held:
                held[n] += b.mass
    most = HELD * sum(b.mass for b in found)
    weak = {n: why for n, why in weak.items() if why != NAME or held[n] < most or not most}
    for b in found:
        b.weak = any(n in weak for n in b.at)
    return found


def _smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in (-2, -1, 0, 1, 2)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + k]) for w, k in zip(kernel, (-2, -1, 0, 1, 2)) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_scores(found: list[Block]) -> tuple[list[float], dict[tuple[str, ...], float]]:
    """(score of each block, score of each path): text length a block of the path times one more than its punctuation, both smoothed.

    A path's score is the geometric mean of its blocks' mean and of the same without smoothing, which carries scores over to neighbours.
    """
    held: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        of = held.setdefault(b.path, [0.0, 0.0, 0.0])
        of[0] += max(0, len(b.text) - b.linked)
        of[1] += len(_PUNCTUATION.findall(b.text)) if b.linked * 2 < len(b.text) else 0
        of[2] += 1
    text = _smooth([held[b.path][0] / held[b.path][2] for b in found])
    marks = _smooth([held[b.path][1] / held[b.path][2] for b in found])
    scores = [t * (1 + p) * (WEAKENED if b.weak else 1) for b, t, p in zip(found, text, marks)]
    fused: dict[tuple[str, ...], list[float]] = {}
    for b, s in zip(found, scores):
        fused.setdefault(b.path, []).append(s)
    own = {path: a / n * (1 + p / n) for path, (a, p, n) in held.items()}
    return scores, {path: math.sqrt(sum(s) / len(s) * own[path]) for path, s in fused.items()}


def _holder(found: list[Block], content: list[float]) -> tuple[int, ...]:
    """The deepest element with several blocks that has HELD of all content; content: a block's score, 0 where its path is none."""
    share: dict[tuple[int, ...], list[float]] = {}
    for b, c in zip(found, content):
        for depth in range(len(b.at) + 1):
            of = share.setdefault(b.at[:depth], [0.0, 0.0])
            of[0] += c
            of[1] += 1
    fits = [at for at, (c, n) in share.items() if c >= HELD * sum(content) and (n > 1 or not at)]
    return max(fits, key=len)


def main_text(page: str | None, factor: float = 0.8, part: float = 0.5) -> str:
    """The article's blocks, joined by line feeds. Null, empty pages and pages without any text give the empty text.

    Content paths score at least factor times the blocks' deviation and part of the best path, or are the best. A page of weak elements alone has no article.
    """
    found = blocks(page or "")
    if not found or all(b.weak for b in found):
        return ""
    scores, value = path_scores(found)
    mean = sum(scores) / len(scores)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    total: dict[tuple[str, ...], float] = {}
    links: dict[tuple[str, ...], list[int]] = {}
    for b, s in zip(found, scores):
        total[b.path] = total.get(b.path, 0.0) + s
        of = links.setdefault(b.path, [0, 0])
        of[0] += b.linked
        of[1] += len(b.text)
    linked = {path for path, (a, n) in links.items() if 2 * a > n}
    best = max((b.path for b in found if not b.weak), key=lambda path: (total[path], -len(path)))
    cut = min(max(factor * deviation, part * value[best]), value[best])
    content = {path for path, v in value.items() if v >= cut and path not in linked} | {best}
    holder = _holder(found, [s if b.path in content else 0.0 for b, s in zip(found, scores)])
    top = len(holder) < 3  # the whole page or its body: other paths in it are no part of an article

    def kept(b: Block) -> bool:
        if b.weak:
            return False
        heading = bool(b.path) and b.path[-1].split(".")[0] in HEADINGS
        if b.at[: len(holder)] != holder:
            return b.path in content
        return b.path in content or (heading if top else heading or b.path not in linked)

    return "\n".join(b.text for b in found if kept(b))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row's whole html; repeated rows each give a row."""
    prepare(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").alias("_html"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [f.name for f in schema])

    return rows.mapInArrow(run, schema)
