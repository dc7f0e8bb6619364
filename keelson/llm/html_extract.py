"""Main text of web pages by tree scoring.

A page is read once into a light tree of block elements. Every paragraph (a run
of text in one block) passes points for its length and commas to its parent, in
full, and to its grandparent, by half; a container's score is discounted by its
link density. The best container is kept, with what stands beside it on every
level up to its outermost article or main element, and beside that (without one,
beside the container): text, headings and blocks of any size that aren't mostly links. Menus,
headers, footers, sidebars, notices, adverts, forms and reader comments are known
by element, role, class or id and left out first.

Defined cases: null and empty pages and pages without text give the empty
string; broken markup (unclosed elements, unmatched end tags, missing ends) is
read as browsers read it; nothing is dropped for its size; repeated rows give
the same text; an empty table gives an empty table; other columns are carried
as asked.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import blocks, schema_of, whole_texts

#: Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "head nav header footer aside form button select option menu dialog template noscript svg math canvas object "
    "audio video search label input".split()
)
#: Elements that an opening tag ends, up to one of the fences.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Points that an element starts with.
BONUS = {
    "article": 15.0, "main": 10.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
    "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "dt": -3.0, "dd": -3.0,
}
#: Marks of an element: plain, around the article by its words or a form, around it by what it is, never shown.
PLAIN, WORDED, FOREIGN, GONE = range(4)
#: Dropped elements that can hold the article by mistake, with their marks; the others are never shown as text.
HOLDERS = {"form": WORDED} | dict.fromkeys("nav header footer aside dialog menu search".split(), FOREIGN)
#: Parts of a word in class, id or role that mark parts around the article, those of others' texts, and
#: parts that may stand beside them. A word with any other part (has-sidebar, menu-open) marks nothing.
_AROUND = re.compile(
    r"banners?|notices?|notification|alert|popup|modal|overlay|share|sharing|social|related|recommended|sidebar|side|"
    r"widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|login|signup|search|pagination|"
    r"pager|skip|complementary|contentinfo|hidden"
)
_FOREIGN = re.compile(
    r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|newsletter|subscribe|subscription|comments?|disqus|"
    r"repl(?:y|ies)|respond"
)
_BESIDE = re.compile(
    r"\d*|site|page|main|global|top|bottom|left|right|primary|secondary|sticky|fixed|mobile|desktop|area|box|bar|block|"
    r"wrap|wrapper|container|inner|outer|panel|section|region|row|group|unit|slot|module|leaderboard|google|list|items?|"
    r"links?|icons?|buttons?|form|title|text|body|media|posts?|article|entry|thread|toggle|trail"
)
_NEVER = {"html", "body", "article", "main"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|([^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}

#: Share of link text from which a block beside the best container is left out.
DENSE_LINKS = 0.5
#: A run of text is prose if it is a paragraph or so long, with a smaller share of links.
PROSE_CHARS, PROSE_LINKS = 80, 0.25
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    mark: int
    foreign: bool = False  # an article element of others' text, such as a comment
    score: float = 0.0
    chars: int = 0
    links: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("#root", -1, PLAIN)])
    runs: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links


def _mark(tag: str, attributes: str) -> int:
    mark = HOLDERS.get(tag, GONE if tag in DROPPED else PLAIN)
    if not attributes or mark == GONE:
        return mark
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            mark = max(mark, *map(_word_mark, value.lower().split()), PLAIN)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            mark = FOREIGN
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            mark = FOREIGN
    return mark


@lru_cache(maxsize=10_000)
def _word_mark(word: str) -> int:
    mark = PLAIN
    for part in re.split("[-_]+", word):
        if _FOREIGN.fullmatch(part):
            mark = FOREIGN
        elif _AROUND.fullmatch(part):
            mark = max(mark, WORDED)
        elif not _BESIDE.fullmatch(part):
            return PLAIN
    return mark


def parse(source: str) -> Page:
    page = Page()
    nodes, runs = page.nodes, page.runs
    stack: list[tuple[str, int, bool, bool]] = [("#root", 0, False, False)]  # tag, node, dropped, in a link
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                runs.append((stack[-1][1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def close_to(depth: int) -> None:
        if any(entry[0] in BLOCK for entry in stack[depth:]):
            flush()
        del stack[depth:]

    at = 0
    while match := _TOKEN.match(source, at):
        at = match.end()
        if (text := match[7]) is not None:
            if not stack[-1][2]:
                held.append(text)
                if stack[-1][3]:
                    linked += len(text)
            continue
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:  # an end tag
            if tag == "br":
                held.append(" ")
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            end = _CLOSE[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            held.append(" ")
            continue
        attributes = match[3] if match[2] else match[6]
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
            ends, fence = IMPLIED_END.get(tag, ((), ()))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ends:
                    close_to(depth)
                    break
                if stack[depth][0] in fence or not ends:
                    break
            if tag == "body":  # a head left open ends here
                close_to(next((d for d in range(1, len(stack)) if stack[d][0] == "head"), len(stack)))
            flush()
        _, node, dropped, in_link = stack[-1]
        mark = _mark(tag, attributes)
        foreign = tag == "article" and mark == FOREIGN
        if tag in _NEVER:
            mark = PLAIN
        if tag in BLOCK:
            nodes.append(Node(tag, node, mark, foreign))
            node = len(nodes) - 1
        # Marked blocks are judged with the whole page; parts of a line go at once.
        dropped = dropped or mark == GONE or (mark != PLAIN and tag not in BLOCK)
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, node, dropped, in_link or tag == "a"))
    flush()
    return page


def shown(page: Page) -> list[tuple[int, str, int]]:
    """The runs outside the parts around the article.

    A marked element stays if it holds the page's article or main element (that
    with most prose); one marked by its words alone, or a form, also if it holds
    most of the page's prose.
    """
    nodes, runs = page.nodes, page.runs
    if not any(node.mark for node in nodes):
        return runs
    prose, chars = [0] * len(nodes), [0] * len(nodes)
    for at, text, links in runs:
        chars[at] += len(text)
        if links < PROSE_LINKS * len(text) and (nodes[at].tag == "p" or len(text) > PROSE_CHARS):
            prose[at] += len(text)
    for i in range(len(nodes) - 1, 0, -1):
        prose[nodes[i].parent] += prose[i]
        chars[nodes[i].parent] += chars[i]
    holds = set()
    for tag in ("article", "main"):
        of_page = (i for i, node in enumerate(nodes) if node.tag == tag and chars[i] and not node.foreign)
        i = max(of_page, key=lambda i: (prose[i], chars[i], -i), default=0)
        while i > 0:
            holds.add(i)
            i = nodes[i].parent
    gone = [False] * len(nodes)
    for i, node in enumerate(nodes):
        stays = node.mark == PLAIN or i in holds or (node.mark == WORDED and 2 * prose[i] > prose[0])
        gone[i] = not stays or (i > 0 and gone[node.parent])
    return [run for run in runs if not gone[run[0]]]


def main_text(source: str) -> str:
    """The page's main text: one line per block, in page order."""
    page = parse(source)
    nodes, runs = page.nodes, shown(page)
    if not runs:
        return ""
    scored = set()
    for at, text, links in runs:
        commas = text.count(",") + text.count("，") + text.count("、")
        points = 1 + commas + len(text) / 100
        node = at
        if nodes[at].tag not in ("div", "section", "article", "main", "body", "#root", "td"):
            node = nodes[at].parent
        share = points
        for _ in range(2):
            if node < 0:
                break
            nodes[node].score += share
            scored.add(node)
            node, share = nodes[node].parent, share / 2
        node = at
        while node >= 0:
            nodes[node].chars += len(text)
            nodes[node].links += links
            node = nodes[node].parent

    def density(i: int) -> float:
        return nodes[i].links / max(1, nodes[i].chars)

    value = {i: (nodes[i].score + BONUS.get(nodes[i].tag, 0.0)) * (1 - density(i)) for i in scored}
    best = max(value, key=lambda i: (value[i], -i))
    # Up to the outermost article or main element, then on to the first element that holds more.
    path = [best]
    while nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    tops = [k for k, i in enumerate(path) if nodes[i].tag in ("article", "main")]
    whole = tops[-1] if tops else 0
    top = next((k for k, i in enumerate(path) if nodes[i].chars > nodes[path[whole]].chars), whole)
    kept, around = {best}, set(path[1 : top + 1])
    for i, node in enumerate(nodes):
        if node.parent in around and i not in around and (density(i) < DENSE_LINKS or node.tag in HEADINGS):
            kept.add(i)
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside[i] = i in kept or (node.parent >= 0 and inside[node.parent])
    return "\n".join(
        text for at, text, links in runs if inside[at] or (at in around and links < DENSE_LINKS * len(text))
    )


def extract(pages: DataFrame, carry: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``carry`` of ``pages`` with text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.decode()) for _, ps in blocks(whole_texts(batch.column(len(carry)))) for p in ps]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*carry, "text", "n_chars"],
            )

    taken = pages.select(*carry, F.col(html_col).alias("__html"))
    return taken.mapInArrow(run, schema_of(pages.select(*carry), "text string, n_chars long"))
