"""The main text of HTML pages, by tag-path ratios.

A page is read into blocks: the text between two block-level tags, with the path of block-level tags that leads to it.
Text length (outside links) and punctuation are summed per path and divided by the number of its blocks; the ratios,
multiplied, are given back to the blocks, smoothed along the page with neighbours of like paths, averaged per path
again, and paths above a share of the text-weighted mean are content. Around content paths, what the same
article holds besides (headings, short lists) is content too. Elements whose tag, role or class says navigation, notice,
advert, form or comment never take part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.llm.common import small_batches


@dataclass(frozen=True)
class ExtractionParams:
    #: Paths below this share of the text-weighted mean of all are not content.
    threshold: float = 0.15
    #: Marks that a block without punctuation counts as.
    unmarked: float = 0.5
    #: Weight of the block before and of the block after, scaled by how much of the path they share.
    neighbour: float = 0.25
    #: Blocks with a larger share of their text in links are not added around content paths.
    links: float = 0.5
    #: Paths through an article or main element count so many times as much.
    article: float = 4.0


# Names of HTML elements by their role, and words that class names, ids and roles use for page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog fieldset footer form head iframe input label menu nav noembed noframes noscript
    object optgroup option output script select style svg template textarea title video xmp""".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike
    strong sub sup time tt u var wbr""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("blockquote caption dd dt figcaption li pre td th".split())
PART_WORDS = frozenset("""ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments
    consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification
    pagination pager paywall popup promo promoted promotion related replies reply respond rss share sharing shoutbox sidebar sidebars signup
    skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split())
PART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?¿¡…،؛؟。、，；：！？।]")

ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
COMMENT_END = re.compile(r"--!?>")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Paths end at this depth; what lies deeper counts to the element there.
DEEPEST = 512
#: Why an element takes no part: not at all, by its class, by its tag or role.
NOT, BY_CLASS, BY_TAG = range(3)


@dataclass
class Element:
    tag: str
    #: Numbers of the path and of the innermost block element.
    path: int
    number: int
    out: int = NOT
    heading: bool = False
    #: In a page header, where only an article's headings count.
    header: bool = False
    linked: bool = False
    #: Tag of the innermost block element.
    block: str = ""


@dataclass
class Block:
    text: str
    path: int
    element: int
    tag: str
    linked: int


@dataclass
class Page:
    """Blocks in page order; per path its tag, parent path and depth; per block element its parent and tag."""

    blocks: list[Block] = field(default_factory=list)
    paths: list[tuple[str, int, int]] = field(default_factory=lambda: [("", -1, 0)])
    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])


def part_of_page(tag: str, attributes: str) -> int:
    """Why an element of these attributes takes no part, or that it does."""
    if tag in DROPPED:
        return BY_TAG
    if not attributes or attributes.isspace():
        return NOT
    named = {}
    for m in ATTRIBUTE.finditer(attributes):
        named.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    style = "".join(named.get("style", "").lower().split())
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return BY_TAG
    if tag in ("html", "body", "main"):
        return NOT
    if named.get("role", "").lower() in PART_ROLES:
        return BY_TAG
    for name in f'{named.get("class", "")} {named.get("id", "")}'.split():
        words = [w.lower() for w in WORD_PARTS.findall(name)]
        if not words or words[0] in ("has", "is", "no", "not", "with", "without"):
            continue
        if tag == "article" and words[0] not in ("comment", "comments", "reply"):
            continue
        if any(w in PART_WORDS for w in words):
            return BY_CLASS
    return NOT


class Reader:
    """One pass over a page: a stack of open elements, and the text since the last block-level tag."""

    def __init__(self, strict: bool):
        self.strict = strict
        self.page = Page()
        self.path_numbers: dict[tuple[int, str], int] = {}
        self.stack = [Element("", 0, 0)]
        self.open = Counter()
        self.pieces: list[str] = []
        self.linked = 0

    def say(self, text: str) -> None:
        top = self.stack[-1]
        if top.out != NOT or (top.header and not top.heading):
            return
        self.pieces.append(text)
        if top.linked:
            self.linked += len(text)

    def end_block(self) -> None:
        if not self.pieces:
            return
        # References are decoded in the whole block: a comment or tag between two pieces leaves them apart.
        text = " ".join("".join(map(entities.unescape, self.pieces)).split())
        if text:
            top = self.stack[-1]
            self.page.blocks.append(Block(text, top.path, top.number, top.block, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def pop(self) -> None:
        gone = self.stack.pop()
        self.open[gone.tag] -= 1

    def close_to(self, tag: str) -> None:
        """Close the innermost open `tag` and all inside it."""
        while self.stack[-1].tag != tag:
            self.pop()
        self.pop()

    def closes(self, tags: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        """Close an open element of `tags` unless one of `scopes` was opened inside it."""
        if not any(self.open[t] for t in tags):
            return
        for element in reversed(self.stack):
            if element.tag in scopes:
                return
            if element.tag in tags:
                self.close_to(element.tag)
                return

    def start(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if tag == "br":
            self.say(" ")
            return
        if not inline:
            self.end_block()
            if self.open["p"]:
                self.closes(("p",), ("button", "table", "td", "th", "object"))
            if tag == "li":
                self.closes(("li",), ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                self.closes(("dt", "dd"), ("dl",))
            elif tag in ("td", "th"):
                self.closes(("td", "th"), ("tr", "table"))
            elif tag in ("tr", "tbody", "thead", "tfoot"):
                self.closes(("tr",), ("table",))
            elif tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.pop()
        elif tag == "a" and self.open["a"]:
            self.closes(("a",), ("table", "td", "th", "object"))
        if tag in VOID:
            return
        above = self.stack[-1]
        out = above.out or part_of_page(tag, attributes)
        if not self.strict and (out == BY_CLASS or tag == "form"):
            out = above.out
        if out == BY_CLASS and above.out == BY_CLASS and tag == "main":
            out = NOT  # a wrapper around everything, not a part of the page
        made = Element(tag, above.path, above.number, out, above.heading or tag in HEADINGS,
                       above.header or tag == "header", above.linked or tag == "a", above.block if inline else tag)
        if not inline:
            page, key = self.page, (above.path, tag)
            if page.paths[above.path][2] >= DEEPEST:
                self.path_numbers[key] = above.path
            elif key not in self.path_numbers:
                self.path_numbers[key] = len(page.paths)
                page.paths.append((tag, above.path, page.paths[above.path][2] + 1))
            made.path, made.number = self.path_numbers[key], len(page.parents)
            page.parents.append(above.number)
            page.tags.append(tag)
            if tag == "header" and not (self.open["article"] or self.open["main"]):
                made.out = made.out or BY_TAG
        self.stack.append(made)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.end_block()
        if not self.open[tag]:
            return
        if inline:
            for element in reversed(self.stack):
                if element.tag == tag:
                    self.close_to(tag)
                    return
                if element.tag not in INLINE:
                    return
        self.close_to(tag)

    def read(self, source: str) -> Page:
        at, size = 0, len(source)
        while at < size:
            sign = source.find("<", at)
            if sign < 0:
                self.say(source[at:])
                break
            if sign > at:
                self.say(source[at:sign])
            after = source[sign + 1 : sign + 2]
            if source.startswith("<!--", sign):
                if source.startswith((">", "->"), sign + 4):
                    at = source.find(">", sign) + 1
                    continue
                found = COMMENT_END.search(source, sign + 4)
                at = found.end() if found else size
            elif after in ("!", "?") or (after == "/" and not source[sign + 2 : sign + 3].isascii()) or source.startswith("</>", sign):
                close = source.find(">", sign)
                at = close + 1 if close >= 0 else size
            else:
                found = TAG.match(source, sign)
                if not found:
                    if not after or not (after.isascii() and after.isalpha() or after == "/" and source[sign + 2 : sign + 3].isalpha()):
                        self.say("<")
                        at = sign + 1
                        continue
                    # An attribute whose quote never ends: the tag ends at the next sign, or with the page.
                    close = source.find(">", sign)
                    at = close + 1 if close >= 0 else size
                    continue
                at = found.end()
                tag = found[2].lower()
                if found[1]:
                    self.end(tag)
                elif tag == "plaintext":
                    break
                else:
                    self.start(tag, found[3])
                    if tag in RAW:
                        close = RAW_ENDS[tag].search(source, at)
                        if not close:
                            break
                        at = close.start()
        self.end_block()
        return self.page


def fused_ratios(page: Page, params: ExtractionParams) -> dict[int, float]:
    """The smoothed product of text length and punctuation per block, of every path."""
    texts, marks, counts = Counter(), Counter(), Counter()
    for block in page.blocks:
        texts[block.path] += len(block.text) - block.linked
        marks[block.path] += len(PUNCTUATION.findall(block.text))
        counts[block.path] += 1
    inside = [False] * len(page.paths)
    for number, (tag, parent, _) in enumerate(page.paths):
        inside[number] = tag in ("article", "main") or (parent >= 0 and inside[parent])
    ratio = {p: texts[p] / n * (marks[p] / n + params.unmarked) * (params.article if inside[p] else 1.0) for p, n in counts.items()}

    shared: dict[tuple[int, int], float] = {}

    def likeness(one: int, two: int) -> float:
        """The share of two paths that is the same."""
        if one == two:
            return 1.0
        if (one, two) not in shared:
            a, b, longest = one, two, max(page.paths[one][2], page.paths[two][2])
            while a != b:
                if page.paths[a][2] >= page.paths[b][2]:
                    a = page.paths[a][1]
                else:
                    b = page.paths[b][1]
            shared[one, two] = page.paths[a][2] / longest
        return shared[one, two]

    sums: dict[int, float] = defaultdict(float)
    blocks = page.blocks
    for at, block in enumerate(blocks):
        value, weight = ratio[block.path], 1.0
        for near in blocks[max(0, at - 1) : at] + blocks[at + 1 : at + 2]:
            share = params.neighbour * likeness(block.path, near.path) ** 2
            value += share * ratio[near.path]
            weight += share
        sums[block.path] += value / weight
    return {p: sums[p] / n for p, n in counts.items()}


def content(page: Page, params: ExtractionParams) -> list[Block]:
    """The blocks of content paths, and what belongs to them."""
    blocks = page.blocks
    if not blocks:
        return []
    fused = fused_ratios(page, params)
    mass = sum(len(b.text) - b.linked for b in blocks)
    if not mass:
        return []
    mean = sum(fused[b.path] * (len(b.text) - b.linked) for b in blocks) / mass
    chosen = [fused[b.path] >= params.threshold * mean and fused[b.path] > 0 for b in blocks]

    def outermost(tag: str) -> list[int]:
        """The outermost element of this tag around every block, or -1."""
        found: list[int] = []
        for number, parent in enumerate(page.parents):
            there = found[parent] if parent >= 0 else -1
            found.append(there if there >= 0 else number if page.tags[number] == tag else -1)
        return [found[b.element] for b in blocks]

    # With most of the content in articles (else in main elements), these are the content, and nothing outside them.
    wanted = sum(len(b.text) for b, c in zip(blocks, chosen) if c)
    for tag in ("article", "main"):
        roots = outermost(tag)
        full = {r for r, c in zip(roots, chosen) if c and r >= 0}
        if 2 * sum(len(b.text) for b, r in zip(blocks, roots) if r in full) >= wanted:
            return [b for b, r, c in zip(blocks, roots, chosen)
                    if r in full and (c or b.tag in HEADINGS or b.linked <= params.links * len(b.text))]
    # Without them: headings right before content; of the elements whose children are content, what lies between these
    # children, and lists, quotations and tables wherever they are.
    holds = {page.parents[b.element] for b, c in zip(blocks, chosen) if c and page.tags[page.parents[b.element]] not in ("", "html", "body")}
    inside: list[int] = []
    for number, parent in enumerate(page.parents):
        inside.append(number if number in holds else inside[parent] if parent >= 0 else -1)
    first, last = {}, {}
    for at, (block, c) in enumerate(zip(blocks, chosen)):
        if c:
            holder = page.parents[block.element]
            first.setdefault(holder, at)
            last[holder] = at
    out: list[Block] = []
    follows = False  # whether the next block that is no heading is content
    for at in range(len(blocks) - 1, -1, -1):
        block, keep = blocks[at], chosen[at]
        if block.tag in HEADINGS:
            keep = keep or follows
        else:
            follows = keep
        holder = inside[block.element]
        if not keep and holder >= 0 and block.linked <= params.links * len(block.text):
            keep = first[holder] < at < last[holder] or block.tag in LISTED
        if keep:
            out.append(block)
    return out[::-1]


def main_text(source: str, params: ExtractionParams = ExtractionParams()) -> str:
    """The content blocks of a page, one line each."""
    found = content(Reader(strict=True).read(source), params)
    if not found:  # a page whose class names call all of it a part of the page
        found = content(Reader(strict=False).read(source), params)
    return "\n".join(b.text for b in found)


def extract_pages(df: DataFrame, params: ExtractionParams = ExtractionParams(), id_col: str = "page_id", html_col: str = "html",
                  keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """`id_col`, the columns `keep`, text, n_chars: the main text of every page.

    A null or empty page, or one without content, has an empty text. Broken markup is read as far as it makes sense: an
    open tag, comment or script at the end of a page ends there. Pages are read whole, each alone; repeated rows and null
    ids pass through. An empty table gives an empty one; other columns are not read.
    """
    named = {f"c{at}": c for at, c in enumerate((id_col, *keep))}
    slim = df.select(*(F.col(c).alias(a) for a, c in named.items()), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    kinds = ", ".join(f"{a} {df.schema[c].dataType.simpleString()}" for a, c in named.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(source, params) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(a) for a in named), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*named, "text", "n_chars"])

    made = slim.mapInArrow(work, f"{kinds}, text string, n_chars bigint")
    return made.select(*(F.col(a).alias(c) for a, c in named.items()), "text", "n_chars")
