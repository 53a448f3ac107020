"""Main text of web pages by block rules in two passes.

The page is cut into blocks at block-level tags. What stands in menus, footers, forms and the like is bad. The first pass
weighs votes for every other block: length with density of stop words, link density, and whether an article element holds
it; no vote decides alone but that of long prose. Blocks without a clear majority stay ambiguous. In the second pass they
inherit the label of the nearest decided neighbours: of those in the same element first, then in the same article, then of any.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ["script", "style", "textarea", "title"]  # without an end tag, the rest of the page is theirs
OPAQUE = ["noscript", "template", "iframe", "svg", "math", "select", "object", "canvas", "video", "audio"]  # left out with what they hold, where they end
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW + OPAQUE)})(?=[\s/>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW + OPAQUE}
ATTRIBUTE = re.compile(r"(?<![\w-])(?:([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(hidden)(?![\w-]))", re.I)
PIECE = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption li dt dd td th".split())  # hold one block, their parent holds its neighbours
BOILERPLATE = set("aside button dialog footer form head menu nav".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter pager pagination popup promo promoted sidebar signup social sponsor "
    "sponsored sponsors subscribe toolbar".split())
DOUBTFUL = set(  # also words of a subject: only alone, or with a word for a piece of a layout
    "alert aside copyright dialog disclaimer discussion legal notice notices notification overlay promotion recommended related replies reply respond "
    "response responses search share sharing skip subscription teaser widget".split())
LAYOUT = set("area articles bar block bottom box buttons col column container content form icons inner items left links list main panel posts right row section site stories top wrapper".split())
REMARKS = set("comment comments replies reply respond responses disqus discussion".split())
CONTENT = set("article articlebody content entry main post prose story".split())
STOP = set(
    "a about all an and are as at be but by for from had has have he his in is it its not of on or she that the their they this to was were which will with you "
    "der die das den dem des ein eine einen und oder ist im in von zu mit auf für nicht sich auch es als an wie wird sind bei nach "
    "le la les un une des du de et ou est que qui dans pour pas sur avec ce il elle au aux par plus ne se sont "
    "el los las una y o es en por con para no su lo como del al más pero sus".split())

SHORT, LONG, LINKS, FEW, MANY = 70, 200, 0.33, 0.10, 0.20
GOOD, BAD = True, False


@dataclass
class Block:
    """A run of text between block-level tags. ``inside``: number of the article it stands in (0: none); ``parent``: of the element around it."""

    inside: int
    strong: bool
    bad: bool
    heading: bool
    item: bool = False
    parent: int = 0
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None


def _attributes(attrs: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): next((x for x in (m[2], m[3], m[4]) if x is not None), "") for m in ATTRIBUTE.finditer(attrs)}


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def _names(a: dict[str, str]) -> tuple[set[str], set[str]]:
    """Words of class and id, and those of them that name a part around the article."""
    words, found = set(), set()
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        pieces = {w.lower() for w in PIECE.split(name.replace("_", "-")) if w} | {name.lower()}
        words |= pieces
        found |= pieces & NAMES
        if pieces - {name.lower()} <= NAMES | DOUBTFUL | LAYOUT:
            found |= pieces & DOUBTFUL
    return words, found


def _context(tag: str, attrs: str, bad: bool, inside: int) -> tuple[bool, int]:
    """Whether an element is boilerplate, and the strength (0 to 2) with which it says that it is the article."""
    a = _attributes(attrs)
    role, hidden, (names, found) = a.get("role", "").lower(), _hidden(a), _names(a)
    if tag in ("article", "main") or role in ("main", "article") or a.get("itemprop") == "articleBody":
        return hidden or bool(names & REMARKS), 2
    if tag in ("html", "body"):
        return False, 0
    if found <= {"header", "byline"} and names & CONTENT:
        found = set()
    if tag in BOILERPLATE or role in ROLES or hidden or found or tag == "header" and not inside:
        return True, 0
    return bad, int(bool(names & CONTENT) and tag in ("div", "section", "td"))


def _muted(tag: str, attrs: str) -> bool:
    """Whether an element inside a line is no part of the text."""
    if tag in ("button", "label"):
        return True
    if not attrs or tag in VOID:
        return False
    a = _attributes(attrs)
    return _hidden(a) or bool(_names(a)[1])


def blocks(page: str) -> list[Block]:
    """Blocks of a page that have text, in page order. Open elements end with the page."""
    out, stack = [], []  # stack: tag, bad, inside, strong, number of the open block-level elements
    articles, opened, links, breaks, now = 0, 0, 0, 0, None
    bad, inside, strong, heading, item, parent, at = False, 0, False, False, False, 0, 0
    mute, depth_of, open_at = "", 0, 0  # an element inside a line whose text is left out: name, depth, open blocks around it

    def text(chunk):
        nonlocal now, breaks
        if not chunk or mute:
            return
        if now is None:
            now = Block(inside, strong, bad, heading, item, parent)
            out.append(now)
        now.parts.append(chunk)
        if links:
            now.linked += len(chunk)
        if not chunk.isspace():
            breaks = 0

    unclosed: set[str] = set()  # names without a further end tag
    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            name = m["raw"].lower()
            if name in OPAQUE and (name in unclosed or m[0].endswith("/>")):
                continue
            if end := ENDS[name].search(page, at):
                at = end.end()
            elif name in RAW:
                at = len(page)
            else:
                unclosed.add(name)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if mute and tag == mute:
            depth_of += -1 if m["end"] else 1
            if depth_of == 0:
                mute = ""
            continue
        if not mute and not m["end"] and tag not in BLOCKS and not m[0].endswith("/>") and _muted(tag, m["attrs"]):
            mute, depth_of, open_at = tag, 1, len(stack)
            continue
        if tag == "a":
            links = 0 if m["end"] else 1
        elif tag == "br":
            breaks += 1
            if breaks > 1:
                now = None
            else:
                text(" ")
                breaks = 1
        elif tag in BLOCKS:
            now, breaks = None, 0
            if tag in VOID:
                continue
            links = 0
            if m["end"]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
                    if len(stack) < open_at:  # the element around the muted one has ended
                        mute = ""
            else:
                while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    stack.pop()
                b, strength = _context(tag, m["attrs"], bool(stack) and stack[-1][1], stack[-1][2] if stack else 0)
                b = b or bool(stack) and stack[-1][1]
                i, s = (stack[-1][2], stack[-1][3]) if stack else (0, False)
                if strength and not b and (strength == 2) >= s:
                    articles += 1
                    i, s = articles, s or strength == 2
                opened += 1
                stack.append((tag, b, i, s, opened))
                if mute and tag in ("p", "article", "main", "section"):  # no line holds these: the muted element was left open
                    mute = ""
            bad, inside, strong, _ = stack[-1][1:] if stack else (False, 0, False, 0)
            heading = any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-2:])
            item = any(x[0] in ("li", "td", "dd") for x in stack[-2:])
            parent = next((x[4] for x in reversed(stack) if x[0] not in LEAVES), 0)
    text(page[at:])
    for b in out:
        b.text = SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
    return [b for b in out if b.text]


def first_pass(b: Block, has_article: bool) -> bool | None:
    """Label of a block by itself: good, bad, or None where its votes are not clear."""
    if b.bad:
        return BAD
    size = len(b.text)
    votes = (1 if b.strong else -1) if has_article else 0
    votes += b.inside > 0 and not b.strong  # an element named as content
    links = b.linked / max(1, sum(map(len, b.parts)))
    votes -= (links > LINKS) + (links > 0.5) + (links > 0.5 and b.item)
    if size >= SHORT and not b.heading:
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOP for w in words) / max(1, len(words))
        votes += 2 if stops >= MANY and size >= LONG else 1 if stops >= FEW else -1
    return GOOD if votes >= 2 else BAD if votes <= -2 else None


def second_pass(found: list[Block], has_article: bool) -> None:
    """Label the ambiguous blocks after their nearest decided neighbours; ties go to the following block for headings, else to good.

    What the element alone made bad is no neighbour. Without one a block is good, but not outside the article of a page that has one.
    """
    n = len(found)
    circles = [lambda b: ("element", b.parent), lambda b: ("article", b.inside), lambda b: "page"]
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        seen: dict = {}
        for i in order:
            b = found[i]
            near[i] = [seen.get(c(b)) for c in circles]
            if b.label is not None and not b.bad:
                seen.update((c(b), i) for c in circles)
    decided = [b.label for b in found]
    for i, b in enumerate(found):
        if b.label is not None:
            continue
        for k, (x, y) in enumerate(zip(before[i], after[i])):
            if x is None and y is None:
                continue
            if k and has_article and not b.strong:
                break  # neighbours in an article say nothing of a block outside
            if x is None or y is None or decided[x] == decided[y]:
                b.label = decided[x if x is not None else y]
            elif b.heading or y - i != i - x:
                b.label = decided[y] if b.heading or y - i < i - x else decided[x]
            else:
                b.label = GOOD
            break
        if b.label is None:
            b.label = b.strong or not has_article


def main_text(page: str | None) -> str:
    """Good blocks of a page, joined by two line feeds; empty for null and for pages without text."""
    found = blocks(page or "")
    has_article = any(b.strong and not b.bad for b in found)
    for b in found:
        b.label = first_pass(b, has_article)
    second_pass(found, has_article)
    return "\n\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with their main ``text`` (replaced if there); all other columns stay, whatever their names.

    One row per row: rows that repeat have equal texts. A null or empty page has an empty text, an empty table stays empty.
    """

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in page], dtype=object)

    return pages.withColumn("text", text(column))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
