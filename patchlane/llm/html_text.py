"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block from its own figures:

* bad: most of its characters are links; or it stands in a container for other things (menu, footer, sidebar, form, advert,
  notice, reader comments ...), whose prose no density tells from the article's;
* good: at least SHORT characters, few links, and a share of stop words of at least STOP_HIGH, or of STOP_LOW in a block
  of LONG characters; being in an article makes no block good;
* undecided: short blocks, and those between the rules; outside an article, long blocks with hardly a stop word are bad.

The second pass gives an undecided block the label of the nearest decided block, first of those in the same article (or
outside all) that stand in no such container, where a tie is good. An article none of whose blocks is decided (one in a
language without stop words here) is kept; without any decided block an undecided one is bad, unless the page has no
article and the block holds stop words.

Reading a page takes time in proportion to its length, whatever its markup: the open elements are counted by name, and no
tag is looked for behind the last closing bracket.

Character references are decoded, white space in a block becomes one space, good blocks are joined in page order by one
space. Nothing else is dropped or capped.

Defined cases: a null or empty page has an empty text; broken markup (unclosed tags, comments or quotes) is read as far as
it goes; equal pages give equal texts; an empty table gives no rows; further columns pass where the caller names them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import compute_columns

SHORT, LONG = 40, 200
STOP_LOW, STOP_HIGH, MAX_LINKS = 0.1, 0.2, 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>",
    re.S,
)
#: What needs no closing bracket: a comment or a section that the page's end cuts off.
OPEN_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's element names by what they do.
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BREAK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
OTHER = set("nav footer aside form head button select option template svg canvas object audio video map menu dialog label datalist".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id names of containers that hold no main text.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus "
    "share sharing social related recommended recommendations pagination pager search widget toolbar copyright disclaimer skip".split()
)
#: Frequent function words of English, German, French and Spanish.
STOP = set(
    "the of and to in is that for it was on are as with be at this have from or by not but what all were when we there can an your which their if will each about how up out "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec elle ils mais ou son leur "
    "el y los del las una con no su para al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    links: int  # characters in links, as read
    size: int  # characters, as read
    article: int  # number of the article it stands in, or 0
    other: bool  # in a container for other things


def is_other(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds something else than main text."""
    if tag in OTHER or (tag == "header" and not in_article):
        return True
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id") and tag not in ("body", "html", "main") and any(w.lower() in NAMES for w in NAME_PART.findall(value)):
            return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold any text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, other, article
    opened: dict[str, int] = {}  # and how many of them have a name
    other = articles = link = 0
    inside: list[int] = []
    parts: list[str] = []
    linked = size = 0

    def text(piece: str) -> None:
        nonlocal linked, size
        piece = html.unescape(piece)
        parts.append(piece)
        size += len(piece)
        if link:
            linked += len(piece)

    def flush() -> None:
        nonlocal parts, linked, size
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                out.append(Block(joined, linked, size, inside[-1] if inside else 0, other > 0))
            parts, linked, size = [], 0, 0

    def pop() -> None:
        nonlocal other, link
        tag, was_other, was_article = stack.pop()
        opened[tag] -= 1
        other -= was_other
        link -= tag == "a"
        if was_article:
            inside.pop()

    at, last = 0, page.rfind(">")
    while at <= last or page.find("<!", at) >= 0:
        m = TOKEN.search(page, at) if at <= last else OPEN_COMMENT.search(page, at)
        if m is None:
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m.groupdict().get("tag") or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in BREAK:
                flush()
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = page.find(">", close.start()) + 1 or len(page) if close else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BREAK:
            flush()
        if tag == "p" or tag in VOID or m["rest"].endswith("/") and tag not in BREAK and tag != "a":
            continue
        if tag in BREAK or tag in OTHER or tag == "a" or m["rest"].strip():
            if tag in ("li", "a") and any(t == tag for t, _, _ in stack[-1:]):
                pop()
            is_article = tag in ("article", "main")
            bad = is_other(tag, m["rest"], bool(inside))
            stack.append((tag, bad, is_article))
            opened[tag] = opened.get(tag, 0) + 1
            other += bad
            link += tag == "a"
            if is_article:
                if not inside:
                    articles += 1
                inside.append(articles)
    if at < len(page):
        text(page[at:])
    flush()
    return out


def decide(b: Block) -> bool | None:
    """First pass: good, bad or undecided."""
    if b.other:
        return False
    if b.links > MAX_LINKS * b.size:
        return False
    if len(b.text) < SHORT:
        return None
    words = WORD.findall(b.text.lower())
    share = sum(w in STOP for w in words) / max(len(words), 1)
    if share >= STOP_HIGH or (share >= STOP_LOW and len(b.text) >= LONG):
        return True
    return None if b.article or share >= STOP_LOW else False


def labels(found: list[Block]) -> list[bool]:
    """Both passes."""
    first = [decide(b) for b in found]
    out = list(first)

    # Nearest decided blocks by two sweeps, so that a page of many blocks takes linear time.
    def sweep(same: bool) -> list[bool | None]:
        best: list[tuple[int, bool] | None] = [None] * len(found)
        for order in (range(len(found)), range(len(found) - 1, -1, -1)):
            last: dict[int, tuple[int, bool]] = {}
            for i in order:
                key = found[i].article if same else 0
                if first[i] is not None and not (same and found[i].other):
                    last[key] = (i, first[i])
                elif first[i] is None and key in last:
                    d, label = abs(i - last[key][0]), last[key][1]
                    if best[i] is None or d < best[i][0] or d == best[i][0] and label:
                        best[i] = (d, label)
        return [None if b is None else b[1] for b in best]

    near_own, near_any = sweep(True), sweep(False)
    has_article = any(b.article for b in found)
    for i, b in enumerate(found):
        if first[i] is None:
            own = near_own[i]
            if own is None and b.article:
                own = True  # no block of this article is decided
            if own is None:
                own = near_any[i]
            if own is None:
                own = not has_article and any(w in STOP for w in WORD.findall(b.text.lower()))
            out[i] = own
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (page_id, url), the main text and its number of code points."""

    def texts(column: pa.Array) -> list:
        made = [main_text(p) for p in column.to_pylist()]
        return [pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]

    fields = [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)]
    return compute_columns(pages, html_col, ["page_id", "url"] if carry is None else carry, fields, texts)
