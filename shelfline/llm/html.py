"""Main text of web pages as the contiguous region of highest score.

A page is a sequence of words and tags. Words score by where they stand (text, link, heading, list, table, or
inside an element that by its name, class or role is a menu, footer, notice and the like), tags by their name.
Some class names are used for such parts and for layout; they count only on pages where what they mark holds
the lesser part of the running text.
The weights are log-odds of standing inside the article, from labelled pages; words of running text are held
positive and tags negative. One scan finds the contiguous run of highest sum. It is widened to whole blocks, and
elements inside it that are no part of an article are left out.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.encoding import filled
from shelfline.llm.frames import add_columns
from shelfline.llm.labelled_pages import PAGES

#: The rest of a tag: a value after an equals sign may be quoted; quotes elsewhere are plain characters.
VALUES = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+"""
TOKEN = re.compile(
    r"<!--(?P<note>.*?)(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)"
    rf"(?=[\s/>]){VALUES}>(?:.*?</(?P=raw)\s*+>|.*\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>{VALUES})>"
    r"|<[!?/a-z][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"\S+")

#: Element names by how they lay out text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no part of an article, by name, role, or a word of their class or id.
OUTSIDE = frozenset(
    "aside audio button canvas dialog fieldset footer form iframe input label menu nav noscript object optgroup option select "
    "svg template video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adverts breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "pager paginate pagination paywall popup respond sidebar signup skip sponsor sponsored subscribe subscription toolbar".split()
)
#: Marks that name layout on some pages; they count where what they mark holds the lesser part of the running text.
SOFT = frozenset(
    "alert banner dialog header login notice notification overlay promo promotion recommended recommendations related replies reply "
    "share sharing social teaser teasers widget widgets".split()
)
#: Marks that also count as the start or end of a longer word, as in `commentlist`.
STEMS = ("advert", "breadcrumb", "comment", "cookie", "footer", "navbar", "newsletter", "pagination", "sidebar")
#: Elements that hold an article or a whole page, whatever their class says.
HOLDERS = frozenset("article body html main".split())
WORDS = frozenset(["text", "link", "heading", "list", "table", "outside"])


def _marks(name: str, attrs: str, in_article: bool) -> tuple[bool, frozenset[str]]:
    """Whether an element is no part of an article, and the soft marks that say so if the page heeds them."""
    none: frozenset[str] = frozenset()
    if name in HOLDERS:
        return False, none
    if name in OUTSIDE or (name == "header" and not in_article):
        return True, none
    soft = none
    for key, value in ATTRIBUTE.findall(attrs):
        key, entries = key.lower(), value.strip("\"'").split()
        value = " ".join(entries).lower()
        if key == "role" and value in ROLES or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, none
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, none
        if key in ("class", "id"):
            for entry in entries:
                parts = [p.lower() for p in re.split(r"[-_:]+|(?<=[a-z])(?=[0-9A-Z])", entry) if p]
                if parts and parts[0] not in ("has", "no", "with", "without"):
                    if MARKS.intersection(parts) or any(p.startswith(STEMS) or p.endswith(STEMS) for p in parts):
                        return True, none
                    soft |= SOFT.intersection(parts) - ({"header"} if in_article else none)
    return False, soft


#: Where one of the first kind begins, an open one ends, unless one of the second kind was opened in between.
ENDED = frozenset(["a", "p", "li", "td", "th", "tr", "dd", "dt"]) | HEADINGS
BARRIERS = frozenset("ul ol dl table div section article blockquote".split())


def tokens(page: str) -> list[tuple[str, str, int, bool]]:
    """`kind, value, block, outside` of each word or tag; kind is `word`, `tag` or `note`, block numbers layout blocks."""
    found = list(_tokens(page, frozenset()))
    under: Counter[str] = Counter()
    plain = 0
    for kind, value, _, outside, soft in found:
        if kind == "text" and not outside:
            n = len(WORD.findall(value))
            plain += 0 if soft else n
            for mark in soft:
                under[mark] += n
    layout = frozenset(mark for mark, n in under.items() if n > plain)
    if layout:
        found = list(_tokens(page, layout))
    return [
        ("outside" if soft and kind not in ("tag", "note") else kind, value, block, outside or bool(soft))
        for kind, value, block, outside, soft in found
    ]


def _tokens(page: str, layout: frozenset[str]) -> Iterable[tuple[str, str, int, bool, frozenset[str]]]:
    """The tokens of a page, with the soft marks they stand under but for those of `layout`."""
    # Open elements: name, whether it or one around it is outside the article, and soft marks. For each name, where it stands.
    stack: list[tuple[str, bool, frozenset[str]]] = []
    places: dict[str, list[int]] = {}
    none: frozenset[str] = frozenset()
    block = 0

    def close(top: int) -> None:
        while len(stack) > top:
            places[stack.pop()[0]].pop()

    for m in TOKEN.finditer(page):
        text = m["text"]
        outside, soft = (stack[-1][1], stack[-1][2]) if stack else (False, none)
        if text is not None:
            where = (
                "outside" if outside else "link" if places.get("a") else "heading" if any(places.get(h) for h in HEADINGS)
                else "list" if places.get("li") else "table" if places.get("td") or places.get("th") else "text"
            )
            # Words keep the references in them; a word is decoded as part of its block.
            yield where, text, block, outside, soft
            continue
        if m["note"] is not None:
            yield "note", m["note"].strip(), block, outside, soft
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            block += 1
        if name in VOID or m["end"]:
            yield "tag", ("/" if m["end"] else "") + name, block, outside, soft
        if name in VOID:
            continue
        if m["end"]:
            if places.get(name):
                close(places[name][-1])
        else:
            if name in ENDED and places.get(name):
                # It ends where the next begins; what was left open in it ends, too.
                top = places[name][-1]
                if not any(places.get(b) and places[b][-1] > top for b in BARRIERS):
                    close(top)
                    outside, soft = (stack[-1][1], stack[-1][2]) if stack else (False, none)
            gone, marks = _marks(name, m["attrs"] or "", bool(places.get("article") or places.get("main")))
            gone, soft = outside or gone, soft | (marks - layout)
            yield "tag", name, block, gone, soft
            places.setdefault(name, []).append(len(stack))
            stack.append((name, gone, soft))


def weights_of(pages: list[str]) -> dict[str, float]:
    """Log-odds of each kind of word and tag to stand inside the article, from pages labelled with notes."""
    inside, total = Counter(), Counter()
    for page in pages:
        main = False
        for kind, value, _, _ in tokens(page):
            if kind == "note":
                main = value == "main" if value in ("main", "/main") else main
                continue
            name, n = (f"<{value.lstrip('/')}>", 1) if kind == "tag" else (kind, len(WORD.findall(value)))
            total[name] += n
            inside[name] += n * main
    out = {}
    for name, n in total.items():
        odds = math.log((inside[name] + 0.5) / (n - inside[name] + 0.5))
        if name in ("text", "heading", "list"):
            out[name] = min(2.0, max(0.5, odds))
        elif name.startswith("<"):
            # A tag alone never speaks for an article: what stands in it does.
            out[name] = max(-1.0, min(-0.05, odds - 1.0))
        else:
            out[name] = max(-1.0, min(1.0, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and end of the first contiguous run of highest sum; empty if no score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: dict[str, float]) -> str:
    """The article of a page: blocks joined by an empty line."""
    parts = [t for t in tokens(page) if t[0] != "note"]
    scores = []
    for kind, value, _, outside in parts:
        if kind == "tag":
            scores.append(-0.05 if outside else weights.get(f"<{value.lstrip('/')}>", -0.2))
        else:
            n = len(WORD.findall(value))
            # What is left out anyway costs little, so an advert does not part an article.
            scores.append(max(-1.0, -0.1 * n) if outside else n * weights.get(kind, 0.5))
    first, end = best_run(scores)
    if first == end:
        return ""
    low, high = parts[first][2], parts[end - 1][2]
    blocks: dict[int, list[str]] = {}
    for kind, value, block, outside in parts:
        if low <= block <= high and not outside:
            if kind != "tag":
                blocks.setdefault(block, []).append(value)
            elif value == "br" and block in blocks:
                blocks[block].append(" ")
    decoded = (" ".join(references.unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(b for b in decoded if b)


def with_main_text(pages: DataFrame, html: str = "html", labelled: list[str] = PAGES) -> DataFrame:
    """`pages` with `__main`, the article of each page, extracted where the page is read. Null pages have none."""
    at, weights = pages.columns.index(html), weights_of(labelled)

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(p.as_py(), weights) for p in filled(batch.column(at))], pa.string())]

    return add_columns(pages, kernel, "__main string")


def article_report(
    pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", labelled: list[str] = PAGES
) -> DataFrame:
    """`page_id, url, text, n_chars` of every row; `text` is empty where a page is null, empty or without article.

    Repeated rows and ids are extracted one by one; unclosed elements, comments and tags end with the page; other
    columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    made = with_main_text(rows, labelled=labelled)
    return made.select("page_id", "url", F.col("__main").alias("text"), F.char_length("__main").cast("bigint").alias("n_chars"))
