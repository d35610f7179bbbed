"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level elements. Blocks in navigation, headers, footers,
sidebars, forms, scripts, adverts, notices and comments (by element, role, class or id) are set
aside. The first pass classifies the others:

- link density above MOST_LINKS: bad;
- LONG characters or more with a stop-word density of at least STOP_DENSITY: good;
- LONG characters or more without: good within an article element, else bad;
- shorter ones: ambiguous.

In the second pass each ambiguous block takes the label of its nearest decided neighbours in the same
region (the article or main element if there is one, else the body): if both agree, theirs; if they
differ, or there is none, good within an article, else the nearer one's, or bad. Without an article,
headings look ahead only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

MOST_LINKS, LONG, STOP_DENSITY = 0.5, 70, 0.12
SCHEMA = "page_id long, url string, text string, n_chars long"

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be at by this from or an have not which you we they
    de la le les et des en un une du que qui dans pour par sur au aux avec est pas ou ce il elle se ne
    der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    el los las y del se con una su para lo como más o pero sus al""".split()
)
#: HTML's void, raw-text and inline elements, and elements that never hold an article's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noframes".split())
#: Elements whose text ends only at their end tag, even if that is the end of the page. The others of RAW hold markup: without an end tag
#: they are passed over as if they weren't there.
TEXT_ONLY = frozenset("script style textarea title xmp".split())
#: The elements that a head may hold; any other ends it, as its end tag is optional.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside form button select option menu dialog fieldset".split()) | RAW
REGION = frozenset(["article", "main"])
#: Names that class and id have as their first or last part, and ARIA roles, of what isn't the article.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup login register sidebar sidenav menu nav navbar navigation navigate breadcrumb breadcrumbs
    footer masthead share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply
    toolbar pagination pager widget search searchbox skip toc tags""".split()
)
#: Parts that say what a page or post has or is about; names with them say nothing of the element itself.
ABOUT = frozenset("has with without no not is category tag topic type format layout template theme js supports enabled".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\w+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    linked: int
    region: bool
    heading: bool
    good: bool | None = None


def is_aside(name: str) -> bool:
    """Whether one class or id names something other than the article: cookie-notice, siteFooter; not has-sidebar, category-social."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or len(parts) > 1 and not ABOUT.isdisjoint(parts):
        return False
    return parts[0] in NAMES or parts[-1] in NAMES


def set_aside(name: str, attributes: str, in_region: bool) -> bool:
    """Whether an element holds something other than the article."""
    if name in ASIDE or name == "head" or name == "header" and not in_region:
        return True
    if not attributes or name in ("html", "body") or name in REGION and "comment" not in attributes.lower():
        return False
    for key, *values in _MARKS.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            if any(map(is_aside, value.split())):
                return True
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """Non-empty blocks in page order, without those set aside."""
    found: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # name, set aside, in a region; both also for all that is inside
    parts: list[str] = []
    state = {"linked": 0, "link": 0, "breaks": 0, "heading": False}

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, state["linked"], bool(open_ and open_[-1][2]), state["heading"]))
        parts.clear()
        state.update(linked=0, breaks=0)

    def add(text: str) -> None:
        if open_ and open_[-1][0] == "head" and text and not text.isspace():
            open_.pop()
        if text and not (open_ and open_[-1][1]):
            text = unescape(text)
            parts.append(text)
            state["linked"] += state["link"] and len(text.strip())
            if not text.isspace():
                state["breaks"] = 0

    at = 0
    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if not end and open_ and open_[-1][0] == "head" and name not in IN_HEAD:
            open_.pop()
        if name == "br":
            parts.append(" ")
            state["breaks"] += 1
            if state["breaks"] > 1:
                close()
            continue
        if name in RAW and not end:
            if not attributes.endswith("/"):
                close_tag = _RAW_END[name].search(html, at)
                close()
                if close_tag or name in TEXT_ONLY:
                    at = close_tag.end() if close_tag else len(html)
            continue
        if name in INLINE:
            if name == "a":
                state["link"] = not end
            if name in VOID or not end and not attributes:
                continue
            if not end:
                aside, region = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
                if set_aside(name, attributes, region):
                    open_.append((name, True, region))
            elif open_ and open_[-1][0] == name:
                open_.pop()
            continue
        close()
        if not end and name not in VOID:
            if name == "p" or name in ("li", "dt", "dd", "tr", "td", "th"):
                if open_ and open_[-1][0] == name:
                    open_.pop()
            elif open_ and open_[-1][0] == "p":
                open_.pop()
            aside, region = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
            aside = aside or set_aside(name, attributes, region)
            open_.append((name, aside, region or (name in REGION and not aside)))
            state["heading"] = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif end:
            state["heading"] = False
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
                if open_[k][0] in REGION and name not in ("body", "html"):
                    break
        state["link"] = 0 if name != "a" else state["link"]
    add(html[at:])
    close()
    return found


def judge(found: list[Block]) -> list[Block]:
    """The good ones."""
    if any(b.region for b in found):
        found = [b for b in found if b.region]
    for b in found:
        if b.linked > MOST_LINKS * len(b.text):
            b.good = False
        elif len(b.text) >= LONG:
            words = [w.lower() for w in _WORD.findall(b.text)]
            b.good = b.region or sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)
    decided = [k for k, b in enumerate(found) if b.good is not None]
    labels = []
    at = 0
    for k, b in enumerate(found):
        while at < len(decided) and decided[at] < k:
            at += 1
        if b.good is not None:
            labels.append(b.good)
            continue
        before = found[decided[at - 1]].good if at else None
        after = found[decided[at]].good if at < len(decided) else None
        if b.region:
            labels.append(before or after or before is None or after is None)
        elif b.heading:
            labels.append(bool(after))
        elif before == after or before is None or after is None:
            labels.append(bool(before if before is not None else after))
        else:
            labels.append(bool(before if k - decided[at - 1] <= decided[at] - k else after))
    return [b for b, good in zip(found, labels) if good]


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in judge(blocks(html or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null or empty html: empty text. Null ids and urls pass through; repeated rows are rows of their own; an
    empty table gives no rows. Other columns are ignored.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
