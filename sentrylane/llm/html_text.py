"""Main text of web pages by line-block distribution (operator 8)."""

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import table

#: Lines of a window, and the characters that some window of a text's stretch must hold.
WINDOW = 3
SURGE = 86
#: A line outside an article whose characters are links by this share counts as empty
#: (a menu's), unless it is a paragraph or heading.
LINKS = 0.6

#: HTML's own names, fixed: elements whose content is no text, elements that are furniture
#: of the page, elements without content, and elements that begin a new block.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "xmp", "noembed", "noframes"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
MAIN = {"article", "main"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A class or id names furniture if the word it ends with does, before words of place and
#: form: ``sidebar``, ``main-nav``, ``comments-area``, ``ad-left``. ``with-sidebar``,
#: ``page-header`` and ``comments-open`` name layouts, parts and states of the text.
_THING = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|sidebar|cookies?|consent|gdpr|notices?|alerts?|comments?|respond|disqus|replies|reply"
    r"|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|header|share|sharing|social|newsletter|subscribe|signup"
    r"|related|recommend\w*|popup|modal|overlay|pagination|pager|widgets?|toolbar|skiplink"
)
_FORM = {
    "left", "right", "top", "bottom", "upper", "lower", "inner", "outer", "list", "box", "bar", "wrapper", "wrap", "container", "area", "section",
    "block", "panel", "item", "items", "link", "links", "buttons", "form", "unit", "slot", "group", "row", "col", "column",
}
_LAYOUT = {"no", "not", "with", "without", "has", "hide", "hidden", "non"}
_OF_TEXT = {"page", "article", "post", "entry", "content", "main", "story", "section"}


def _names_furniture(name: str) -> bool:
    words = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name.strip()) if w]
    words = [w.lower() for w in words if not w.isdigit()]
    if words[:2] == ["side", "bar"] or words[:2] == ["skip", "link"]:
        words[:2] = ["".join(words[:2])]
    while len(words) > 1 and words[-1] in _FORM:
        words.pop()
    if not words or _LAYOUT & set(words) or not _THING.fullmatch(words[-1]):
        return False
    return not (words[-1] == "header" and len(words) > 1 and words[-2] in _OF_TEXT)


_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_WHITE = re.compile(r"[\s\x00]+")


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE:
        return not (name == "header" and inside)
    if not attributes or name in ("html", "body") or name in MAIN and "comment" not in attributes.lower():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and any(map(_names_furniture, value.split())) or key == "role" and value.lower() in _ROLES or key == "hidden":
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _tags(page: str) -> tuple[list[tuple[int, int, str, bool, str]], list[int]]:
    """Tags and comments as (start, end, name, closing, attributes), and where each element ends.

    The content of raw elements is part of their tag. An element ends at the closing tag
    of its name and nesting, or with the page.
    """
    tags, close, at, open_ = [], [], 0, defaultdict(list)
    while m := _TOKEN.search(page, at):
        name, closing, attributes, at = (m[2] or "").lower(), m[1] == "/", m[3] or "", m.end()
        alone = name in VOID or attributes.rstrip().endswith("/")
        if name in RAW and not closing and not alone:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at, alone = end.end() if end else len(page), True
        i = len(tags)
        tags.append((m.start(), at, name, closing, attributes))
        close.append(i)
        if closing and open_[name]:
            close[open_[name].pop()] = i
        elif name and not closing and not alone:
            open_[name].append(i)
    for left in open_.values():
        for i in left:
            close[i] = len(tags)
    return tags, close


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """Blocks of a page without markup: text, how many characters count, and whether in an article.

    Furniture elements leave nothing. An element that holds an article is no furniture,
    whatever its name. Menu entries count for nothing: lines made of links, unless they
    are paragraphs or headings. A link without an end ends with its block.
    """
    tags, close = _tags(page)
    articles = [i for i, t in enumerate(tags) if t[2] in MAIN and not t[3]]
    lines: list[tuple[str, int, bool]] = []
    now, linked, link, main, prose, at, i = [], 0, False, 0, False, 0, 0

    def end_block():
        nonlocal now, linked, link
        text = _WHITE.sub(" ", "".join(now)).strip()
        if text:
            lines.append((text, 0 if linked >= LINKS * len(text) and not prose else len(text), main > 0))
        now, linked, link = [], 0, False

    def add(raw: str):
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            now.append(text)
            if link:
                linked += len(text.strip())

    while i < len(tags):
        start, end, name, closing, attributes = tags[i]
        add(page[at:start])
        at = end
        here, i = i, i + 1
        if not name:
            continue
        if name in BLOCKS:
            end_block()
            prose = not closing and name in PROSE
        elif name == "br":
            now.append(" ")
        elif name == "a":
            # With a name alone it is a place to link to.
            link = not closing and ("href" in attributes.lower() or not attributes.strip())
        if closing:
            if name in MAIN and main:
                main -= 1
            continue
        if name in RAW or name in VOID:
            continue
        if _is_furniture(name, attributes, main > 0):
            inside = bisect_right(articles, here)
            if inside == len(articles) or articles[inside] >= close[here] or main:
                if close[here] >= len(tags):
                    end_block()
                    return lines
                if close[here] > here:
                    i, at = close[here] + 1, tags[close[here]][1]
                continue
        if name in MAIN:
            main += 1
    rest = page[at:]
    # A page cut off within a tag ends before that tag.
    cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)
    add(rest[: cut.start()] if cut else rest)
    end_block()
    return lines


def region(lengths: np.ndarray) -> tuple[int, int]:
    """The lines from the first surge to the last dive.

    Over windows of ``WINDOW`` lines the lengths are summed. A stretch surges with the
    first line whose window holds something after windows that held nothing, and dives
    where windows are empty again. The text begins with the first stretch and ends with
    the last one of which some window reaches ``SURGE``, or the largest sum of all if that
    is less.
    """
    if not lengths.any():
        return 0, 0
    padded = np.cumsum(np.r_[0, lengths, np.zeros(WINDOW - 1, np.int64)])
    sums = padded[WINDOW:] - padded[:-WINDOW]
    live = np.r_[False, sums > 0, False]
    surge, dive = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(~live[1:] & live[:-1])
    least = min(SURGE, int(sums.max()))
    text = [(a, b) for a, b in zip(surge, dive) if sums[a:b].max() >= least]
    # The windows of a stretch begin before its first line; that line holds something.
    first, last = text[0][0], text[-1][1]
    filled = np.flatnonzero(lengths[first:last])
    return int(first + filled[0]), int(first + filled[-1] + 1)


def main_text(page: str) -> str:
    """The blocks between the first surge and the last dive of the page's line-block distribution.

    Where a page marks articles, their blocks are its text. Elsewhere every block of the
    region stays that is no furniture, however short, and whether it is a link or not.
    """
    lines = page_lines(page)
    if any(inside for _, _, inside in lines):
        return "\n".join(text for text, _, inside in lines if inside)
    start, end = region(np.array([n for _, n, _ in lines], np.int64))
    return "\n".join(text for text, _, _ in lines[start:end])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) for every page.

    A map without shuffle, linear in the length of a page. Null or empty html, and pages
    without text, give an empty text. Null ids and repeated rows are extracted as any
    other; an empty table gives no rows.
    """

    def extracted(batches):
        for b in batches:
            texts = pa.array([main_text(h) if h else "" for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
