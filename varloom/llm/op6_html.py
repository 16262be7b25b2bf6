"""Main text of web pages by the distribution of text over line blocks.

A page is turned into lines, one for each block element with text. Scripts and styles, and parts that by element, role or class are menus, headers,
footers, sidebars, notices, adverts, forms or reader comments, leave lines without text; lines that are mostly links count as
such. Text lengths are summed over sliding windows of lines. Text surges where a window reaches the threshold and
dives where the windows have run empty; the lines between are kept. A page that marks its article or main part has no text
elsewhere, and any text in it counts as a surge. If no window of a page reaches the threshold, the fullest one does.
A form or an element with such a role or name is a wrapper, and read like any other, if it holds most of the article's or, without
one, the page's text; reader comments must hold the first article, or nearly all text of a page without one.

Null or empty pages, and pages without text, give an empty text. Repeated rows are read each for itself. Other columns are
ignored. An element that is never closed hides nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.store import cached

WIDTH = 3  # lines of a window
SURGE = 80  # characters in a window

HIDDEN = set("nav header footer aside form menu dialog select button textarea noscript iframe svg object canvas template head title option datalist video audio map figure-ad".split())
BREAKS = set("p div br hr h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th tbody thead tfoot caption blockquote pre section article main body html figure figcaption details summary address fieldset legend center".split()) | HIDDEN
WHOLE = {"html", "body", "main", "article"}
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NAMES = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices newsletter subscribe signup login share sharing social related recommended comment comments disqus respond breadcrumb breadcrumbs pagination pager popup modal widget toolbar search".split()
)
#: These end an article; what else is left out may stand within it and leaves one line only.
FRAME = {"nav", "header", "footer"}
COMMENTS = re.compile(r"comment|disqus|respond|footer", re.I)
#: Builders wrap each paragraph in a widget; beside other words the name says nothing.
WEAK = {"widget"}
STATES = re.compile(r"\b(?:has|with|no|without)[-_][a-z0-9_-]+")


def patterns() -> tuple[re.Pattern, re.Pattern]:
    token = r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[/!?]?[a-zA-Z](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>|<[/!?]?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*>"
    return re.compile(token, re.S | re.I), re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def boilerplate(tag: str, name: str, within: bool, attribute: re.Pattern) -> str:
    """"" for a part of an article, "named" for what may also wrap one, "never" for the rest; ``within`` an article, headers may be its title."""
    if name in WHOLE:
        return ""
    if name in HIDDEN and not (name == "header" and within) and name != "form":
        return "never"
    out = "named" if name == "form" else ""
    space = tag.find(" ")
    if space < 0:
        return out
    for key, a, b, c in attribute.findall(tag[space:-1]):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "never"
        if key == "role" and value in ROLES:
            out = "named"
        if key in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", STATES.sub(" ", value)))
            if within:
                words.discard("header")
            if words & (NAMES - WEAK) or value.strip() in WEAK:
                out = "named"
    return out


def lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters of it in links, inside an article) of each line, and whether the page marks an article."""
    token, attribute = cached("html-patterns", patterns)
    parts: list[tuple[str, str, str]] = []  # (kind, name, text)
    at = 0
    for m in token.finditer(page):
        if m.start() > at:
            parts.append(("text", "", page[at : m.start()]))
        at = m.end()
        t = m[0]
        if t[1] == "!" or t[1] == "?" or m[1]:
            parts.append(("gap", "", "") if m[1] else ("skip", "", ""))
            continue
        close = t[1] == "/"
        name = re.match(r"</?([a-zA-Z0-9-]+)", t)[1].lower()
        parts.append(("close" if close else "open", name, t))
    if at < len(page):
        parts.append(("text", "", page[at:]))
    # the end of each element, by name
    waiting: dict[str, list[int]] = {}
    end: dict[int, int] = {}
    for i, (kind, name, _) in enumerate(parts):
        if kind == "open":
            waiting.setdefault(name, []).append(i)
        elif kind == "close" and waiting.get(name):
            end[waiting[name].pop()] = i
    # characters of text before each part, on the page and in articles, and the first article
    first = next((i for want in ("article", "main") for i, (kind, name, _) in enumerate(parts) if kind == "open" and name == want and i in end), -1)
    before, depth = [(0, 0)], 0
    for i, (kind, name, t) in enumerate(parts):
        n = len(" ".join(t.split())) if kind == "text" else 0
        before.append((before[-1][0] + n, before[-1][1] + n * (depth > 0)))
        if name in ("article", "main"):
            depth = depth + (i in end) if kind == "open" else max(0, depth - (kind == "close"))

    def wraps(i: int) -> bool:
        """Whether the element holds what the page is about."""
        k = 1 if first >= 0 else 0
        held, whole = before[end[i]][k] - before[i][k], before[-1][k]
        if not COMMENTS.search(parts[i][2]):
            return 2 * held > whole
        return i < first < end[i] and 2 * held > whole if first >= 0 else 10 * held > 9 * whole

    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked, until, inside, links, marked = 0, -1, 0, 0, False

    def flush() -> None:
        nonlocal linked
        flat = " ".join(entities.unescape("".join(text)).split())
        if flat:
            out.append((flat, min(linked, len(flat)), inside > 0))
        text.clear()
        linked = 0

    for i, (kind, name, t) in enumerate(parts):
        if i <= until:
            continue
        if kind == "text":
            text.append(t)
            if links:
                linked += len(" ".join(t.split()))
        elif kind == "gap":
            flush()
            out.append(("", 0, inside > 0))
        elif kind == "open":
            why = boilerplate(t, name, inside > 0, attribute)
            if why and i in end and (why == "never" or not wraps(i)):
                flush()
                out.extend([("", 0, inside > 0)] * (WIDTH if name in FRAME or COMMENTS.search(t) else 1))
                until = end[i]
                continue
            if name in BREAKS:
                flush()
            if name in ("article", "main") and i in end:
                inside, marked = inside + 1, True
            if name == "a" and i in end:
                links += 1
        elif kind == "close":
            if name in BREAKS:
                flush()
            if name in ("article", "main"):
                inside = max(0, inside - 1)
            if name == "a":
                links = max(0, links - 1)
    flush()
    return out, marked


def main_text(page: str | None) -> str:
    """The text between surges and dives, blocks joined by line feeds."""
    if not page:
        return ""
    found, marked = lines(page)
    size = [0 if (marked and not within) or 2 * linked > len(text) and not (marked and within) else len(text) for text, linked, within in found]
    total = [sum(size[i : i + WIDTH]) for i in range(len(size))]
    if not any(size):
        return ""
    threshold = 1 if marked else min(SURGE, max(total))
    keep, i = [], 0
    while i < len(size):
        if total[i] >= threshold and size[i]:  # surge
            j = i
            while j < len(size) and total[j]:  # dive: a whole window without text
                j += 1
            keep.extend(range(i, j))
            i = j
        i += 1
    return "\n".join(found[i][0] for i in keep if size[i])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


@query("op6_html")
def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
