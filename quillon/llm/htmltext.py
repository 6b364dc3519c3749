"""Main text of web pages by line-block distribution.

Comments, scripts, styles and the like are cut with what they hold; tags that begin or end a block
become line ends, those of sections (div, article, main, ...) a gap as long as a window, the rest of the
markup goes, and character references are decoded. The lines of what is left have lengths, counted
without white space. A block is WINDOW consecutive lines and has the sum of their lengths. Text surges where a block exceeds SURGE characters and the next three
blocks aren't all empty; it dives at the first empty block after that. The lines between surge and
dive are kept; there may be several such stretches. The lines of a link list or of a footer are short
and stand alone, so that their blocks stay below the surge.

The work is one pass over each page in the workers, linear in its length, and needs no shuffle: pages
are rows. Lengths and block sums are arrays, regular expressions strip the markup.

Defined results: a null page has null text and no lines; a page without a surge has an empty text;
broken markup is taken as far as it can be read (an unclosed comment, script or style runs to the end of
the page, an unclosed head to the body or the first block, and of other unclosed tags the tag alone goes); null ids and repeated rows are treated as any other row; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import as_array

WINDOW = 3
SURGE = 86

_SILENT_TAGS = ("script", "style", "noscript", "template", "svg", "head", "nav", "footer", "aside", "textarea", "select", "iframe")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_SILENT = re.compile("|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\Z)" for t in _SILENT_TAGS), re.S | re.I)
_RAW = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_OTHERS = "|".join(t for t in _SILENT_TAGS if t not in ("script", "style", "head"))
_OPENER = re.compile(rf"<({_OTHERS})\b[^>]*>", re.I)
_CLOSER = re.compile(rf"</({_OTHERS})\s*>", re.I)
_HEAD = re.compile(r"<head\b[^>]*>", re.I)
_HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
_SECTION = re.compile(r"</?(?:article|body|div|fieldset|form|header|html|main|section|table)\b[^>]*>", re.I)
_BLOCK = re.compile(r"</?(?:address|blockquote|br|button|caption|center|dd|details|dialog|dl|dt|figcaption|figure|h[1-6]|hr|legend|li|menu|ol|option|p|pre|summary|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_GAP = re.compile(r"[ \t\r\f\v ]+")


def _silenced(page: str, gap: str) -> str:
    """The page without the elements that are cut with what they hold.

    Where the closing tag is absent, a script or style runs to the end of the page, a head to the body or the first
    tag of a block, and of the others the tag alone goes.
    """
    page = _RAW.sub(gap, page)
    closers: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSER.finditer(page):
        closers.setdefault(m.group(1).lower(), []).append(m.span())
    out, at = [], 0
    for m in _OPENER.finditer(page):
        if m.start() >= at:
            ends = closers.get(m.group(1).lower(), [])
            k = bisect_left(ends, m.span()[::-1])
            out += [page[at : m.start()], gap]
            at = ends[k][1] if k < len(ends) else m.end()
    page = "".join([*out, page[at:]])
    out, at = [], 0
    while m := _HEAD.search(page, at):
        end = _HEAD_END.search(page, m.end()) or min((x for x in (_SECTION.search(page, m.end()), _BLOCK.search(page, m.end())) if x), key=lambda x: x.start(), default=m)
        out += [page[at : m.start()], gap]
        at = end.end() if end is m or end.re is _HEAD_END else end.start()
    return "".join([*out, page[at:]])


def lines_of(page: str, window: int = WINDOW) -> list[str]:
    """The lines of the page without markup, trimmed."""
    gap = "\n" * (window + 1)
    page = _SECTION.sub(gap, _silenced(_COMMENT.sub("", page), gap))
    page = _TAG.sub("", _BLOCK.sub("\n", page))
    return [_GAP.sub(" ", x).strip() for x in html.unescape(page).split("\n")]


def stretches(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first line, line after the last) of each stretch between a surge and the next dive."""
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(lengths)])
    blocks = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    padded = np.append(blocks, np.zeros(3, blocks.dtype))
    alive = (padded[1 : n + 1] + padded[2 : n + 2] + padded[3 : n + 3]) > 0
    if n == 1:
        alive[:] = True
    starts, ends = np.flatnonzero((blocks > surge) & alive), np.flatnonzero(blocks == 0)
    out, at = [], 0
    while (k := np.searchsorted(starts, at)) < len(starts):
        begin = int(starts[k])
        j = np.searchsorted(ends, begin)
        end = int(ends[j]) if j < len(ends) else n
        out.append((begin, end))
        at = end + 1
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> tuple[str | None, int | None, int | None]:
    """The main text, the number of lines kept and that of all lines."""
    if page is None:
        return None, None, None
    lines = lines_of(page, window)
    lengths = np.array([len(x) - x.count(" ") for x in lines], np.int64)
    kept = [x for i, j in stretches(lengths, window, surge) for x in lines[i:j] if x]
    return "\n".join(kept), len(kept), len(lines)


def extracted(pages: DataFrame, key: str = "page_id", column: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """(page_id, text, lines_kept, lines) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x.as_py(), window, surge) for x in as_array(batch.column(1))]
            columns = [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[k] for m in made], pa.int32()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "text", "lines_kept", "lines"])

    return pages.select(pages[f"`{key}`"].cast("long").alias("page_id"), pages[f"`{column}`"].cast("string").alias("html")).mapInArrow(run, "page_id long, text string, lines_kept int, lines int")


#: The same in DuckDB for pages whose tags are closed, with the character references that the tables hold.
SQL = """
WITH a AS (SELECT row_number() OVER () AS r, page_id, html, regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g') AS x FROM pages),
b AS (SELECT r, page_id, regexp_replace(x, '(?is)%SILENT%', repeat(chr(10), 4), 'g') AS x FROM a),
c AS (SELECT r, page_id, regexp_replace(regexp_replace(x, '(?i)%SECTION%', repeat(chr(10), 4), 'g'), '(?i)%BLOCK%', chr(10), 'g') AS x FROM b),
d AS (SELECT r, page_id, regexp_replace(x, '<[a-zA-Z/!?][^>]*>', '', 'g') AS x FROM c),
e AS (SELECT r, page_id, replace(replace(regexp_replace(regexp_replace(x, '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'), '&quot;', '"'), '&lt;', '<') AS x FROM d),
f AS (SELECT r, page_id, string_split(regexp_replace(replace(x, '&gt;', '>'), '&amp;?', '&', 'g'), chr(10)) AS x FROM e),
g AS (SELECT r, page_id, trim(regexp_replace(unnest(x), '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ') AS line, generate_subscripts(x, 1) AS i, len(x) AS n FROM f),
h AS (SELECT *, sum(length(line) - length(line) + length(replace(line, ' ', ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS block FROM g),
k AS (SELECT *, coalesce(sum(block) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) > 0 OR n = 1 AS alive, count(*) FILTER (block = 0) OVER (PARTITION BY r ORDER BY i) AS island FROM h),
l AS (SELECT *, min(CASE WHEN block > 86 AND alive THEN i END) OVER (PARTITION BY r, island) AS surge FROM k)
SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i >= surge AND block > 0 AND line <> ''), '') AS text,
  (count(*) FILTER (i >= surge AND block > 0 AND line <> ''))::INT AS lines_kept, max(n)::INT AS lines
FROM l GROUP BY r, page_id UNION ALL SELECT page_id, NULL, NULL, NULL FROM pages WHERE html IS NULL
"""
for _name, _pattern in (("SILENT", _SILENT), ("SECTION", _SECTION), ("BLOCK", _BLOCK)):
    SQL = SQL.replace(f"%{_name}%", _pattern.pattern.replace(r"\Z", r"\z"))
