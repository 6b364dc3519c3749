"""Secret scan that links the parts of a credential.

Three kinds of part are found in whole texts: access identifiers (key ids, user and client names,
mail addresses), secrets (values assigned to secret-like names, and keys of known form) and
endpoints (URLs, host names with a port, IPv4 addresses). Keys of a known form, such as private key
headers or tokens with a vendor prefix, are strong: they are reported by themselves. A secret-like
assignment is weak, as most of them are placeholders and examples; it is reported only where a
complementary part, an identifier or an endpoint, lies nearby.

Parts are linked within scopes by an interval join. A scope is a block of text between blank lines.
Each secret has the interval from REACH characters before its start to REACH after its end, and is
linked to every identifier and endpoint of its scope whose own interval meets it. Parts of a scope are sorted by
position and joined in one sweep, so that a text of any length costs its length and its links.
All parts of a link lie in one document, so the join needs no shuffle.

Defined results: null and empty texts give no rows; a null id is reported as null; repeated rows are each
reported; of parts that begin at the same place the strong one counts, then the weak, then the identifier, and parts
don't overlap; a secret is one row with all its links, in order of position; values are reported as
their length and their first four characters, so that a report isn't itself a leak. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import as_array

REACH = 200

STRONG = r"(?:A3T[A-Z0-9]|AKIA|ASIA)[A-Z0-9]{16}:[A-Za-z0-9/+]{40}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,80}|sk_live_[A-Za-z0-9]{24,64}|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
WEAK = r"(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo]?[Rr]?[Dd]|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss][_-]?[Kk][Ee][Yy])[A-Za-z_]{0,20}[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?[A-Za-z0-9/+_=.-]{8,128}"
IDENTIFIER = r"(?:AKIA|ASIA)[A-Z0-9]{16}|[A-Za-z0-9._%+-]{0,63}[A-Za-z0-9_%+-]@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}|(?:[Uu]ser(?:name)?|[Ll]ogin|[Cc]lient_?[Ii]d|[Aa]ccount_?[Ii]d)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?[A-Za-z0-9._@-]{3,64}"
ENDPOINT = r"https?://[A-Za-z0-9.-]{1,253}(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]{0,128})?|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,6}:[0-9]{2,5}"

_PARTS = re.compile(f"(?P<strong>{STRONG})|(?P<weak>{WEAK})|(?P<identifier>{IDENTIFIER})|(?P<endpoint>{ENDPOINT})")
#: Only where a text holds one of these can it hold a secret.
_HINT = re.compile(r"token|secret|passw?o?r?d|api[_-]?key|access[_-]?key|gh[pousr]_|xox[abprs]-|sk_live_|AIza|AKIA|ASIA|A3T|PRIVATE KEY", re.I)
_BLANK = re.compile(r"\n[ \t]*\n")
_VALUE = re.compile(r"[:=][ \t]{0,4}[\"']?([A-Za-z0-9/+_=.-]{8,128})\Z")

Part = tuple[str, int, int, str]


def parts_of(text: str, at: int = 0) -> list[Part]:
    """(kind, start, end, value) of the parts of a scope that begins at `at`, in order of position."""
    return [(m.lastgroup, at + m.start(), at + m.end(), m.group()) for m in _PARTS.finditer(text)]


def scopes_of(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of each block between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def linked(parts: list[Part], reach: int = REACH) -> Iterator[tuple[Part, list[Part]]]:
    """Each secret of a scope and the identifiers and endpoints whose intervals meet its own, widened by `reach`.

    Parts are sorted and don't overlap, so that both their starts and their ends ascend: the ones that
    meet an interval are those from the first that ends in or after it to the last that starts in it.
    """
    others = [p for p in parts if p[0] in ("identifier", "endpoint")]
    starts, ends = [p[1] for p in others], [p[2] for p in others]
    for p in parts:
        if p[0] in ("strong", "weak"):
            yield p, others[bisect_left(ends, p[1] - reach) : bisect_left(starts, p[2] + reach + 1)]


def found_in(text: str, reach: int = REACH) -> Iterator[tuple[str, int, int, str, list[Part]]]:
    """(strength, scope start, position, value, links) of each secret that is reported."""
    if not _HINT.search(text):
        return
    for at, scope in scopes_of(text):
        if not _HINT.search(scope):
            continue
        for (kind, start, _, match), links in linked(parts_of(scope, at), reach):
            if kind == "strong" or links:
                value = m.group(1) if kind == "weak" and (m := _VALUE.search(match)) else match
                yield kind, at, start, value, links


def findings(docs: DataFrame, key: str = "doc_id", column: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, position, strength, head, n_chars, identifiers, endpoints, links) of each reported secret."""
    schema = "doc_id long, position int, strength string, head string, n_chars int, identifiers int, endpoints int, links string"
    names = ["doc_id", "position", "strength", "head", "n_chars", "identifiers", "endpoints", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, x in enumerate(as_array(batch.column(1))):
                if x.is_valid:
                    for kind, _, at, value, links in found_in(x.as_py(), reach):
                        kinds = [p[0] for p in links]
                        rows.append((k, at, kind, value[:4], len(value), kinds.count("identifier"), kinds.count("endpoint"), ",".join(f"{p[0]}@{p[1]}" for p in links)))
            cut = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(8)]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cut[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cut[1:], kinds, strict=True))], names)

    return docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{column}`"].cast("string").alias("text")).mapInArrow(run, schema)


def scope_findings(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, position, strength, head, n_chars, identifiers, endpoints, nearest, distance) of each secret, linked within its whole scope.

    The counts are those of the scope; nearest is the closest identifier or endpoint, the earlier one of two, and distance
    the characters between it and the secret. Costs follow the text, not the pairs.
    """
    schema = "doc_id long, position int, strength string, head string, n_chars int, identifiers int, endpoints int, nearest string, distance int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *found) for k, x in enumerate(as_array(batch.column(1))) if x.is_valid for found in found_in_scope(x.as_py())]
            cut = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cut[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cut[1:], kinds, strict=True))], names)

    return docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{column}`"].cast("string").alias("text")).mapInArrow(run, schema)


def found_in_scope(text: str) -> Iterator[tuple[int, str, str, int, int, int, str | None, int | None]]:
    """(position, strength, head, n_chars, identifiers, endpoints, nearest, distance) of each secret, however far its complement in the scope."""
    if not _HINT.search(text):
        return
    for at, scope in scopes_of(text):
        if not _HINT.search(scope):
            continue
        parts = parts_of(scope, at)
        others = [p for p in parts if p[0] in ("identifier", "endpoint")]
        identifiers, starts = sum(p[0] == "identifier" for p in others), [p[1] for p in others]
        for kind, start, end, match in parts:
            if kind == "strong" or (kind == "weak" and others):
                value = m.group(1) if kind == "weak" and (m := _VALUE.search(match)) else match
                k = bisect_left(starts, start)
                beside = [(max(p[1] - end, start - p[2]), p[1], p[0]) for p in others[max(0, k - 1) : k + 1]]
                distance, place, other = min(beside, default=(None, None, None))
                yield start, kind, value[:4], len(value), identifiers, len(others) - identifiers, other and f"{other}@{place}", distance


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The same findings in DuckDB: matches and what lies between them give positions, intervals are joined on them.
SQL = f"""
WITH blocks AS (
  SELECT row_number() OVER () AS r, doc_id, string_split_regex(text, '\\n[ \\t]*\\n') AS b, regexp_extract_all(text, '\\n[ \\t]*\\n') AS g FROM documents WHERE text IS NOT NULL
),
scope AS (SELECT r, doc_id, unnest(b) AS s, generate_subscripts(b, 1) AS n, g FROM blocks),
spot AS (SELECT r, doc_id, n, s, sum(length(s) + coalesce(length(g[n]), 0)) OVER (PARTITION BY r ORDER BY n) - length(s) - coalesce(length(g[n]), 0) AS start FROM scope),
hits AS (
  SELECT r, doc_id, n, start, string_split_regex(s, {_quoted(f"{STRONG}|{WEAK}|{IDENTIFIER}|{ENDPOINT}")}) AS between,
         regexp_extract_all(s, {_quoted(f"{STRONG}|{WEAK}|{IDENTIFIER}|{ENDPOINT}")}) AS m FROM spot
  WHERE regexp_matches(s, '(?i)token|secret|passw?o?r?d|api[_-]?key|access[_-]?key|gh[pousr]_|xox[abprs]-|sk_live_|AIza|AKIA|ASIA|A3T|PRIVATE KEY')
),
each AS (SELECT r, doc_id, n, start, unnest(m) AS m, unnest(between[:len(m)]) AS gap, generate_subscripts(m, 1) AS k FROM hits WHERE len(m) > 0),
placed AS (SELECT r, doc_id, n, m, (start + sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS a FROM each WINDOW w AS (PARTITION BY r, n ORDER BY k)),
parts AS (
  SELECT r, doc_id, n, m, a, a + length(m) AS z,
    CASE WHEN regexp_full_match(m, {_quoted(STRONG)}) THEN 'strong' WHEN regexp_full_match(m, {_quoted(WEAK)}) THEN 'weak' WHEN regexp_full_match(m, {_quoted(IDENTIFIER)}) THEN 'identifier' ELSE 'endpoint' END AS kind
  FROM placed
),
joined AS (
  SELECT s.r, s.doc_id, s.a, s.kind, s.m, o.kind AS other, o.a AS other_a
  FROM parts s LEFT JOIN parts o ON o.r = s.r AND o.n = s.n AND o.kind IN ('identifier', 'endpoint') AND o.z >= s.a - {REACH} AND o.a <= s.z + {REACH}
  WHERE s.kind IN ('strong', 'weak')
),
value AS (SELECT *, CASE WHEN kind = 'weak' THEN regexp_extract(m, '[:=][ \\t]{{0,4}}["'']?([A-Za-z0-9/+_=.-]{{8,128}})$', 1) ELSE m END AS v FROM joined)
SELECT doc_id, a AS position, kind AS strength, left(v, 4) AS head, length(v)::INT AS n_chars, count(*) FILTER (other = 'identifier')::INT AS identifiers,
  count(*) FILTER (other = 'endpoint')::INT AS endpoints, coalesce(string_agg(other || '@' || other_a, ',' ORDER BY other_a), '') AS links
FROM value GROUP BY r, doc_id, a, kind, v HAVING kind = 'strong' OR count(other) > 0
"""
