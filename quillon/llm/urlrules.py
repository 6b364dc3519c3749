"""URL filter by association rules.

Labelled URLs are transactions: the distinct tokens of the URL, each with the part that it stands in
(scheme, host label, top-level domain, path segment, query name), and the marker of a bad page. Spark's
FP-growth mines the sets of tokens that are frequent among all labelled pages, and the rules from a
set of tokens to the marker, of any length. Rules are pruned by support (a share of the labelled pages, and MIN_PAGES bad
pages that bear a rule out), by confidence, and by chance: the lower bound of the confidence (Wilson, one-sided 95 %) must lie
above the share of bad pages among all labelled ones. A rule goes where another that needs fewer of its tokens is at least as confident.

Tokens that stand in exactly the same labelled pages say the same, so that the least of them stands for all: a host with
thousands of pages of one long template is one token, and doesn't make a rule of each subset of its tokens.

Rules are matched by an inverted index: each rule is listed under every one of its tokens, a page
counts for each rule how many of its tokens it holds, and the rule fires when that is all of them. The
number of frequent tokens is at most the tokens a URL divided by the least support, so that the
index that goes to the workers doesn't grow with the pages. Matching is row by row, without a shuffle.

Mining covers every labelled page. Labels are those of documents: a page is taken to be labelled by the row of `labels` whose
doc_id is its page_id.

Defined results: a null or empty URL has no tokens, fires no rule and is kept; labels with a null in any column aren't
used; of labels that share an id, one bad one is enough; repeated rows of pages are each matched and
count for mining once a distinct URL and id; of rules that fire, the one with the greatest confidence,
then support, then the least token string is named; a very long URL is matched like any other; without bad labels there are no rules and all
pages are kept; empty tables give empty results; further columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import Scratch

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5
MIN_PAGES = 5
Z = 1.6449
BAD = "label:bad"


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; all built-in expressions."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@|:[0-9]*$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    tld = F.regexp_extract(host, r"\.([^.]+)$", 1)
    labels = F.split(F.regexp_replace(host, r"\.[^.]+$", ""), r"[.-]", -1)
    steps = F.split(path, r"[/._-]", -1)
    names = F.transform(F.split(query, "&", -1), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, r"^[0-9]+$", "0")))

    return F.array_distinct(F.concat(marked("scheme:", F.array(scheme)), marked("host:", labels), marked("tld:", F.array(tld)), marked("path:", steps), marked("query:", names)))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad): every labelled page with a URL; low quality or toxic is bad."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(bad.alias("bad"))
    urls = pages.where("page_id is not null and url is not null").select("page_id", "url").distinct()
    joined = urls.join(marks, urls.page_id == marks.doc_id).select(url_tokens(F.col("url")).alias("tokens"), "bad")
    return joined.where(F.size("tokens") > 0)


def distinct_tokens(transactions: DataFrame) -> DataFrame:
    """(page, tokens, bad): the transactions with the least of each set of tokens that stand in exactly the same of them."""
    pages = transactions.withColumn("page", F.monotonically_increasing_id())
    each = pages.select("page", F.explode("tokens").alias("token"))
    # two sums of hashes of the pages tell sets of pages apart
    sums = [F.sum(F.xxhash64(F.lit(k), "page").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    first = each.groupBy("token").agg(F.count("*").alias("n"), *sums).groupBy("n", "s1", "s2").agg(F.min("token").alias("token")).select("token")
    kept = each.join(first, "token").groupBy("page").agg(F.collect_list("token").alias("tokens"))
    return pages.select("page", "bad").join(kept, "page")


def lower_bound(share: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share of n."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mined(transactions: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(tokens, confidence, n): the rules that lead from a set of tokens to a bad page, n being the pages that bear one out."""
    scratch = Scratch(transactions.sparkSession)
    rows = scratch.keep(distinct_tokens(scratch.keep(transactions, "pages")), "transactions")
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(math.ceil(min_support * total - 1e-9), min_pages, 1)
    items = F.when(F.col("bad") == 1, F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))
    # the support is a share; half a page less keeps rounding out of it
    model = FPGrowth(itemsCol="items", minSupport=min((least - 0.5) / max(total, 1), 1.0), minConfidence=0.0).fit(rows.select(items.alias("items")))
    sets = scratch.keep(model.freqItemsets.where(F.col("freq") >= least), "sets")
    with_mark = sets.where(F.array_contains("items", BAD)).select(F.sort_array(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n")).where(F.size("tokens") > 0)
    without = sets.where(~F.array_contains("items", BAD)).select(F.sort_array("items").alias("tokens"), F.col("freq").alias("all"))
    rules = with_mark.join(without, "tokens").select("tokens", (F.col("n") / F.col("all")).alias("confidence"), "n", "all")
    return rules.where((F.col("confidence") >= min_confidence) & (lower_bound(F.col("confidence"), F.col("all")) > F.lit(bad / max(total, 1)))).drop("all")


Rule = tuple[tuple[str, ...], float, int]


def pruned(rules: DataFrame) -> list[Rule]:
    """The rules without those that a part of their tokens bears out as well, most confident first.

    Rules are held against the shorter ones that stay, found by an index on their least token, so that a long rule isn't taken apart into all of its subsets.
    """
    out: list[Rule] = []
    by_least: dict[str, list[Rule]] = {}
    for r in sorted(rules.collect(), key=lambda r: len(r.tokens)):
        tokens = tuple(r.tokens)
        held = set(tokens)
        if not any(c >= r.confidence and held.issuperset(part) for t in tokens for part, c, _ in by_least.get(t, ()) if len(part) < len(tokens)):
            rule = (tokens, r.confidence, r.n)
            out.append(rule)
            by_least.setdefault(tokens[0], []).append(rule)
    return sorted(out, key=lambda r: (-r[1], -r[2], r[0]))


class Index:
    """Inverted index from tokens to the rules that need them."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.places: dict[str, list[int]] = {}
        for k, (tokens, _, _) in enumerate(rules):
            for t in tokens:
                self.places.setdefault(t, []).append(k)

    def fired(self, tokens: list[str]) -> list[int]:
        """The rules all of whose tokens are there, most confident first."""
        held: dict[int, int] = {}
        for t in tokens:
            for k in self.places.get(t, ()):
                held[k] = held.get(k, 0) + 1
        return sorted(k for k, n in held.items() if n == len(self.rules[k][0]))


def matched(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, url, n_rules, rule, confidence, kept) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for batch in batches:
            fired = [index.fired(x) for x in batch.column(2).to_pylist()]
            first = [index.rules[f[0]] if f else None for f in fired]
            columns = [pa.array([len(f) for f in fired], pa.int32()), pa.array([r and " ".join(r[0]) for r in first], pa.string())]
            columns += [pa.array([r and r[1] for r in first], pa.float64()), pa.array([not f for f in fired], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "n_rules", "rule", "confidence", "kept"])

    tokens = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), url_tokens(F.col("url")).alias("tokens"))
    return tokens.mapInArrow(run, "page_id long, url string, n_rules int, rule string, confidence double, kept boolean")


def filtered(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rules mined from the labelled pages, applied to all pages."""
    return matched(pages, pruned(mined(labelled(pages, labels), min_support, min_confidence, min_pages)))


#: The same in DuckDB, with all subsets of the frequent tokens of each page.
SQL = r"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS r, page_id, url, lower(trim(coalesce(url, ''), ' ')) AS low FROM pages),
q AS (SELECT *, regexp_extract(low, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_replace(regexp_replace(low, '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM p),
h AS (SELECT *, regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^[^@]*@|:[0-9]*$', '', 'g') AS host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '\?(.*)$', 1) AS query FROM q),
raw AS (
  SELECT r, page_id, url, list_distinct(list_concat(
    CASE WHEN scheme <> '' THEN ['scheme:' || regexp_replace(scheme, '^[0-9]+$', '0')] ELSE [] END,
    list_transform(list_filter(string_split_regex(regexp_replace(host, '\.[^.]+$', ''), '[.-]'), lambda x: x <> ''), lambda x: 'host:' || regexp_replace(x, '^[0-9]+$', '0')),
    CASE WHEN regexp_extract(host, '\.([^.]+)$', 1) <> '' THEN ['tld:' || regexp_replace(regexp_extract(host, '\.([^.]+)$', 1), '^[0-9]+$', '0')] ELSE [] END,
    list_transform(list_filter(string_split_regex(path, '[/._-]'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '^[0-9]+$', '0')),
    list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'query:' || regexp_replace(x, '^[0-9]+$', '0')))) AS tokens
  FROM h
),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
train AS (SELECT row_number() OVER () AS i, tokens, bad FROM (SELECT DISTINCT page_id, url, tokens FROM raw WHERE url IS NOT NULL) JOIN marks ON page_id = doc_id WHERE len(tokens) > 0),
base AS (SELECT greatest(ceil(count(*) * 0.002), 5) AS least, sum(bad) / count(*)::DOUBLE AS share FROM train),
one AS (SELECT i, bad, unnest(tokens) AS t FROM train),
stands AS (SELECT t, list(i ORDER BY i) AS places FROM one GROUP BY t HAVING count(*) >= (SELECT least FROM base)),
single AS (SELECT min(t) AS t FROM stands GROUP BY places),
few AS (SELECT i, bad, t FROM one JOIN single USING (t)),
subs AS (
  SELECT i, bad, [t] AS s, t AS last FROM few
  UNION ALL SELECT u.i, u.bad, list_append(u.s, f.t), f.t FROM subs u JOIN few f ON u.i = f.i AND f.t > u.last
),
sets AS (SELECT s, count(*) AS everything, sum(bad) AS n FROM subs GROUP BY s),
bounds AS (SELECT *, n::DOUBLE / everything AS confidence, 1.6449 * 1.6449 AS zz FROM sets),
rules AS (SELECT s, n, confidence FROM bounds WHERE n >= (SELECT least FROM base) AND confidence >= 0.5
  AND (confidence + zz / (2 * everything) - 1.6449 * sqrt(confidence * (1 - confidence) / everything + zz / (4.0 * everything * everything))) / (1 + zz / everything) > (SELECT share FROM base)),
kept AS (SELECT * FROM rules a WHERE NOT EXISTS (SELECT 1 FROM rules b WHERE len(b.s) < len(a.s) AND list_has_all(a.s, b.s) AND b.confidence >= a.confidence)),
fired AS (
  SELECT r, count(*) AS n_rules, first(array_to_string(s, ' ') ORDER BY confidence DESC, n DESC, s) AS rule, max(confidence) AS confidence
  FROM raw JOIN kept ON list_has_all(tokens, s) GROUP BY r
)
SELECT page_id, url, coalesce(n_rules, 0)::INT AS n_rules, rule, confidence, n_rules IS NULL AS kept FROM raw LEFT JOIN fired USING (r)
"""
