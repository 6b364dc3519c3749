"""The training-data operators as Spark jobs: odd rows, brute force on small tables, and their SQL."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tests.oracle import differences
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.llm import bpe, classifier, components, credentials, decontaminate, htmltext, linededup, minhash, queries, sharding, urlrules, webp
from quillon.llm.common import shingles, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, gone int, count long, curve string, `key` string, n int, group_id string, `odd.name` string"
_LONG = " ".join(f"word{k % 5000}" for k in range(200_000))
_TEXTS = [None, "", "x", "same text of some words that stands twice in the table", "same text of some words that stands twice in the table", _LONG, "only\n\n\nlines\n", "   \n\t"]


def docs_of(spark: SparkSession, texts: list[str | None], first: int = 0) -> DataFrame:
    rows = [(k, t, "en", "s", None if t is None else len(t), 1, "a", 2, 3, "c", "k", 4, "g", "o") for k, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark: SparkSession) -> DataFrame:
    """Nulls everywhere, repeated rows, shared ids, clashing names, empty and very long texts."""
    docs = docs_of(spark, _TEXTS)
    nothing = spark.createDataFrame([(None,) * 14, (None,) * 14, (77, None) + (None,) * 12], DOCS)
    return docs.unionByName(docs.where("doc_id in (3, 6)")).unionByName(nothing)


@pytest.fixture(scope="module")
def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark: SparkSession) -> DataFrame:
    rows = [(k, int(k % 2), 0) for k in range(8)] + [(None, 1, 1), (3, None, 0), (4, 1, None), (5, 1, 1), (5, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "some words that stands twice"), (1, "word17 word18 word19"), (2, None), (None, "x"), (3, ""), (4, "!!")], "item_id long, text string")


def rows_of(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


# odd rows


def test_minhash_odd_rows(odd: DataFrame, none: DataFrame) -> None:
    got = {r.doc_id: r for r in minhash.near_duplicate_groups(odd).collect()}
    assert set(got) == {*range(8), 77}
    assert (got[3].group_id, got[4].group_id, got[4].kept, got[3].group_size) == (3, 3, False, 2)
    assert all(got[k].group_id == k and got[k].kept for k in got if k != 4)
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*"0123567", "77", "None", "None"])
    assert rows_of(minhash.near_duplicate_groups(none)) == [] and rows_of(minhash.without_near_duplicates(none)) == []


def test_linededup_odd_rows(spark: SparkSession, odd: DataFrame, none: DataFrame) -> None:
    got = {r.doc_id: (r.text, r.lines_removed) for r in linededup.deduplicated(odd).collect()}
    assert got[3] == (_TEXTS[3], 0) and got[4] == ("", 1) and got[0] == (None, 0) and got[1] == ("", 0) and got[6] == (_TEXTS[6], 0) and got[77] == (None, 0)
    kept = linededup.without_shared_lines(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 4").count() == 0
    assert rows_of(linededup.deduplicated(none)) == [] and rows_of(linededup.without_shared_lines(none)) == []


def test_decontamination_odd_rows(odd: DataFrame, none: DataFrame, items: DataFrame) -> None:
    got = sorted(rows_of(decontaminate.contaminations(odd, items)))
    assert got == [(3, 1, 0), (4, 1, 0), (5, 1, 0)]
    kept = decontaminate.without_contaminated(odd, items)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([*"012667", "77", "None", "None"])
    assert rows_of(decontaminate.contaminations(none, items)) == []
    assert rows_of(decontaminate.contaminations(odd, items.limit(0))) == []
    assert decontaminate.without_contaminated(odd, items.limit(0)).count() == odd.count()


def test_classifier_odd_rows(odd: DataFrame, none: DataFrame, labels: DataFrame) -> None:
    model = classifier.fit(odd, labels)
    got = classifier.score(odd, model).collect()
    assert len(got) == odd.count() and all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in got)
    assert all(r.kept for r in got if r.doc_id in (0, 1, 77, None))
    kept = classifier.without_rejected(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert rows_of(classifier.score(none, model)) == [] and rows_of(classifier.without_rejected(none, labels)) == []


def test_bpe_odd_rows(odd: DataFrame, none: DataFrame) -> None:
    got = bpe.encoded(odd)
    assert all(r.decoded == r.text and (r.n_tokens is None) == (r.text is None) and (r.tokens is None or len(r.tokens) == r.n_tokens) for r in got.join(odd.select("doc_id", "text").distinct(), "doc_id").collect())
    assert got.where("doc_id is null").count() == 2
    assert sorted(map(str, rows_of(bpe.decoded(got)))) == sorted(map(str, rows_of(odd.select("doc_id", "text"))))
    assert rows_of(bpe.encoded(none)) == [] and rows_of(bpe.decoded(bpe.encoded(none))) == []


def test_secrets_odd_rows(spark: SparkSession, odd: DataFrame, none: DataFrame) -> None:
    assert rows_of(credentials.findings(odd)) == [] and rows_of(credentials.findings(none)) == []
    docs = docs_of(spark, ['ann@example.com token = "abcdefgh12345678"', 'token = "abcdefgh12345678"'])
    got = credentials.findings(docs.union(docs)).collect()
    assert [(r.doc_id, r.strength, r.head, r.n_chars, r.identifiers, r.endpoints) for r in got] == [(0, "weak", "abcd", 16, 1, 0)] * 2


def test_sharding_odd_rows(odd: DataFrame, none: DataFrame) -> None:
    got = sharding.sharded(odd)
    assert got.columns == [*(c for c in odd.columns if c != "curve"), "curve", "shard"] and got.count() == odd.count()
    assert got.groupBy("doc_id", "text").agg(F.countDistinct("curve", "shard").alias("n")).where("n > 1").count() == 0
    assert rows_of(sharding.sharded(none)) == []


def test_html_odd_rows(spark: SparkSession) -> None:
    pages = spark.createDataFrame([(1, None, "a"), (None, "<p>x", "b"), (2, "", "c"), (2, "", "c"), (3, "<p>" + "long text " * 100_000, "d")], "page_id long, html string, text string")
    got = rows_of(htmltext.extracted(pages))
    assert sorted((str(r[0]), len(r[1]) if r[1] is not None else None) for r in got) == [("1", None), ("2", 0), ("2", 0), ("3", 999_999), ("None", 0)]
    assert rows_of(htmltext.extracted(pages.limit(0))) == []


def test_urls_odd_rows(spark: SparkSession) -> None:
    rows = [(k, f"http://{'spam-farm' if k % 3 == 0 else 'good'}.example.org/{'buy' if k % 2 else 'read'}/{k}") for k in range(120)]
    pages = spark.createDataFrame([(*r, None) for r in [*rows, rows[0], (None, None), (None, "x"), (500, ""), (501, None), (502, "http://x.org/" + "/".join(f"p{k}" for k in range(20_000)))]], "page_id long, url string, tokens string")
    marks = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, 0) for k in range(90)] + [(None, 0, 1), (1, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = urlrules.filtered(pages, marks, min_support=0.05, min_pages=1).collect()
    assert len(got) == pages.count()
    assert all(r.kept == (r.page_id is None or r.page_id >= 500 or r.page_id % 3 != 0) for r in got)
    assert {r.rule for r in got if not r.kept} == {"host:farm"} and {r.n_rules for r in got if not r.kept} == {1}
    assert all(r.kept for r in urlrules.filtered(pages, marks.limit(0)).collect())
    assert all(r.kept for r in urlrules.filtered(pages, marks.where("quality = 1")).collect())
    assert rows_of(urlrules.filtered(pages.limit(0), marks)) == []


def test_media_odd_rows(spark: SparkSession) -> None:
    vectors = spark.createDataFrame([(1, [0.5] * 64, 1), (2, None, 1), (None, [0.1, None, -3.0], 1), (4, [], 1), (1, [0.5] * 64, 1)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in webp.decoded(webp.drawn(vectors)).collect()}
    assert (got[1].width, got[1].height, len(got[1].pixels)) == (8, 8, 256) and got[2].pixels is None and got[4].error is None
    assert got[None].pixels[:12] == [140, 115, 140, 255, 127, 128, 128, 255, 0, 255, 2, 255]
    broken = spark.createDataFrame([(9, bytearray(b"no picture"))], "vec_id long, picture binary")
    assert webp.decoded(broken).first().error == "not a WebP file"
    assert rows_of(webp.decoded(webp.drawn(vectors.limit(0)))) == []


# brute force


def _sets(texts: list[str]) -> list[set[int]]:
    words, first = word_hashes(pa.array(texts))
    items, to = shingles(words, first, minhash.WIDTH)
    return [set(items[i:j].tolist()) for i, j in zip(to[:-1], to[1:], strict=True)]


def test_near_duplicates_against_all_pairs(spark: SparkSession) -> None:
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(60)]
    for k in range(120):
        x = texts[rng.randrange(60)].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            x[rng.randrange(len(x))] = rng.choice(words)
        texts.append(" ".join(x))
    sets = _sets(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= minhash.THRESHOLD * len(sets[i] | sets[j])]
    group = {r.doc_id: r.group_id for r in minhash.near_duplicate_groups(docs_of(spark, texts)).collect()}
    found = sum(group[i] == group[j] for i, j in pairs)
    assert len(pairs) > 100 and found >= 0.9 * len(pairs)
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    assert all(root[i] == root[g] for i, g in group.items())


def test_components_against_union_find(spark: SparkSession) -> None:
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_planted_benchmark_passages(spark: SparkSession) -> None:
    rng = random.Random(8)
    words = [f"word{k}x" for k in range(500)]
    items = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(10)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(40)]
    planted = set()
    for k in range(10):
        edited = items[k].replace("x ", "y ", k % 5)
        texts[k] = texts[k][:90] + " " + edited.upper() + ". " + texts[k][90:]
        planted.add((k, k))
    rows = decontaminate.contaminations(docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted
    assert {r.doc_id: r.distance for r in rows} == {k: k % 5 for k in range(10)}


def test_rules_of_any_length_against_all_subsets(spark: SparkSession) -> None:
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        tokens = sorted(rng.sample("abcdefg", rng.randint(2, 6)))
        bad = int(rng.random() < (0.95 if {"a", "b", "c", "d"} <= set(tokens) else 0.2))
        rows.append((tokens + (["twin"] if "a" in tokens else []), bad))  # a and its twin stand in the same pages
    share = sum(b for _, b in rows) / len(rows)
    counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for tokens, bad in rows:
        own = [t for t in tokens if t != "twin"]
        for k in range(1, len(own) + 1):
            for s in combinations(own, k):
                counts[s][0] += 1
                counts[s][1] += bad

    def bound(p: float, n: int) -> float:
        z = urlrules.Z
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    expected = {s: (b / n, b) for s, (n, b) in counts.items() if b >= 8 and b / n >= 0.4 and bound(b / n, n) > share}
    rules = urlrules.mined(spark.createDataFrame(rows, "tokens array<string>, bad int"), 0.02, 0.4, 1)
    assert {tuple(r.tokens): (r.confidence, r.n) for r in rules.collect()} == expected
    assert any(len(s) >= 4 for s in expected)
    left = {s: c for s, (c, _) in expected.items() if not any(set(t) < set(s) and expected[t][0] >= c for t in expected)}
    assert {t: c for t, c, _ in urlrules.pruned(rules)} == left


def test_one_template_of_many_tokens_is_one_rule(spark: SparkSession) -> None:
    url = "http://shop." + "/".join(f"part{k}" for k in range(60))
    pages = spark.createDataFrame([(k, url if k < 40 else f"http://good.org/{k % 7}") for k in range(100)], "page_id long, url string")
    marks = spark.createDataFrame([(k, int(k >= 40), 0) for k in range(100)], "doc_id long, quality int, toxic int")
    got = urlrules.filtered(pages, marks).collect()
    assert all(r.kept == (r.page_id >= 40) and r.n_rules == int(r.page_id < 40) for r in got)


def test_shards_prune_each_dimension(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    rows = [(k, "x" * 50, f"l{rng.integers(8)}", f"s{rng.integers(20):02d}", int(rng.integers(1, 5000))) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shards = sharding.sharded(docs, target=5000).groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars") for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    assert len(shards) > 20
    for column, value in (("lang", "l3"), ("source", "s11"), ("n_chars", 2500)):
        hit = sum(r[f"lo_{column}"] <= value <= r[f"hi_{column}"] for r in shards)
        assert hit < 0.75 * len(shards), column


def test_written_shards_are_pruned_by_their_statistics(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    rng = np.random.default_rng(5)
    rows = [(k, "x" * 50, f"l{rng.integers(8)}", f"s{rng.integers(20):02d}", int(rng.integers(1, 5000))) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = sharding.sharded(docs, target=5000)
    assert made.rdd.getNumPartitions() == made.select("shard").distinct().count() or made.rdd.getNumPartitions() == made.agg(F.max("shard")).first()[0] + 1
    sharding.write_shards(made, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").rglob("*.parquet"))
    assert len(files) == made.select("shard").distinct().count()
    for column, value in (("lang", "l3"), ("source", "s11"), ("n_chars", 2500)):
        hit = 0
        for f in files:
            meta = pq.ParquetFile(f).metadata
            k = [meta.schema.column(c).name for c in range(meta.num_columns)].index(column)
            stats = [meta.row_group(g).column(k).statistics for g in range(meta.num_row_groups)]
            hit += min(x.min for x in stats) <= value <= max(x.max for x in stats)
        assert hit < 0.6 * len(files), (column, hit, len(files))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000


def test_decontamination_in_chunks_is_the_same(spark: SparkSession) -> None:
    rng = random.Random(3)
    words = [f"word{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(12))) for k in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) + (" " + items[k][1] if k < 20 else "") for k in range(40)]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(rows_of(decontaminate.contaminations(docs, bench, size=500))) == sorted(rows_of(decontaminate.contaminations(docs, bench)))
    kept = decontaminate.without_contaminated(docs, bench, size=500)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(20, 40))


# whole queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark: SparkSession, name: str) -> None:
    assert differences(entry.queries()[name](spark, SF), queries.ORACLES[name], SF) == ""


def test_every_operator_has_a_query() -> None:
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in entry.queries()


def test_pipeline_is_its_stages_and_keeps_clean_documents(spark: SparkSession) -> None:
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == before.columns, name
        assert 0.5 * before.count() <= docs.count() <= before.count(), name
    expected = {(r.doc_id, r.text) for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.decoded) for r in got} == expected and len(got) == len(expected)
