"""Golden values, odd inputs and state of the search operators."""

from __future__ import annotations

import io
import json
import time
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions import scores
from quillon.operators import encode, frames, knn, plugins, reduce, split, video
from quillon.plans.flow import REGISTRY, Flow, register
from quillon.sources import documents as sources
from quillon.streaming import barrier


def value(spark: SparkSession, column) -> object:
    return spark.range(1).select(column.alias("x")).first().x


# scores


@pytest.mark.parametrize(("expression", "expected"), [
    (lambda: scores.normalizer2(F.lit(0.5), 2), 0.8),
    (lambda: scores.normalizer3(F.lit(0.5), 2), 0.7387961283389092),
    (lambda: scores.normalizer4(F.lit(0.5), 2), 0.75),
    (lambda: scores.weighted_chunk(F.lit(2.0), F.lit(0.5), F.lit(0.7)), 0.7),
    (lambda: scores.modified(F.lit(0.0), "log"), None),
    (lambda: scores.modified(F.lit(-1.0), "sqrt"), None),
    (lambda: scores.modified(F.lit(0.0), "reciprocal"), None),
    (lambda: scores.modified(F.lit(99.0), "log1p"), 2.0),
    (lambda: scores.combined("avg", F.lit(1.0), F.lit(2.0), F.lit(6.0)), 3.0),
    (lambda: scores.coord_doc(F.lit(0.6), F.lit(1), F.lit(3)), 0.2),
    (lambda: scores.coord_doc(F.lit(0.6), F.lit(1), F.lit(0)), 0.6),
    (lambda: scores.offset_weight(F.lit(1), F.lit(5)), 4.0),
    (lambda: scores.offset_weight(F.lit(1), F.lit(5), F.array(F.lit(0), F.lit(0)), F.array(F.lit(3), F.lit(4))), 1 / 6),
])
def test_golden_scores(spark: SparkSession, expression, expected: float | None) -> None:
    got = value(spark, expression())
    assert got is None if expected is None else got == pytest.approx(expected)


def test_unknown_names_are_errors() -> None:
    for f in (lambda: scores.modified(F.lit(1.0), "cube"), lambda: scores.combined("median", F.lit(1.0)), lambda: scores.reduction("median")):
        with pytest.raises((ValueError, AssertionError)):
            f()


def test_chunk_scores_sum_up(spark: SparkSession) -> None:
    hits = spark.createDataFrame([(0, 1, 0.1), (0, 1, 0.2), (0, 1, 0.3), (0, 2, 0.4), (0, 3, 0.3)], "query_id int, doc_id int, score double")
    got = {r.doc_id: (round(r.score, 9), r.n_hits) for r in reduce.chunks_to_docs(hits).collect()}
    assert got == {1: (0.6, 3), 2: (0.4, 1), 3: (0.3, 1)}


# text


def _pieces(text: str, least: int = 1, most: int = 256) -> list[tuple[int, str]]:
    import re
    import string

    found = re.findall(r"[^.!?。！？]+[.!?。！？]", text) or [text]
    out = []
    for k, p in enumerate(found):
        p = re.sub(r"\n+", " ", "".join(c for c in p if c in string.printable)).strip()
        if len(p) > least:
            out.append((k, p[:most]))
    return out


def test_sentences_against_plain_python(spark: SparkSession) -> None:
    texts = ["", "no end", "One. Two! Three? rest", "...", "..a.b.", "日本。語！x.", "a\n\nb.", "\x0b x.\t", "é.", "x" * 400 + ".", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict[int, list] = {}
    for r in split.sentences(docs).orderBy("doc_id", "offset").collect():
        got.setdefault(r.doc_id, []).append((r.offset, r.text))
    assert got == {k: p for k, t in enumerate(texts) if t is not None and (p := _pieces(t))}


def test_json_documents(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, '{"Content":"a b","z":1,"y":"q"}')], "doc_id long, json string")
    r = split.json_documents(docs).first()
    assert r.text == "a b" and json.loads(r.meta_info) == {"y": "q", "z": "1"}
    with pytest.raises(Exception, match="no member"):
        split.json_documents(docs.withColumn("json", F.lit("{}"))).collect()
    with pytest.raises(NotImplementedError):
        split.chain(docs)


# nearest neighbours


@pytest.mark.parametrize("metric", sorted(knn.METRICS))
def test_blocks_find_what_all_pairs_have(spark: SparkSession, metric: str) -> None:
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (90, 6)).astype(float)
    side = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [1.0])], "id long, vector array<double>")
    d = np.round(knn.METRICS[metric](x, x), knn.DIGITS)
    got: dict[int, list] = {}
    for r in knn.nearest(side, side, 7, metric, block_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {k: np.lexsort((np.arange(90), d[k]))[:7].tolist() for k in range(90)}


def test_few_rows_and_wrong_k(spark: SparkSession) -> None:
    side = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vector array<double>")
    assert [tuple(r) for r in knn.nearest(side, side, 5).collect()] == [(1, 1, 0.0, 1)]
    assert knn.nearest(side.limit(0), side.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(side, side, 0)
    with pytest.raises(ValueError):
        sources.query_rows(side, 0)


# encoders and frames


def test_quantisers_and_groups() -> None:
    grid = encode.grid_quantiser(-1, 1, 2, 9)
    assert grid.shape == (9, 2) and np.allclose(grid.mean(axis=0), 0)
    with pytest.raises(ValueError):
        encode.grid_quantiser(1, 1, 2)
    groups = encode.balanced_groups(np.array([16.0, 8, 4, 2]), 2)
    assert sorted(groups) == [0, 1, 2, 3] and sorted(groups[:2]) == [0, 3]
    for method in ("uniform", "product_uniform", "ortho_uniform"):
        assert encode.projections(8, 16, method).shape == (8, 16)


def test_vlad_of_farthest_differs(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, [0.0, 0.1]), (1, [1.0, 0.9])], "doc_id long, vector array<double>")
    centres = np.array([[0.0, 0.0], [1.0, 1.0]])
    near, far = (encode.vlad(rows, centres, ("doc_id",), farthest=f).first().embedding for f in (False, True))
    assert np.allclose(near, np.array([0, 0.1, 0, -0.1]) / np.sqrt(0.02)) and not np.allclose(near, far)


def test_frames(spark: SparkSession) -> None:
    arr = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    assert value(spark, frames.selected_frames(arr(10), 1)) == [5]
    assert value(spark, frames.selected_frames(arr(10), 3)) == [0, 4, 8]
    assert len(value(spark, frames.selected_frames(arr(5), 3))) == 3
    assert value(spark, frames.selected_frames(arr(3), 5)) == [0, 1, 2]
    assert video.kept_frames([0, 1, 0xFFFF, 0xFFFE, 0, 31]) == [0, 2, 5]
    assert frames.log_mel(np.sin(np.arange(16000) / 5)).shape == (98, 64)
    box = tuple(F.lit(x) for x in (0.0, 0.0, 2.0, 2.0))
    other = tuple(F.lit(x) for x in (1.0, 1.0, 3.0, 3.0))
    assert value(spark, frames.overlap(box, other)) == pytest.approx(1 / 7)


def test_windows_over_pictures(spark: SparkSession) -> None:
    pictures = spark.createDataFrame([(1, 5, 4, 1, list(range(20))), (2, 1, 1, 1, None)], "doc_id long, height int, width int, channels int, pixels array<int>")
    got = frames.sliding_windows(pictures, 2, 2).orderBy("offset").collect()
    assert len(got) == 6 and got[0].pixels == [0, 1, 4, 5] and got[4].pixels == [16, 17, 0, 0] and sum(r.weight for r in got) == pytest.approx(1)
    weighted = frames.sliding_windows(pictures, 2, 2, weighted=True).collect()
    assert sum(r.weight for r in weighted) == pytest.approx(1)


def test_slots(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0])], "doc_id long, offset int, samples array<double>")
    slot = plugins.SLOTS["audio_network"]
    with pytest.raises(NotImplementedError):
        slot(rows)
    bound = slot.bind(lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)], ["doc_id", "offset", "embedding"]))
    assert bound(rows).first().embedding == [1.0, 2.0]
    with pytest.raises(ValueError):
        bound(rows.drop("samples"))


# merging


def test_merging_of_results(spark: SparkSession) -> None:
    a = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], "doc_id long, offset int, embedding array<double>")
    b = spark.createDataFrame([(1, 0, [3.0])], "doc_id long, offset int, embedding array<double>")
    assert reduce.joined_embeddings([a, b], "concat").first().embedding == [1.0, 3.0]
    assert reduce.joined_embeddings([a, b], "avg").first().embedding == [2.0]
    first, second = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, None), (2, "a")], [(1, "b"), (2, "c"), (3, None)]))
    assert {r.doc_id: r.text for r in reduce.filled([first, second], ("doc_id",), "text").collect()} == {1: "b", 2: "a", 3: None}
    docs = spark.createDataFrame([(k * k,) for k in range(5)], "doc_id long")
    assert [(r.part_id, r.num_parts) for r in reduce.batches(docs, 2).orderBy("doc_id").collect()] == [(1, 3), (1, 3), (2, 3), (2, 3), (3, 3)]
    with pytest.raises(ValueError):
        reduce.batches(docs, 0)


def test_barrier_over_a_stream(spark: SparkSession, tmp_path: Path) -> None:
    schema = "node string, request_id long, part_id int, num_parts int"
    rows = [("r", 1, 1, 2), ("r", 1, 1, 2), ("r", 2, 1, 2), ("s", 1, 1, 1), ("r", 1, 2, 2), ("r", 3, 1, 3)]
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = barrier.awaited(barrier.file_stream(spark, str(tmp_path / "in"), schema, 1), timeout_ms=12_000)
    q = stream.writeStream.format("memory").queryName("waited").outputMode("append").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("waited").count() < 4:
            time.sleep(1)
            spark.createDataFrame([("tick", int(time.time()), 1, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    finally:
        q.stop()
    got = {(r.node, r.request_id): (r.n_parts, r.num_parts, r.status) for r in spark.table("waited").where("node <> 'tick'").collect()}
    assert got[("r", 1)] == (2, 2, "complete") and got[("s", 1)] == (1, 1, "complete")
    assert all(v[2] == "expired" for k, v in got.items() if k in (("r", 2), ("r", 3)))


# sources


def test_sources(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "t.txt").write_text("a\nbé\n")
    assert [bytes(r.raw) for r in sources.text_lines(spark, str(tmp_path / "t.txt"), keep_newline=True).collect()] == [b"a\n", "bé\n".encode()]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x/1", b"one")
        z.writestr("2", b"two")
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    assert {(r.name, bytes(r.raw)) for r in sources.zip_members(spark, str(tmp_path / "z.zip")).collect()} == {("x/1", b"one"), ("2", b"two")}
    docs = sources.numbered(sources.bytes_rows(spark, [b"p", b"q", b"r"]), "seq", 10)
    assert [(r.doc_id, bytes(r.raw), r.weight) for r in docs.orderBy("doc_id").collect()] == [(10, b"p", 1.0), (11, b"q", 1.0), (12, b"r", 1.0)]
    assert [r.request_id for r in sources.request_batches(docs, 2).orderBy("doc_id").collect()] == [0, 0, 1]


def test_document_store(spark: SparkSession, tmp_path: Path) -> None:
    store = sources.DocumentStore(spark, str(tmp_path / "docs"), drop=("raw",))
    store.add(spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "doc_id long, text string, raw string"), 1)
    store.add(spark.createDataFrame([(2, "c", "x"), (5, "d", "x")], "doc_id long, text string, raw string"), 2)
    assert [(r.doc_id, r.text) for r in store.scan(reverse=True).collect()] == [(5, "d"), (2, "c"), (1, "a")]
    ids = spark.createDataFrame([(2,), (9,)], "doc_id long")
    assert {r.doc_id: r.text for r in store.fetch(ids).collect()} == {2: "c", 9: None}
    assert store.fetch(ids, keep_missing=False).count() == 1
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2500, 0, "z")], "doc_id long, offset int, text string")
    sources.write_chunk_files(chunks, str(tmp_path / "chunks"))
    assert [r.text for r in sources.read_chunk_files(spark, str(tmp_path / "chunks"), 1).orderBy("offset").collect()] == ["a", "b"]


# flows


def test_flow(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string")
    flow = Flow().add("split", split.sentences).add("count", split.chunks_in_doc)
    assert flow.run(docs).first().n_chunks == 2
    assert flow == Flow().add("split", split.sentences).add("count", lambda x: x) and flow != Flow().add("split", split.sentences)
    assert flow.mermaid() == "graph LR\nsource-->split\nsplit-->count"
    joined = flow.add("joined", lambda a, b: a.join(b, "doc_id"), after=("split", "count"))
    assert joined.run(docs).count() == 2 and joined.remove("count").edges() == '{"joined": ["split"], "split": ["source"]}'
    for wrong in (lambda: flow.add("split", split.sentences), lambda: flow.add("x y", split.sentences), lambda: flow.add("z", split.sentences, "nowhere"), lambda: flow.set("split", after="count"), lambda: flow.remove("q"), lambda: Flow().run(docs)):
        with pytest.raises(ValueError):
            wrong()


def test_flow_from_yaml(spark: SparkSession) -> None:
    pytest.importorskip("yaml")
    register("sentences")(lambda **kw: lambda docs: split.sentences(docs, **kw))
    flow = Flow.from_yaml("[{name: pieces, use: sentences, with: {min_len: 2}}]")
    assert flow.run(spark.createDataFrame([(1, "One. X.")], "doc_id long, text string")).count() == 1
    assert "sentences" in REGISTRY
    with pytest.raises(ValueError):
        Flow.from_yaml("[{name: a, use: os.system}]")


# models and logs


def test_models_come_back(spark: SparkSession, tmp_path: Path) -> None:
    from quillon.operators import models

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    for model in (encode.PrincipalComponents.fit(rows, 3, whiten=True), encode.ProductQuantiser.fit(rows, 2, 3), encode.Hasher.fit(rows, 1, 2, 3)):
        models.save(spark, model, str(tmp_path / "m"))
        assert np.array_equal(models.load(spark, str(tmp_path / "m")).matrix(x), model.matrix(x))
    models.save(spark, encode.Standardiser.fit(rows), str(tmp_path / "m"))
    z = np.array([r.z for r in rows.select(models.load(spark, str(tmp_path / "m"))(F.col("vector")).alias("z")).collect()])
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z.std(axis=0), 1)
    with pytest.raises(ValueError):
        models.save(spark, object(), str(tmp_path / "m"))


def test_silence_logs_and_directions(spark: SparkSession) -> None:
    logs = spark.createDataFrame([(1, "x silence_start: -0.01\n silence_end: 1.5 | d\n silence_start: 3"), (2, "")], "doc_id long, log string")
    assert [tuple(r) for r in frames.silence_times(logs).orderBy("start").collect()] == [(1, 0.0, 1.5), (1, 3.0, None)]
    assert reduce.same_direction(True, True)
    with pytest.raises(ValueError):
        reduce.same_direction(True, False)


# searches within buckets


@pytest.mark.parametrize("metric", ["bits", "euclidean"])
def test_search_among_rows_that_share_a_key(spark: SparkSession, metric: str) -> None:
    rng = np.random.default_rng(4)
    kind, width = ("int", 3) if metric == "bits" else ("double", 5)
    vectors = rng.integers(0, 8, (90, width)) if metric == "bits" else np.round(rng.normal(size=(90, width)), 1) + 1e4
    vectors[50:60] = vectors[0]
    # a key that most rows hold, one that few hold, and rows without one
    keys = [[int(a) if i % 9 else None, 0 if i < 70 else int(b)] for i, (a, b) in enumerate(rng.integers(0, 5, (90, 2)))]
    rows = [(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, vectors, strict=True))]
    odd = [(90, None, vectors[0].tolist()), (91, keys[1], None), (92, keys[1], vectors[0].tolist()[:-1])]
    x = spark.createDataFrame(rows + odd, f"id long, keys array<int>, vector array<{kind}>")
    apart = lambda a, b: float(sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(a, b, strict=True))) if metric == "bits" else round(float(np.sqrt(((a - b) ** 2).sum())), 9)
    expected = set()
    for q in range(0, 90, 4):
        near = sorted((apart(vectors[q], vectors[i]), i) for i in range(90) if any(a is not None and a == b for a, b in zip(keys[q], keys[i], strict=True)))
        expected |= {(q, i, d, n + 1) for n, (d, i) in enumerate(near[:7])}
    for block_rows in (16, 1024):
        got = knn.sharing(x.where("id % 4 = 0 and id < 90"), x, 7, metric, block_rows)
        assert {tuple(r) for r in got.select("query_id", "id", "distance", "rank").collect()} == expected


@pytest.mark.parametrize("name", ["knn_lsh", "knn_bucket_bit_hamming", "exact_first", "hash_fit_search"])
def test_buckets_are_searched_in_blocks(spark: SparkSession, name: str) -> None:
    from quillon.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # pairs are measured where blocks meet; what is exploded, or joined by a bucket, holds each pair of rows as a row
    assert "MapInArrow" in plan and "Generate" not in plan


def test_equal_codes_of_least_ids(spark: SparkSession) -> None:
    x = spark.createDataFrame([(i, [i % 2]) for i in range(20)] + [(20, None)], "id long, code array<int>")
    q = x.where("id in (4, 5)")
    got = sorted(tuple(r) for r in knn.equal_codes(q, x, 3).collect())
    assert got == [(4, 0, 0.0), (4, 2, 0.0), (4, 4, 0.0), (5, 1, 0.0), (5, 3, 0.0), (5, 5, 0.0)]
    assert knn.equal_codes(q, x).count() == 20


def test_pictures_are_counted_in_partitions_of_bounded_rows(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr("quillon.session.PART_ROWS", 10)
    chunks = spark.createDataFrame([(d, o, [0, 0], 0.5) for d in range(30) for o in range(d % 4)] + [(None, 0, [0, 0], 0.5)], "doc_id long, offset int, cell array<int>, weight double")
    pictures = spark.createDataFrame([(d,) for d in range(40)] * 2 + [(None,)], "doc_id long")
    made = video.with_whole_pictures(chunks, pictures)
    assert made._jdf.queryExecution().executedPlan().toString().count(", 9), REPARTITION_BY_NUM") == 2  # 81 rows at most in a table
    whole = sorted(((r.doc_id, r.offset) for r in made.where("weight = 1").collect()), key=str)
    assert whole == sorted([(d, d % 4 if d < 30 else 0) for d in range(40)] + [(None, 0)], key=str) and made.count() == chunks.count() + 41


def test_characters_are_counted_in_bounded_memory(spark: SparkSession) -> None:
    import tracemalloc

    rng = np.random.default_rng(6)
    odd = ["", "é日x", "a" * 3_000_000, *("xyzé "[int(k) :] * int(n) for k, n in rng.integers(0, 5, (500, 2)))]
    texts = pa.array(odd + ["some more text. " * 1000] * 800)
    place = lambda points: points * 31 % 16
    tracemalloc.start()
    counts, n = encode._counts(texts, place, 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000, most  # 16 million characters
    assert all((counts[i] == np.bincount([ord(c) * 31 % 16 for c in t], minlength=16)).all() and n[i] == len(t) for i, t in enumerate(odd))
    assert (counts[-1] == np.bincount([ord(c) * 31 % 16 for c in texts[-1].as_py()], minlength=16)).all()


def test_exact_distances_of_few_pairs(monkeypatch: pytest.MonkeyPatch) -> None:
    rng = np.random.default_rng(8)
    x = rng.dirichlet(np.ones(16), 700)
    x[200:260] = x[0]  # ties
    x[300:310] = x[1] + 1e-8  # nearer than single precision tells
    x[310:320] = x[1] + 2e-8
    measured, plain = [], knn._l1_apart
    monkeypatch.setattr(knn, "_l1_apart", lambda q, c: measured.append(len(q)) or plain(q, c))
    flat = lambda a: pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(a.ravel()))
    for scale, ids in ((1, rng.permutation(700)), (1e30, np.arange(700)), (1e45, np.arange(700))):
        y = x * scale
        batch = pa.RecordBatch.from_arrays([flat(np.arange(100)), flat(y[:100]), flat(ids), flat(y)], ["a", "b", "c", "d"])
        got = pa.Table.from_batches(list(knn._searched(knn._l1, 12, 16)(iter([batch])))).to_pylist()
        exact = np.round(np.abs(y[:100, None] - y[None]).sum(axis=2) / 16, 9)
        best = np.lexsort((np.broadcast_to(ids, exact.shape), exact), axis=1)[:, :12]
        expected = [(q, int(ids[i]), exact[q, i]) for q in range(100) for i in best[q]]
        assert sorted((r["query_id"], r["id"], r["distance"]) for r in got) == sorted(expected)
        if scale == 1:
            assert sum(measured) < 100 * 700 / 10
