"""Flows from configurations, training, indexing and asking, templates, modules of the user's own, batches, hooks."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.operators import encode, split
from quillon.plans import catalogue, extend, steps
from quillon.plans.flow import REGISTRY, Flow, index_flow, query_flow
from tests.oracle import differences

SF = "/root/testdata/sf0.001"

SEARCH = """
- {source: documents}
- {name: vectors, use: select, with: {columns: {id: vec_id, vector: "cast(embedding as array<double>)"}}}
- {name: present, use: where, with: {condition: vector is not null}}
- {name: asked, use: where, with: {condition: id % 50 = 0}}
- {name: near, use: nearest, with: {k: 10, metric: l1}, after: [asked, present]}
- {name: scored, use: normalized_score, with: {number: 1, to: relevance}}
- {name: hits, use: select, with: {columns: {query_id: query_id % 100, doc_id: id % 100, score: "round(relevance, 9)"}}}
- {name: docs, use: chunks_to_docs}
- {name: chunks, use: select, with: {columns: {doc_id: id % 100}}, after: [present]}
- {name: counts, use: chunks_in_doc}
- {name: counted, use: join, with: {keys: [doc_id], how: left}, after: [docs, counts]}
- {name: ranked, use: coord_doc}
- {name: filled, use: with_documents, after: [ranked, documents]}
- {name: result, use: select, with: {columns: {query_id: query_id, doc_id: doc_id, score: "round(score, 6)", n_hits: n_hits, lang: lang, source: source, n_chars: n_chars}}}
- {name: ordered, use: ordered, with: {greater_is_closer: true}}
"""


def _tables(spark: SparkSession) -> tuple:
    return spark.read.parquet(f"{SF}/embeddings.parquet"), spark.read.parquet(f"{SF}/documents.parquet")


def test_search_from_yaml(spark: SparkSession) -> None:
    assert steps and len(REGISTRY) > 50
    embeddings, documents = _tables(spark)
    flow = Flow.from_yaml(SEARCH)
    assert differences(flow.run(embeddings, documents=documents), catalogue.ORACLES["search_documents"], SF) == ""
    again = Flow.from_yaml(flow.to_yaml())
    assert again == flow and again.to_config() == flow.to_config()
    assert eval(flow.to_code(), {"Flow": Flow}) == flow
    with pytest.raises(ValueError, match="no source documents"):
        flow.run(embeddings)
    with pytest.raises(ValueError):
        flow.source("documents")
    with pytest.raises(ValueError, match="not registered"):
        Flow().add("x", lambda x: x).to_config()


def test_training_and_index_and_query(spark: SparkSession, tmp_path: Path) -> None:
    embeddings, _ = _tables(spark)
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    flow = Flow().use("pca", "principal_components", dims=8)
    with pytest.raises(ValueError, match="trained"):
        flow.run(rows)
    trained = flow.train(rows)
    assert len(trained.run(rows).first().vector) == 8
    path = str(tmp_path / "index")
    half = F.col("id") % 2 == 0
    trained.index(path, rows.where(half))
    trained.index(path, rows.where(~half))  # adds to what is there
    asking = trained.source("index").use("near", "nearest", after=("pca", "index"), k=3, metric="l2")
    got = asking.query(path, rows.where("id < 5"))
    first = {r.query_id: (r.id, r.distance) for r in got.where("rank = 1").collect()}
    assert first == {k: (k, 0.0) for k in range(5)} and got.count() == 15
    x = np.array([r.vector for r in rows.orderBy("id").collect()])
    model = encode.PrincipalComponents.fit(rows.select("vector"), 8)
    assert np.allclose(trained.run(rows.where("id = 3")).first().vector, model.matrix(x[3:4])[0])


def test_templates(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "doc_id long, text string")
    flow = index_flow()
    assert flow.edges() == '{"doc_idx": ["prep"], "enc": ["prep"], "prep": ["source"], "sync": ["vec_idx", "doc_idx"], "vec_idx": ["enc"]}'
    assert [n.kind for _, n in flow.nodes] == ["preprocessor", "encoder", "indexer", "indexer", "router"]
    with pytest.raises(NotImplementedError):
        flow.run(docs)
    own = flow.set("prep", split.sentences).set("enc", steps.hashed_vectors()).set("vec_idx", lambda x: x.select("doc_id", "offset", "vector")).set("doc_idx", lambda x: x.select("doc_id", "offset", "weight")).set("sync", steps.join(["doc_id", "offset"]))
    assert own == flow and own.ending_at("sync").run(docs).count() == 3
    # an index flow becomes a query flow in two ways, with the same edges
    one = flow.remove("sync").set("doc_idx", after="vec_idx")
    two = flow.remove("sync").remove("doc_idx").add_indexer("doc_idx", lambda x: x, after="vec_idx")
    assert one == two.ending_at("doc_idx") or one.edges() == two.edges()
    assert query_flow() != index_flow() and list(dict(query_flow().nodes)) == ["prep", "enc", "vec_idx", "scorer", "doc_idx"]


def test_modules_of_the_user(spark: SparkSession, tmp_path: Path) -> None:
    path = tmp_path / "own_steps_for_test.py"
    path.write_text("from quillon.plans.flow import register\n\n@register('twice')\ndef twice(column):\n    return lambda rows: rows.withColumn(column, rows[column] * 2)\n")
    extend.use_module(spark, str(path))
    assert Flow().use("a", "twice", column="id").run(spark.range(3)).agg({"id": "sum"}).first()[0] == 6
    (tmp_path / "broken_for_test.py").write_text("1 / 0")
    with pytest.raises(ZeroDivisionError):
        extend.use_module(spark, str(tmp_path / "broken_for_test.py"))
    with pytest.raises(ValueError):
        extend.use_module(spark, str(tmp_path / "not a name.py"))


def test_batches_and_hooks(spark: SparkSession) -> None:
    sizes = lambda t: pa.table({"n": pa.array([t.num_rows], pa.int64()), "s": pa.array([sum(t["id"].to_pylist())], pa.int64())})
    got = sorted(tuple(r) for r in extend.batched(sizes, 4, "n long, s long")(spark.range(0, 10, 1, 1)).collect())
    assert got == [(2, 17), (4, 6), (4, 22)]
    with pytest.raises(ValueError):
        extend.batched(sizes, 0, "n long")
    seen: list = []
    step, metrics = extend.counted(lambda x: x.where("id > 2"), "kept", F.count("*").alias("n"))
    flow = Flow().add("a", extend.hooked(step, lambda x: seen.append(x.columns), lambda x: seen.append("done")))
    assert flow.run(spark.range(5)).count() == 2 and seen == [["id"], "done"] and metrics.get == {"n": 2}


def test_progress_of_a_stream(spark: SparkSession) -> None:
    import time

    seen: list = []
    listener = extend.Progress(lambda name, text: seen.append(name))
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 2).load().writeStream.queryName("watched").format("noop").trigger(availableNow=True).start()
        q.processAllAvailable()
        q.stop()
        for _ in range(50):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert "watched" in seen


def test_training_waits_for_the_flush(spark: SparkSession, tmp_path: Path) -> None:
    from quillon.sources import documents as sources
    from quillon.streaming.barrier import TrainOnFlush

    requests = sources.train_requests(spark.range(10).withColumnRenamed("id", "doc_id"), 4)
    trainer = TrainOnFlush(str(tmp_path / "rows"), lambda rows: rows.agg(F.sum("doc_id")).first()[0])
    for k in range(3):
        trainer(requests.where(F.col("request_id") == k), k)
        trainer(requests.where(F.col("request_id") == k), k)  # repeated after a failure
    assert trainer.status == "pending" and trainer.model is None
    trainer(requests.where("flush"), 3)
    assert trainer.status == "success" and trainer.model == 45
    assert sorted(tuple(r) for r in sources.train_requests(spark.range(0).withColumnRenamed("id", "doc_id"), 4).collect()) == [(None, 0, True)]
