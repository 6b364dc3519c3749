"""Where documents come from and where they are kept."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.reduce import ordinals
from quillon.session import Scratch

SNOWFLAKE_EPOCH_MS = 1_546_300_800_000  # 2019-01-01


def text_lines(spark: SparkSession, path: str, keep_newline: bool = False) -> DataFrame:
    """(raw): one document a line."""
    line = F.concat("value", F.lit("\n")) if keep_newline else F.col("value")
    return spark.read.text(path).select(F.encode(line, "utf-8").alias("raw"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, raw): one document for each file in each archive, archives being read in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([name]), pa.array([z.read(name)], pa.binary())], ["path", "name", "raw"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, raw binary")


def bytes_rows(spark: SparkSession, items: Iterable[bytes], size: int = 10_000) -> DataFrame:
    """(seq, raw) of byte strings from the driver, in their order.

    They are written in pieces of `size` to the shared folder, so that the driver holds one piece at a time however long the iterator.
    """
    schema, scratch, paths, piece, n = "seq long, raw binary", Scratch(spark), [], [], 0

    def write() -> None:
        paths.append(scratch.write(spark.createDataFrame([(n - len(piece) + k, bytearray(x)) for k, x in enumerate(piece)], schema), "bytes"))
        piece.clear()

    for x in items:
        piece.append(x)
        n += 1
        if len(piece) == size:
            write()
    if piece or not paths:
        write()
    return spark.read.schema(schema).parquet(*paths)


def numbered(docs: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Documents with dense ids from `start`, in the order of a column of whole numbers, and weight 1."""
    return ordinals(docs, order, start).withColumnRenamed("ordinal", "doc_id").withColumn("weight", F.lit(1.0))


def request_batches(docs: DataFrame, size: int, order: str = "doc_id") -> DataFrame:
    """The rows with request_id from 0, `size` to a request."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    return ordinals(docs, order).withColumn("request_id", F.floor(F.col("ordinal") / size)).drop("ordinal")


def train_requests(docs: DataFrame, size: int, order: str = "doc_id") -> DataFrame:
    """The rows with request_id from 0, `size` to a request, and a last request of one row of nulls that says `flush`."""
    rows = request_batches(docs, size, order).withColumn("flush", F.lit(False))
    last = rows.agg((F.coalesce(F.max("request_id"), F.lit(-1)) + 1).alias("request_id"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]
    return rows.unionByName(last.select(*nulls, "request_id", F.lit(True).alias("flush")))


def query_rows(docs: DataFrame, top_k: int) -> DataFrame:
    """Each document as a query with its own top_k."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    return docs.withColumn("top_k", F.lit(top_k))


def snowflake(millis: Column, counter: Column, machine: Column | int, datacentre: int = 0) -> Column:
    """Ids of time, datacentre, machine and counter: (ms since 2019) << 22 | datacentre << 17 | machine << 12 | counter."""
    m = F.lit(machine) if isinstance(machine, int) else machine
    since = (millis - F.lit(SNOWFLAKE_EPOCH_MS)).cast("long")
    return F.shiftleft(since, 22).bitwiseOR(F.lit(datacentre << 17).cast("long")).bitwiseOR(F.shiftleft(m.cast("long"), 12)).bitwiseOR(counter.cast("long") % 4096)


class DocumentStore:
    """Documents by id as Parquet: written with columns left out, fetched by a join, scanned in order.

    A later write of an id replaces the earlier one when read. Each write is a folder of its own, so
    that a failed one leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.drop = spark, path.rstrip("/"), drop

    def add(self, docs: DataFrame, version: int) -> None:
        docs.drop(*self.drop).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def versions(self) -> list[int]:
        """The versions there are, from the names of their folders."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [x.getPath().getName() for x in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def read(self) -> DataFrame:
        """The newest row of each id. One version is read as it is; of several, ids and versions alone are compared."""
        versions = self.versions()
        docs = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        columns = [c for c in docs.columns if c != "version"]
        if len(versions) == 1:
            return docs.select(*columns)
        newest = docs.groupBy("doc_id").agg(F.max("version").alias("version"))
        return docs.join(newest, ["doc_id", "version"]).select(*columns)

    def fetch(self, ids: DataFrame, keep_missing: bool = True) -> DataFrame:
        return ids.join(self.read(), "doc_id", "left" if keep_missing else "inner")

    def scan(self, reverse: bool = False) -> DataFrame:
        return self.read().orderBy(F.col("doc_id").desc() if reverse else F.col("doc_id").asc())


def write_chunk_files(chunks: DataFrame, path: str) -> None:
    """Chunks (doc_id, offset, ...) as Parquet in a folder for each range of ids, sorted by id and offset in it.

    A folder for each document would be millions of small files, so that ids are gathered by thousands.
    """
    gathered = chunks.withColumn("shard", F.floor(F.col("doc_id") / 1000))
    gathered.repartitionByRange("shard").sortWithinPartitions("shard", "doc_id", "offset").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_chunk_files(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """All chunks, or those of one document, of which only its folder is read."""
    chunks = spark.read.parquet(path)
    return (chunks if doc_id is None else chunks.where((F.col("shard") == doc_id // 1000) & (F.col("doc_id") == doc_id))).drop("shard")


def write_routes(routes: DataFrame, path: str) -> None:
    """Route records as JSON lines."""
    routes.write.mode("append").json(path)
