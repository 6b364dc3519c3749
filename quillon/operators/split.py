"""Documents to chunks: table functions from text, JSON and raw bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import spread

DELIMITERS = ".!?。！？"


def _class(delimiters: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in delimiters)


def _found(text: Column, delimiters: str) -> Column:
    """The pieces, each with the delimiters before it, of the part of a text that pieces fill.

    What follows the last piece is cut first: a search for the next piece would run to the end of the text from each of its characters.
    """
    d = _class(delimiters)
    head = F.regexp_extract(text, f"(?s)^.*[^{d}][{d}]", 0)
    return F.regexp_extract_all(head, F.lit(f"[{d}]*+[^{d}]++[{d}]"), F.lit(0))


def _pieces(docs: DataFrame, delimiters: str, key: str, text: str) -> DataFrame:
    """(doc_id, all, whole, offset, p): the pieces of each text, or the text itself (`whole`) where it has none, and the text's length."""
    # the text's length is taken before its pieces become rows, so that no row carries the text
    cut = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("t"))).select("doc_id", "t", F.length("t").alias("all"), _found(F.col("t"), delimiters).alias("found"))
    none = F.size("found") == 0
    return cut.select("doc_id", "all", none.alias("whole"), F.posexplode(F.when(none, F.array("t")).otherwise(F.col("found"))).alias("offset", "p"))


def _body(delimiters: str) -> Column:
    """A piece without the delimiters before it; a text that is no piece as it is."""
    return F.when(F.col("whole"), F.col("p")).otherwise(F.ltrim(F.col("p"), F.lit(delimiters)))


def cleaned(piece: Column) -> Column:
    """A piece without characters that don't print in ASCII, its line ends as blanks, trimmed."""
    printing = F.regexp_replace(piece, r"[^\x20-\x7E\t\n\r\x0B\x0C]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(printing, r"\n+", " "), r"^[\s\x0B]+", ""), r"[\s\x0B]+$", "")


def sentences(docs: DataFrame, min_len: int = 1, max_len: int = 256, delimiters: str = DELIMITERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, offset, text, weight): pieces that end with a delimiter.

    A text without any delimiter is one piece; what stands after the last delimiter goes. Pieces of
    at most min_len characters after cleaning are dropped, but count for `offset`. The weight is the
    share of the text that the cleaned and cut piece has.
    """
    each = _pieces(docs, delimiters, key, text).select("doc_id", "offset", "all", cleaned(_body(delimiters)).alias("f"))
    out = each.where(F.length("f") > min_len).withColumn("text", F.substring("f", 1, max_len))
    return out.select("doc_id", "offset", "text", (F.length("text") / F.col("all")).alias("weight"))


def sentence_places(docs: DataFrame, delimiters: str = DELIMITERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, offset, start, end): where each piece stands in its text; ids are taken to be unique."""
    each = _pieces(docs, delimiters, key, text).select("doc_id", "offset", F.length("p").alias("n"), F.length(_body(delimiters)).alias("own"))
    end = F.sum("n").over(Window.partitionBy("doc_id").orderBy("offset"))
    return each.select("doc_id", "offset", (end - F.col("own")).alias("start"), end.alias("end"))


def json_documents(docs: DataFrame, column: str = "json", content: str = "Content") -> DataFrame:
    """The text under `content` as `text`, and the other members as JSON in `meta_info`; a missing member is an error."""
    fields = F.from_json(F.col(column), "map<string,string>")
    text = F.coalesce(F.get_json_object(F.col(column), f"$.{content}"), F.raise_error(F.lit(f"no member {content}")).cast("string"))
    rest = F.map_filter(fields, lambda k, _: k != content)
    entries = F.map_from_entries(F.array_sort(F.map_entries(rest)))
    return docs.withColumn("text", text).withColumn("meta_info", F.to_json(entries))


def unary(docs: DataFrame, key: str = "doc_id", raw: str = "raw") -> DataFrame:
    """(doc_id, offset, text, weight): each document as one chunk; its bytes must be UTF-8."""
    return docs.select(F.col(key).alias("doc_id"), F.lit(0).alias("offset"), F.decode(F.col(raw), "utf-8").alias("text"), F.lit(1.0).alias("weight"))


def chain(docs: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps one after the other; none at all is an error."""
    if not steps:
        raise NotImplementedError("a chain needs at least one step")
    for step in steps:
        docs = docs.transform(step)
    return docs


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """(num_docs, num_chunks) over chunks with a doc_id."""
    return chunks.agg(F.countDistinct("doc_id").alias("num_docs"), F.count("*").alias("num_chunks"))


def chunks_in_doc(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
