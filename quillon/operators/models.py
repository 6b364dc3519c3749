"""Fitted encoders on storage: one JSON document a model, written and read through Spark so that any shared file system will do."""

from __future__ import annotations

import json
from dataclasses import fields

import numpy as np
from pyspark.sql import SparkSession

from quillon.operators import encode

KINDS = {k.__name__: k for k in (encode.Standardiser, encode.PrincipalComponents, encode.ProductQuantiser, encode.Hasher)}


def _plain(x: object) -> object:
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _full(x: object) -> object:
    if isinstance(x, dict):
        return np.array(x["array"], float)
    return [_full(v) for v in x] if isinstance(x, list) else x


def save(spark: SparkSession, model: object, path: str) -> None:
    """Writes a fitted encoder, over what is there."""
    kind = type(model).__name__
    if kind not in KINDS:
        raise ValueError(f"{kind} can't be saved")
    text = json.dumps({"kind": kind, "values": {f.name: _plain(getattr(model, f.name)) for f in fields(model)}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> object:
    """The encoder as it was saved; only the known kinds are made."""
    stored = json.loads(spark.read.text(path).first()[0])
    return KINDS[stored["kind"]](**{k: _full(v) for k, v in stored["values"].items()})
