"""Model files in JSON, scalar and multivariate, and model tables."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.emissions import Emission, family
from ..operators.model import Hmm

# Limits and keys of the file format.
MAX_BYTES = 10 * 1024 * 1024
MAX_STATES = 4096
SCALAR_KEYS = ["states", "pi", "trans", "distributions"]
VECTOR_KEYS = ["obs_type", "dimensions", *SCALAR_KEYS]
VERSION = "4"
#: The first key of a multivariate file is the writer's name for its version: any that ends so is read.
VERSION_KEY = "model_version"


def _ordered(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key appears twice")
    return out


def _constant(name: str) -> float:
    raise ValueError(f"{name} isn't a number here")


def _finite(value: Any) -> None:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a model with values that aren't finite can't be saved")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _finite(v)


def to_json(model: Hmm, version_key: str = VERSION_KEY) -> str:
    """The model as one line; doubles in their shortest exact form. version_key names the first key of a multivariate
    model, for readers that expect one of their own."""
    body: dict[str, Any] = {"states": model.states, "pi": list(model.pi), "trans": [list(r) for r in model.trans], "distributions": [e.to_dict() for e in model.emissions]}
    if model.multivariate:
        body = {version_key: VERSION, "obs_type": "multivariate", "dimensions": model.dim} | body
    _finite(body)
    return json.dumps(body, separators=(",", ":"))


def from_json(text: str | bytes) -> Hmm:
    """Reads what to_json writes: keys in this order, limits on size, and every emission of the stated dimension."""
    if len(text if isinstance(text, bytes) else text.encode()) > MAX_BYTES:
        raise ValueError("the model is larger than 10 MB")
    body = json.loads(text, object_pairs_hook=_ordered, parse_constant=_constant)
    if not isinstance(body, dict):
        raise ValueError("a model is a JSON object")
    first = next(iter(body), "")
    vector = first.endswith("_version")
    if (list(body)[1:] if vector else list(body)) != (VECTOR_KEYS if vector else SCALAR_KEYS):
        raise ValueError(f"expected the keys {VECTOR_KEYS if vector else SCALAR_KEYS} in this order, got {list(body)}")
    if vector and (body[first] != VERSION or body["obs_type"] != "multivariate"):
        raise ValueError("unsupported version or observation type")
    n = body["states"]
    if not (isinstance(n, int | float) and n == int(n) and 1 <= n <= MAX_STATES):
        raise ValueError(f"states must be from 1 to {MAX_STATES}")
    emissions = tuple(emission(d) for d in body["distributions"])
    if len(body["pi"]) != n or len(emissions) != n:
        raise ValueError("states doesn't fit pi and distributions")
    model = Hmm(tuple(body["pi"]), tuple(map(tuple, body["trans"])), emissions)
    if model.multivariate != vector:
        raise ValueError("scalar and multivariate emissions have different files")
    if vector and model.dim != body["dimensions"]:
        raise ValueError(f"emissions have dimension {model.dim}, the file says {body['dimensions']}")
    return model


def emission(values: dict[str, Any]) -> Emission:
    if next(iter(values), None) != "type":
        raise ValueError("an emission starts with its type")
    return family(values["type"]).from_dict(values)


def save(model: Hmm, path: str | Path) -> None:
    Path(path).write_text(to_json(model))


def load(path: str | Path) -> Hmm:
    return from_json(Path(path).read_bytes())


def models_table(spark: SparkSession, models: dict[str, Hmm]) -> DataFrame:
    """(model_id, states, multivariate, body): models as rows, to be kept in any format that Spark writes."""
    rows = [(name, m.states, m.multivariate, to_json(m)) for name, m in models.items()]
    return spark.createDataFrame(rows, "model_id string, states int, multivariate boolean, body string")


def from_table(table: DataFrame) -> dict[str, Hmm]:
    return {r["model_id"]: from_json(r["body"]) for r in table.select("model_id", "body").collect()}
