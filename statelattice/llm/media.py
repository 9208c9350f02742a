"""Media columns: texts as 8-bit sample payloads in a content-defined chunk store."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_store import described_items, gear_cuts, read_back, write_store
from .common import join_spread

#: A payload is padded to a positive multiple of this.
ALIGN = 64


def _features(data: bytes, recipe: bytes) -> tuple:
    """Figures of the samples as read back; the stored form is the manifest followed by the chunks it lists."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    mean, power = x.sum() / len(x), (x * x).sum() / len(x)
    histogram = np.bincount(x >> 5, minlength=8)
    feature = f"mean={mean:.3f};rms={power**0.5:.3f};crossings={int((np.diff(x > mean) != 0).sum())};octants={':'.join(map(str, histogram.tolist()))}"
    stored = hashlib.sha256(recipe)
    stored.update(data)
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ALIGN:]), len(recipe) + len(data), stored.hexdigest(), feature


_VALUES = [
    ("payload_bytes", "long", pa.int64()),
    ("payload_sha256", "string", pa.string()),
    ("tail_crc32", "long", pa.int64()),
    ("media_bytes", "long", pa.int64()),
    ("media_sha256", "string", pa.string()),
    ("feature", "string", pa.string()),
]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.

    The payload is the UTF-8 text and zero bytes up to a positive multiple of 64 (null and empty texts: 64
    zeros). It is stored as chunks that gear hashing cuts, each distinct chunk once; all figures but n_bytes come
    from the bytes read back and verified. Equal texts have equal values. Rows with null or repeated ids, and equal
    rows, are items like others. Very long texts are many chunks of one item, and one item must fit into a task. An
    empty table gives an empty result; other columns, whatever their names, aren't read.
    """
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    padding = F.when(n == 0, ALIGN).otherwise(F.pmod(-n, F.lit(ALIGN)))
    payload = F.concat(raw, F.substring(F.lit(bytes(ALIGN)), F.lit(1), padding))
    # n_bytes isn't a function of the payload (a text may end in zero bytes), so it goes into the recipe
    items = docs.select(F.col(id_col).cast("long").alias("key"), n.cast("long").alias("note"), payload.alias("data"))
    store, spark = write_store(described_items(items, gear_cuts), "media"), docs.sparkSession
    recipes = store.recipes(spark).select(F.col("key").alias("doc_id"), F.col("note").alias("n_bytes"), "sha", "file", "place")
    values = read_back(store, spark, _features, _VALUES)
    return join_spread(recipes, values, "sha").select("doc_id", "n_bytes", *(c[0] for c in _VALUES))
