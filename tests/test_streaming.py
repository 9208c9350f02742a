from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from statelattice.operators import inference, sampling
from statelattice.operators.emissions import Gaussian
from statelattice.operators.model import Hmm
from statelattice.streaming.filtering import filter_stream

MODEL = Hmm((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), (Gaussian(0, 1), Gaussian(4, 2)))


def test_filter_ends_at_the_batch_likelihood(spark, tmp_path):
    drawn = sampling.sample(spark, MODEL, 3, 8, seed=1).collect()
    start = dt.datetime(2024, 1, 1)
    rows = [(r["seq_id"], start + dt.timedelta(seconds=t), x) for r in drawn for t, x in enumerate(r["xs"])]
    schema = "seq_id long, ts timestamp, x double"
    for part in range(2):  # two files: two micro-batches
        half = [r for r in rows if (r[1] - start).seconds // 4 == part]
        spark.createDataFrame(half, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = filter_stream(stream, MODEL).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    last = {r["seq_id"]: r["logp"] for r in spark.sql("SELECT * FROM filtered WHERE n = 8").collect()}
    batch = spark.createDataFrame([(r["seq_id"], r["xs"]) for r in drawn], "seq_id long, xs array<double>")
    for r in inference.score(batch, MODEL).collect():
        assert last[r["seq_id"]] == pytest.approx(r["logp"], abs=1e-9)
    assert np.isfinite([r["probability"] for r in spark.sql("SELECT probability FROM filtered").collect()]).all()
