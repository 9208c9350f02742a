from __future__ import annotations

import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statelattice.llm import queries
from statelattice.llm.common import BATCH_BYTES, materialize, scratch
from statelattice.llm.near_dedup import near_duplicates

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secrets", "mixing", "bpe"]


def test_each_stage_takes_effect(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(i, " ".join(words[i : i + 60]), "en", f"s{i % 2}", 0) for i in range(0, 60, 3)]
    rows += [(100, rows[0][1], "en", "s0", 0), (100, rows[0][1], "en", "s0", 0), (101, None, None, None, None), (102, "123 !", "en", "s1", 5)]
    rows += [(103, 'see token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there and some more words', None, None, 1), (0, rows[0][1], "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "test")
        assert docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes, name
        kept.append({r["doc_id"]: r for r in docs.collect()})
    assert not {101, 102} & set(kept[0]) and kept[0][103]["lang"] is not None
    assert 100 not in kept[1] and 0 in kept[1]
    assert "04dbebab" not in kept[2][103]["text"] and kept[2][103]["n_chars"] == len(kept[2][103]["text"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert out.count() == docs.count()
    assert corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, SCHEMA), "").where("doc_id = 0").count() == 1


def test_run_equals_its_parts(spark):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(DATA)).cache()
    ids = {r["doc_id"] for r in out.collect()}
    groups = near_duplicates(docs).where("kept").select("doc_id")
    assert ids <= {r["doc_id"] for r in groups.collect()}
    total = docs.join(groups, "doc_id").count()
    assert len(ids) > 0.8 * total
    assert out.where(F.sha2("ids", 256) != F.col("ids_sha256")).count() == 0
    assert hashlib.sha256(bytes(out.first()["ids"])).hexdigest() == out.first()["ids_sha256"]


def test_empty_pipeline(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "empty")
    assert docs.count() == 0


#: Prints MB before a task, with its buffers, and after it.
TASK = """
import re
import pyarrow as pa
from statelattice.llm.common import lean

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

def fill(batches):
    for _ in batches:
        held = [pa.array([bytes(1 << 18)]) for _ in range(1000)]
        yield resident()

before = resident()
print(before, *lean(fill)([None]), resident())
"""


def test_workers_give_memory_back():
    if not Path("/proc/self/status").exists():
        pytest.skip("no /proc")
    out = subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, check=True, cwd=Path(corpus_pipeline.__file__).parent).stdout
    before, full, after = map(int, out.split())
    assert full > before + 200 and after < before + 50


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "secrets", "bpe"])
def test_stages_keep_batches_small(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, f"some words {i} " * 2000, "en", "s", 1) for i in range(600)], SCHEMA).coalesce(1)
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["b"])

    def largest():
        return max(r["b"] for r in docs.mapInArrow(sizes, "b long").collect())

    try:
        spark.conf.set(key, "64m")
        assert largest() > 2 * BATCH_BYTES
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(5), "")
        assert largest() < 1.5 * BATCH_BYTES
        spark.conf.set(key, "64k")  # a lower limit stays
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(5), "")
        assert spark.conf.get(key) == "64k"
    finally:
        spark.conf.set(key, before)


def test_clashing_columns(spark):
    rows = [(i, " ".join(f"w{i}x{k % 50}" for k in range(300)), "en", f"s{i % 2}", 1, 7, 8, "t", 9, "p") for i in range(12)]
    wide = SCHEMA + ", size int, taken int, tie string, copies int, parts string"
    docs = spark.createDataFrame(rows, wide)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "clash")
        assert docs.dtypes == spark.createDataFrame([], wide).dtypes, name
        assert docs.count() and docs.where("size <> 7 OR taken <> 8 OR tie <> 't'").isEmpty()


def test_scratch_tables_go(spark):
    with scratch(spark) as kept:
        gone = materialize(spark.range(3), "gone")
        stays = materialize(spark.range(4), "stays", kept)
    assert stays.count() == 4 and not Path(gone.inputFiles()[0].removeprefix("file:")).exists()


#: The columns that each query returns at least.
RETURNED = {
    "op1_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_top_k": "query_id bigint, rank int, vec_id bigint, distance int",
    "op6_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_chat": "conv_id bigint, n_turns bigint, kept boolean, chat_md5 string",
    "op8_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.mark.parametrize("name", RETURNED)
def test_queries_return_their_columns(spark, tmp_path, name):
    texts = [None, "", "some words here, and more of them", "some words here, and more of them", "x" * 30_000, "é 漢"]
    docs = spark.createDataFrame([(i if i < 5 else None, t, "en", "s", 3) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 * i, [float(i - k) for k in range(64)], 1) for i in range(3)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", None)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.QUERIES[name](spark, str(tmp_path))
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in RETURNED[name].split(", "))} == {c: k for c, k in (x.split() for x in RETURNED[name].split(", "))}
    rows = out.collect()
    assert len(rows) == {"op5_top_k": 9, "op7_chat": 2}.get(name, len(texts))


def test_queries_cover_the_operators():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
