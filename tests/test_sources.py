from __future__ import annotations

import datetime as dt
import math

import pytest

from statelattice import cli
from statelattice.operators.emissions import Discrete, Gamma, Gaussian, NegativeBinomial, VonMises
from statelattice.operators.model import Hmm
from statelattice.operators.multivariate import DiagonalGaussian, FullCovarianceGaussian, IndependentComponents
from statelattice.plans import catalogue
from statelattice.sources import model_json, model_text, sequences

SCALAR = Hmm((0.75, 0.25), ((0.875, 0.125), (0.25, 0.75)), (Gaussian(0, 1), Gaussian(2.5, 0.5)))
VECTOR = Hmm.uniform([IndependentComponents((Gamma(1, 2), VonMises(0, 1))), IndependentComponents((Gamma(3, 2), VonMises(1, 1)))])


@pytest.mark.parametrize("model", [SCALAR, VECTOR, Hmm.uniform([DiagonalGaussian((1, 2), (3, 4))]), Hmm.uniform([FullCovarianceGaussian((1, 2), ((3, 1), (1, 4)))]), *(Hmm.uniform([e]) for e, _ in catalogue.CASES.values())])
def test_json_round_trip(model, tmp_path):
    assert model_json.from_json(model_json.to_json(model)) == model
    model_json.save(model, tmp_path / "m.json")
    assert model_json.load(tmp_path / "m.json") == model


def test_json_layout():
    assert model_json.to_json(SCALAR).startswith('{"states":2,"pi":[0.75,0.25],"trans":[[0.875,0.125],[0.25,0.75]],"distributions":[{"type":"Gaussian","mu":')
    assert model_json.from_json(model_json.to_json(VECTOR, "writer_version")) == VECTOR


@pytest.mark.parametrize(
    "text",
    [
        "", "[]", "{}", '{"pi":[1],"states":1,"trans":[[1]],"distributions":[]}', '{"states":1,"pi":[1],"trans":[[1]],"distributions":[{"type":"Nope"}]}',
        '{"states":2,"pi":[1],"trans":[[1]],"distributions":[{"type":"Gaussian","mu":0,"sigma":1}]}', '{"states":1,"pi":[1],"trans":[[1]],"distributions":[{"type":"Gaussian","sigma":1,"mu":0}]}',
        '{"states":1,"pi":[NaN],"trans":[[1]],"distributions":[{"type":"Gaussian","mu":0,"sigma":1}]}', '{"states":1,"pi":[1],"trans":[[1]],"distributions":[{"type":"Gaussian","mu":0,"sigma":-1}]}',
        '{"states":5000,"pi":[1],"trans":[[1]],"distributions":[]}', '{"states":1,"states":1,"pi":[1],"trans":[[1]]}',
        '{"x_version":"4","obs_type":"multivariate","dimensions":3,"states":1,"pi":[1],"trans":[[1]],"distributions":[{"type":"DiagonalGaussian","dim":1,"mean":[0],"var":[1]}]}',
    ],
)
def test_malformed_json(text):
    with pytest.raises((ValueError, TypeError)):
        model_json.from_json(text)


def test_size_limit_and_non_finite():
    with pytest.raises(ValueError):
        model_json.from_json(" " * (10 * 1024 * 1024 + 1))
    with pytest.raises(ValueError):
        model_json.to_json(SCALAR.replace(pi=(math.nan, 1.0)))


@pytest.mark.parametrize("e", [e for e, _ in catalogue.CASES.values()], ids=lambda e: e.tag)
def test_text_and_xml_round_trip(e):
    model = Hmm((0.5, 0.5), ((0.25, 0.75), (1.0, 0.0)), (e, e))
    for back in (model_text.from_text(model_text.to_text(model)), model_text.from_xml(model_text.to_xml(model))):
        assert back.trans == model.trans
        for k, v in e.params().items():
            assert back.emissions[0].params()[k] == pytest.approx(v, rel=1e-5)


def test_malformed_text():
    for text in ("", "<a>", "<a><![CDATA[nothing]]></a>", "<!DOCTYPE a><a/>"):
        with pytest.raises(ValueError):
            model_text.from_xml(text)
    two_words = model_text.to_text(Hmm.uniform([NegativeBinomial(3, 0.5)])).replace("NegativeBinomial", "Negative Binomial")
    assert model_text.from_text(two_words).emissions[0] == NegativeBinomial(3, 0.5)


def test_models_table(spark, tmp_path):
    models = {"a": SCALAR, "b": VECTOR}
    model_json.models_table(spark, models).write.parquet(str(tmp_path / "models"))
    assert model_json.from_table(spark.read.parquet(str(tmp_path / "models"))) == models


def test_sequences_are_ordered_and_skip_nulls(spark):
    rows = spark.createDataFrame([(1, 3, 30.0), (1, 1, 10.0), (2, 1, None), (None, 1, 1.0), (1, 2, 20.0), (2, 2, 5.0)], "k int, o int, v double")
    from pyspark.sql import functions as F

    found = {r["seq_id"]: r["xs"] for r in sequences.to_sequences(rows, "k", ["o"], F.col("v")).collect()}
    assert found == {1: [10.0, 20.0, 30.0], 2: [5.0]}
    assert sequences.to_steps(sequences.to_sequences(rows, "k", ["o"], F.col("v"))).count() == 4


def test_gaps_angles_and_symbols(spark):
    at = lambda h, s: dt.datetime(2024, 1, 1, h, 0, s)
    rows = spark.createDataFrame([(1, 1, at(0, 0), "view"), (1, 2, at(12, 30), "odd"), (2, 3, at(1, 0), "click")], "k int, id int, ts timestamp, e string")
    assert [r["gap"] for r in sequences.gaps(rows, "k", "ts", "id").collect()] == [12 * 3600 + 30.0]
    out = rows.select("id", sequences.day_angle("ts").alias("a"), sequences.symbols("e", sequences.EVENT_TYPES).alias("s")).orderBy("id").collect()
    assert out[0]["a"] == pytest.approx(math.pi) and out[1]["a"] == pytest.approx(30 * 2 * math.pi / 86400)
    assert [r["s"] for r in out] == [4.0, None, 0.0]


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("key,obs_idx,f0,f1\na,1,2.5,1\na,0,1.5,0\nb,0,7,9\n")
    one = {r["seq_id"]: r["xs"] for r in sequences.read_csv_sequences(spark, str(tmp_path / "x.csv"), "key", "obs_idx", ["f0"]).collect()}
    assert one == {"a": [1.5, 2.5], "b": [7.0]}
    two = {r["seq_id"]: r["xs"] for r in sequences.read_csv_sequences(spark, str(tmp_path / "x.csv"), "key", "obs_idx", ["f0", "f1"]).collect()}
    assert two["a"] == [[1.5, 0.0], [2.5, 1.0]]


def test_model_rules():
    assert Hmm.blank().states == 4
    with pytest.raises(ValueError):
        Hmm.blank(0)
    with pytest.raises(ValueError):
        Hmm((0.5, 0.5), ((1.0,),), (Gaussian(),))
    with pytest.raises(ValueError):
        Hmm.uniform([Gaussian(), DiagonalGaussian((0,), (1,))])
    with pytest.raises(ValueError):
        Hmm.blank(2).require_initialized()
    with pytest.raises(ValueError):
        Hmm((0.5, 0.6), ((1, 0), (0, 1)), (Gaussian(),) * 2).validate()
    assert SCALAR.clone() == SCALAR


def test_cli(tmp_path, capsys):
    model_json.save(Hmm((0.75, 0.25), ((0.875, 0.125), (0.25, 0.75)), (Discrete((1 / 6,) * 6), Discrete((0.125,) * 5 + (0.375,)))), tmp_path / "m.json")
    assert cli.main([str(tmp_path / "m.json"), "0", "1", "5", "4", "2"]) == 0
    assert "-9.005206" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main([str(tmp_path / "bad.json")]) == 1
    model_text.save_xml(SCALAR, tmp_path / "m.xml")
    assert cli.main([str(tmp_path / "m.xml")]) == 0
