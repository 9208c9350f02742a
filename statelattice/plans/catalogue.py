"""The registered queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Reals are rounded to six places on both sides, and minus infinity is shown as NEVER.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, kmeans, sampling, selection, training
from ..operators.emissions import (
    Beta,
    Binomial,
    ChiSquared,
    Discrete,
    Emission,
    Exponential,
    Gamma,
    Gaussian,
    LogNormal,
    NegativeBinomial,
    Pareto,
    Poisson,
    Rayleigh,
    StudentT,
    Uniform,
    VonMises,
    Weibull,
    columns_of,
    fit_column,
)
from ..operators.model import Hmm
from ..operators.multivariate import DiagonalGaussian, FullCovarianceGaussian, IndependentComponents
from ..operators.topology import Topology, enforce, initialize
from ..functions import linalg, special
from ..sources import model_json, model_text
from ..sources.sequences import day_angle, event_sequences, gaps, order_sequences
from .numeric_sql import CDF, FITS, MOMENTS, fit_sql, num

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NEVER = -1e9


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def r6(c: Column) -> Column:
    return F.when(c == F.lit(-math.inf), F.lit(NEVER)).otherwise(F.round(c, 6) + F.lit(0.0))


def s6(sql: str) -> str:
    return f"CASE WHEN ({sql}) = CAST('-Infinity' AS DOUBLE) THEN {NEVER} ELSE round({sql}, 6) + 0.0 END"


# -- models of the queries -------------------------------------------------------------------------------------

#: Two regimes of ln(1 + value) in the events table.
MODEL = Hmm((0.6, 0.4), ((0.85, 0.15), (0.25, 0.75)), (Gaussian(2.2, 0.9), Gaussian(4.1, 0.7)))
#: Two regimes of event types.
TYPES = Hmm((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), (Discrete((0.3, 0.05, 0.1, 0.15, 0.4)), Discrete((0.15, 0.35, 0.2, 0.2, 0.1))))


def _steps_sql(model: Hmm, what: str = "log_value") -> str:
    """o: observations of the events table in order; e: their log-densities b0, b1."""
    x = {
        "log_value": "ln(value + 1)",
        "type": "CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS DOUBLE)",
    }[what]
    b = [LOGPDF[e.tag](e, "x") for e in model.emissions]
    return f"""o AS (SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, {x} AS x FROM events),
z AS (SELECT seq_id, max(t) AS last FROM o GROUP BY seq_id),
e AS MATERIALIZED (SELECT o.seq_id, o.t, o.x, z.last, {b[0]} AS b0, {b[1]} AS b1 FROM o JOIN z ON o.seq_id = z.seq_id)"""


def _logs(model: Hmm) -> tuple[list[str], list[list[str]]]:
    return [num(v) for v in model.log_pi], [[num(v) for v in row] for row in model.log_trans]


def _add(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


def _forward_sql(model: Hmm) -> str:
    p, m = _logs(model)
    into = [_add(f"(f.a0 + {m[0][j]})", f"(f.a1 + {m[1][j]})") for j in (0, 1)]
    return f"""f AS (SELECT seq_id, t, last, {p[0]} + b0 AS a0, {p[1]} + b1 AS a1 FROM e WHERE t = 0
      UNION ALL SELECT e.seq_id, e.t, e.last, {into[0]} + e.b0, {into[1]} + e.b1 FROM f JOIN e ON e.seq_id = f.seq_id AND e.t = f.t + 1),
l AS (SELECT seq_id, {_add("a0", "a1")} AS logp, last + 1 AS n FROM f WHERE t = last)"""


def _backward_sql(model: Hmm) -> str:
    _, m = _logs(model)
    back = [_add(f"({m[i][0]} + h.b0 + h.g0)", f"({m[i][1]} + h.b1 + h.g1)") for i in (0, 1)]
    return f"""h AS (SELECT seq_id, t, b0, b1, CAST(0 AS DOUBLE) AS g0, CAST(0 AS DOUBLE) AS g1 FROM e WHERE t = last
      UNION ALL SELECT e.seq_id, e.t, e.b0, e.b1, {back[0]}, {back[1]} FROM h JOIN e ON e.seq_id = h.seq_id AND e.t = h.t - 1)"""


def _viterbi_sql(model: Hmm) -> str:
    p, m = _logs(model)
    from0 = [f"(v.d0 + {m[0][j]})" for j in (0, 1)]
    from1 = [f"(v.d1 + {m[1][j]})" for j in (0, 1)]
    d = [f"greatest({from0[j]}, {from1[j]}) + e.b{j}" for j in (0, 1)]
    k = [f"CASE WHEN {from1[j]} > {from0[j]} THEN 1 ELSE 0 END" for j in (0, 1)]
    return f"""v AS (SELECT seq_id, t, last, {p[0]} + b0 AS d0, {p[1]} + b1 AS d1, 0 AS k0, 0 AS k1 FROM e WHERE t = 0
      UNION ALL SELECT e.seq_id, e.t, e.last, {d[0]}, {d[1]}, {k[0]}, {k[1]} FROM v JOIN e ON e.seq_id = v.seq_id AND e.t = v.t + 1),
w AS (SELECT seq_id, t, CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS state, k0, k1 FROM v WHERE t = last
      UNION ALL SELECT v.seq_id, v.t, CASE WHEN w.state = 0 THEN w.k0 ELSE w.k1 END, v.k0, v.k1 FROM w JOIN v ON v.seq_id = w.seq_id AND v.t = w.t - 1)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# -- log-densities as SQL --------------------------------------------------------------------------------------


def _when(test: str, body: str) -> str:
    return f"CASE WHEN {test} THEN {body} ELSE CAST('-Infinity' AS DOUBLE) END"


def _gaussian_sql(e: Any, x: str) -> str:
    return f"(-0.5 * pow(({x} - {num(e.mu)}) / {num(e.sigma)}, 2) - {num(0.5 * math.log(2 * math.pi) + math.log(e.sigma))})"


def _binomial_sql(e: Any, x: str) -> str:
    n = num(e.n)
    return _when(f"{x} >= 0 AND {x} <= {n}", f"lgamma({n} + 1) - lgamma({x} + 1) - lgamma({n} - {x} + 1) + {x} * ln({num(e.p)}) + ({n} - {x}) * ln(1 - {num(e.p)})")


def _negative_sql(e: Any, x: str) -> str:
    return _when(f"{x} >= 0", f"lgamma({x} + {num(e.r)}) - lgamma({x} + 1) - lgamma({num(e.r)}) + {num(e.r)} * ln({num(e.p)}) + {x} * ln(1 - {num(e.p)})")


LOGPDF: dict[str, Callable[[Any, str], str]] = {
    "Gaussian": _gaussian_sql,
    "Exponential": lambda e, x: _when(f"{x} >= 0", f"ln({num(e.lambda_)}) - {num(e.lambda_)} * {x}"),
    "Gamma": lambda e, x: _when(f"{x} > 0", f"({num(e.k)} - 1) * ln({x}) - {x} / {num(e.theta)} - {num(e.k)} * ln({num(e.theta)}) - lgamma({num(e.k)})"),
    "LogNormal": lambda e, x: _when(f"{x} > 0", f"-ln({x}) - {num(math.log(e.sigma * math.sqrt(2 * math.pi)))} - pow(ln({x}) - {num(e.mu)}, 2) / {num(2 * e.sigma**2)}"),
    "Beta": lambda e, x: _when(
        f"{x} > 0 AND {x} < 1", f"({num(e.alpha)} - 1) * ln({x}) + ({num(e.beta)} - 1) * ln(1 - {x}) - lgamma({num(e.alpha)}) - lgamma({num(e.beta)}) + lgamma({num(e.alpha + e.beta)})"
    ),
    "Uniform": lambda e, x: _when(f"{x} >= {num(e.a)} AND {x} <= {num(e.b)}", f"-ln({num(e.b)} - {num(e.a)})"),
    "Weibull": lambda e, x: _when(
        f"{x} > 0", f"ln({num(e.k)}) - {num(e.k)} * ln({num(e.lambda_)}) + ({num(e.k)} - 1) * ln({x}) - pow({x} / {num(e.lambda_)}, {num(e.k)})"
    ),
    "Pareto": lambda e, x: _when(f"{x} >= {num(e.xm)}", f"ln({num(e.k)}) + {num(e.k)} * ln({num(e.xm)}) - ({num(e.k)} + 1) * ln({x})"),
    "Rayleigh": lambda e, x: _when(f"{x} > 0", f"ln({x}) - 2 * ln({num(e.sigma)}) - {x} * {x} / {num(2 * e.sigma**2)}"),
    "StudentT": lambda e, x: (
        f"(lgamma({num((e.df + 1) / 2)}) - lgamma({num(e.df / 2)}) - 0.5 * ln({num(e.df * math.pi)}) - ln({num(e.sigma)})"
        f" - {num((e.df + 1) / 2)} * ln(1 + pow(({x} - {num(e.mu)}) / {num(e.sigma)}, 2) / {num(e.df)}))"
    ),
    "ChiSquared": lambda e, x: _when(f"{x} > 0", f"({num(e.k / 2)} - 1) * ln({x}) - {x} / 2 - {num(e.k / 2)} * ln(2) - lgamma({num(e.k / 2)})"),
    "VonMises": lambda e, x: f"({num(e.kappa)} * cos({x} - {num(e.mu)}) - {num(math.log(2 * math.pi) + special.log_i0(e.kappa))})",
    "Discrete": lambda e, x: "CASE CAST(" + x + " AS INTEGER) " + " ".join(f"WHEN {i} THEN ln({num(p)})" for i, p in enumerate(e.probs) if p > 0) + " ELSE CAST('-Infinity' AS DOUBLE) END",
    "Poisson": lambda e, x: _when(f"{x} >= 0 AND floor({x}) = {x}", f"{x} * ln({num(e.lambda_)}) - {num(e.lambda_)} - lgamma({x} + 1)"),
    "Binomial": _binomial_sql,
    "NegativeBinomial": _negative_sql,
}

# -- inference -------------------------------------------------------------------------------------------------


def _log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_sequences(spark, sf_dir, "log_value")


def _scored(model: Hmm, what: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inference.score(event_sequences(spark, sf_dir, what), model, fold=True).select("seq_id", "n", r6(F.col("logp")).alias("logp"))

    return query


def _score_sql(model: Hmm, what: str) -> str:
    return _with(_steps_sql(model, what), _forward_sql(model)) + f"SELECT seq_id, CAST(n AS INTEGER) AS n, {s6('logp')} AS logp FROM l"


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inference.total_log_likelihood(inference.score(_log_values(spark, sf_dir), MODEL))
    return t.select("n_sequences", "n_observations", r6(F.col("logp")).alias("logp"))


def _probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of each whole sequence as mantissa * 10^exponent."""
    rows = inference.score(_log_values(spark, sf_dir), MODEL).select("seq_id", F.exp("logp").alias("p"))
    rows = rows.withColumn("exponent", F.floor(F.log10("p")).cast("int"))
    return rows.select("seq_id", F.round(F.col("p") / F.pow(F.lit(10.0), F.col("exponent")), 6).alias("mantissa"), "exponent")


def _arrow_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.score(_log_values(spark, sf_dir), MODEL, fold=False).select("seq_id", "n", r6(F.col("logp")).alias("logp"))


def _lattice(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inference.lattice(_log_values(spark, sf_dir), MODEL, kind).select("seq_id", "t", "state", r6(F.col("value")).alias("value"))

    return query


def _both_states(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT seq_id, t, {i} AS state, {s6(c)} AS value FROM {table}" for i, c in enumerate(columns))


def _path(decode: Callable[[DataFrame, Hmm], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inference.steps(decode(_log_values(spark, sf_dir), MODEL))

    return query


def _viterbi_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.viterbi_score(_log_values(spark, sf_dir), MODEL, fold=True).select("seq_id", "n", r6(F.col("logp")).alias("logp"))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.normalized(inference.score(_log_values(spark, sf_dir), MODEL)).select("seq_id", r6(F.col("score")).alias("score"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised scores; users divisible by 5 are the labelled class."""
    return inference.normalized(inference.score(_log_values(spark, sf_dir), MODEL)).withColumn("odd", F.col("seq_id") % 5 == 0)


def _detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inference.detection_table(_labelled(spark, sf_dir), "odd")
    return t.select("k", r6(F.col("threshold")).alias("threshold"), "tp", "fp", "n_positive", "n_negative", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    s = rows.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return rows.crossJoin(F.broadcast(s)).select("seq_id", (F.col("score") < F.col("m") - 2 * F.col("s")).alias("flagged"))  # s is one row


_E, _F, _B, _V = _steps_sql(MODEL), _forward_sql(MODEL), _backward_sql(MODEL), _viterbi_sql(MODEL)
_N = "q AS (SELECT seq_id, logp / n AS score, seq_id % 5 = 0 AS odd FROM l)"

_register("forward_loglik", _scored(MODEL, "log_value"), _score_sql(MODEL, "log_value"))
_register("forward_loglik_arrow", _arrow_score, _score_sql(MODEL, "log_value"))
_register("forward_loglik_discrete", _scored(TYPES, "type"), _score_sql(TYPES, "type"))
_register("forward_loglik_total", _total, _with(_E, _F) + f"SELECT count(*) AS n_sequences, CAST(sum(n) AS BIGINT) AS n_observations, {s6('sum(logp)')} AS logp FROM l")
_register(
    "sequence_probability", _probability,
    _with(_E, _F) + "SELECT seq_id, round(exp(logp) / pow(10.0, floor(log10(exp(logp)))), 6) AS mantissa, CAST(floor(log10(exp(logp))) AS INTEGER) AS exponent FROM l",
)
_register("forward_variables", _lattice("forward"), _with(_E, _F) + _both_states("f", ["a0", "a1"]))
_register("backward_variables", _lattice("backward"), _with(_E, _B) + _both_states("h", ["g0", "g1"]))
_register("log_emissions", _lattice("emission"), _with(_E) + _both_states("e", ["b0", "b1"]))
_G = "c AS (SELECT f.seq_id, f.t, f.last, f.a0, f.a1, h.b0, h.b1, h.g0, h.g1, exp(f.a0 + h.g0 - l.logp) AS p0, exp(f.a1 + h.g1 - l.logp) AS p1, l.logp FROM f JOIN h ON f.seq_id = h.seq_id AND f.t = h.t JOIN l ON l.seq_id = f.seq_id)"
_register("posterior_gamma", _lattice("posterior"), _with(_E, _F, _B, _G) + _both_states("c", ["p0", "p1"]))
_register("posterior_path", _path(inference.posterior_decode), _with(_E, _F, _B, _G) + "SELECT seq_id, t, CASE WHEN a1 + g1 > a0 + g0 THEN 1 ELSE 0 END AS state FROM c")
_register("viterbi_path", _path(inference.viterbi), _with(_E, _V) + "SELECT seq_id, t, state FROM w")
_register("viterbi_logprob", _viterbi_logprob, _with(_E, _V) + f"SELECT seq_id, last + 1 AS n, {s6('greatest(d0, d1)')} AS logp FROM v WHERE t = last")
_register("normalized_score", _normalized, _with(_E, _F, _N) + f"SELECT seq_id, {s6('score')} AS score FROM q")
_register(
    "anomaly_flags", _flags, _with(_E, _F, _N) + "SELECT seq_id, score < (SELECT avg(score) - 2 * stddev_pop(score) FROM q) AS flagged FROM q"
)
_register(
    "detection_table", _detection,
    _with(_E, _F, _N, "s AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM q WHERE NOT odd)", "k AS (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS k)")
    + f"""SELECT k, {s6('any_value(m - k * s)')} AS threshold, count(*) FILTER (WHERE odd AND score < m - k * s) AS tp, count(*) FILTER (WHERE NOT odd AND score < m - k * s) AS fp,
 count(*) FILTER (WHERE odd) AS n_positive, count(*) FILTER (WHERE NOT odd) AS n_negative,
 {s6("count(*) FILTER (WHERE odd AND score < m - k * s) / greatest(1, count(*) FILTER (WHERE odd))")} AS tpr,
 {s6("count(*) FILTER (WHERE NOT odd AND score < m - k * s) / greatest(1, count(*) FILTER (WHERE NOT odd))")} AS fpr
FROM q, s, k GROUP BY k""",
)

# -- densities and fits ----------------------------------------------------------------------------------------

#: Observations by name: (table, key, Spark column, SQL).
OBSERVED: dict[str, tuple[str, str, Callable[[], Column], str]] = {
    "value": ("events", "event_id", lambda: F.col("value"), "value"),
    "positive": ("events", "event_id", lambda: F.col("value") + 1, "(value + 1)"),
    "log_value": ("events", "event_id", lambda: F.ln(F.col("value") + 1), "ln(value + 1)"),
    "k": ("events", "event_id", lambda: F.get_json_object("props", "$.k").cast("double"), "CAST(json_extract(props, '$.k') AS DOUBLE)"),
    "angle": ("events", "event_id", lambda: day_angle("ts"), f"(epoch_us(ts) % 86400000000) / 1e6 * {num(2 * math.pi / 86_400)} - {num(math.pi)}"),
    "symbol": ("events", "event_id", lambda: F.length("event_type").cast("double") - 4, "CAST(length(event_type) - 4 AS DOUBLE)"),
    "share": ("orders", "o_orderkey", lambda: (F.col("o_orderkey") % 97 + 1) / 99.0, "(o_orderkey % 97 + 1) / 99.0"),
}
CASES: dict[str, tuple[Emission, str]] = {
    "gaussian": (Gaussian(3.0, 1.2), "log_value"),
    "exponential": (Exponential(0.02), "value"),
    "gamma": (Gamma(1.3, 40.0), "value"),
    "lognormal": (LogNormal(3.2, 1.1), "positive"),
    "beta": (Beta(2.0, 3.0), "share"),
    "uniform": (Uniform(1.0, 150.0), "value"),
    "weibull": (Weibull(1.1, 50.0), "value"),
    "pareto": (Pareto(0.5, 1.0), "positive"),
    "rayleigh": (Rayleigh(40.0), "value"),
    "student_t": (StudentT(4.0, 45.0, 30.0), "value"),
    "chi_squared": (ChiSquared(30.0), "positive"),
    "von_mises": (VonMises(0.5, 0.8), "angle"),
    "discrete": (Discrete((0.3, 0.3, 0.2, 0.1, 0.1)), "symbol"),
    "poisson": (Poisson(45.0), "k"),
    "binomial": (Binomial(99, 0.5), "k"),
    "negative_binomial": (NegativeBinomial(3.0, 0.06), "k"),
}


def _observed(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    table, key, x, _ = OBSERVED[what]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("id"), x().alias("x"))


def _logpdf(e: Emission, what: str) -> Query:
    return lambda spark, sf_dir: _observed(spark, sf_dir, what).select("id", r6(e.column("x")).alias("logpdf"))


def _parameters(spark: SparkSession, e: Emission) -> DataFrame:
    rows = []
    for name, value in e.to_dict().items():
        if name != "type":
            rows += [(f"{name}{i}", float(v)) for i, v in enumerate(value)] if isinstance(value, list) else [(name, float(value))]
    return spark.createDataFrame(rows, "parameter string, value double").select("parameter", r6(F.col("value")).alias("value"))


#: Weights of the weighted fits.
WEIGHT, WEIGHT_SQL = "(id % 7 + 1) / 8.0", "(id % 7 + 1) / 8.0"


def _fit(e: Emission, what: str, weighted: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _observed(spark, sf_dir, what).withColumn("w", F.expr(f"CAST({WEIGHT} AS DOUBLE)"))
        return _parameters(spark, fit_column(rows, e.reset(), "x", "w" if weighted else None))

    return query


def _statistics(e: Emission, what: str) -> Query:
    """What the first round of a weighted fit asks for."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _observed(spark, sf_dir, what).withColumn("w", F.expr(f"CAST({WEIGHT} AS DOUBLE)"))
        want = next(e.fitting(True))
        named = rows.agg(*columns_of(want, F.col("x"), F.col("w")))
        pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in want)))
        return named.select(pairs.alias("s")).select("s.statistic", r6(F.col("s.value")).alias("value"))

    return query


def _rows_sql(what: str) -> str:
    table, key, _, x = OBSERVED[what]
    return f"WITH d AS (SELECT {key} AS id, {x} AS x FROM {table}), o AS (SELECT id, x, CAST({WEIGHT_SQL} AS DOUBLE) AS w FROM d)"


def _named(what: str, values: dict[str, str], label: str, more: str = "") -> str:
    body = ", ".join(f"{{'n': '{n}', 'v': CAST({v} AS DOUBLE)}}" for n, v in values.items())
    return f"{_rows_sql(what)}{more}, u AS (SELECT unnest([{body}]) AS s FROM o) SELECT s.n AS {label}, {s6('s.v')} AS value FROM u"


#: Closed-form fits: family to (unweighted, weighted) SQL of each parameter.
_VAR = "(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2))"
CLOSED: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "gaussian": ({"mu": "avg(x)", "sigma": "stddev_pop(x)"}, {"mu": "sum(w * x) / sum(w)", "sigma": f"sqrt({_VAR})"}),
    "exponential": ({"lambda": "1 / avg(x)"}, {"lambda": "sum(w) / sum(w * x)"}),
    "lognormal": (
        {"mu": "avg(ln(x))", "sigma": "stddev_pop(ln(x))"},
        {"mu": "sum(w * ln(x)) / sum(w)", "sigma": "sqrt(sum(w * ln(x) * ln(x)) / sum(w) - pow(sum(w * ln(x)) / sum(w), 2))"},
    ),
    "uniform": (
        {"a": "min(x) - 0.05 * (max(x) - min(x))", "b": "max(x) + 0.05 * (max(x) - min(x))"},
        {"a": f"sum(w * x) / sum(w) - sqrt(3 * {_VAR})", "b": f"sum(w * x) / sum(w) + sqrt(3 * {_VAR})"},
    ),
    "pareto": ({"k": "count(*) / (sum(ln(x)) - count(*) * ln(min(x)))", "xm": "min(x)"}, {"k": "sum(w) / (sum(w * ln(x)) - sum(w) * ln(min(x)))", "xm": "min(x)"}),
    "rayleigh": (
        {"sigma": "CASE WHEN min(x) > 0 THEN sqrt(sum(x * x) / (2 * count(*))) ELSE 1 END"},
        {"sigma": "sqrt(sum(CASE WHEN x > 0 THEN w * x * x ELSE 0 END) / (2 * sum(w)))"},
    ),
    "poisson": ({"lambda": "avg(x)"}, {"lambda": "sum(w * x) / sum(w)"}),
    "binomial": ({"n": "max(x)", "p": "avg(x) / max(x)"}, {"n": "max(x)", "p": "sum(w * x) / sum(w) / max(x)"}),
    "discrete": (
        {"n": "10"} | {f"probs{i}": f"avg(CASE WHEN x = {i} THEN 1.0 ELSE 0.0 END)" for i in range(10)},
        {"n": "10"} | {f"probs{i}": f"sum(CASE WHEN x = {i} THEN w ELSE 0.0 END) / sum(w)" for i in range(10)},
    ),
}
_SW = lambda test, value="1": f"coalesce(sum(CASE WHEN {test} THEN w * ({value}) ELSE 0 END), 0)"
_LX = "ln(CASE WHEN x > 0 THEN x ELSE 1 END)"
STATISTICS: dict[str, dict[str, str]] = {
    "gamma": {"n": "count(*)", "all": "sum(w)", "w": _SW("x > 0"), "x": _SW("x > 0", "x"), "lx": _SW("x > 0", _LX)},
    "beta": {"n": "count(*)", "all": "sum(w)", "w": "sum(w)", "x": "sum(w * x)", "xx": "sum(w * x * x)", "lx": "sum(w * ln(x))", "ly": "sum(w * ln(1 - x))"},
    "weibull": {"n": "count(*)", "all": "sum(w)", "w": _SW("x > 0"), "lx": _SW("x > 0", _LX), "llx": _SW("x > 0", f"{_LX} * {_LX}"), "top": "max(CASE WHEN x > 0 THEN ln(x) END)"},
    "chi_squared": {"n": "count(*)", "bad": "0", "w": "sum(w)", "x": "sum(w * x)", "lx": "sum(w * ln(x))"},
    "von_mises": {"n": "count(*)", "w": "sum(w)", "s": "sum(w * sin(x))", "c": "sum(w * cos(x))"},
    "negative_binomial": {"n": "count(*)", "all": "sum(w)", "w": "sum(w)", "k": "sum(w * x)", "kk": "sum(w * x * x)"},
    "student_t": {
        "n": "count(*)", "all": "sum(w)", "in": "sum(w)", "e": "sum(w * 5 / (4 + pow((x - 45) / 30, 2)))", "ed": "sum(w * 5 / (4 + pow((x - 45) / 30, 2)) * (x - 45))",
        "edd": "sum(w * 5 / (4 + pow((x - 45) / 30, 2)) * pow(x - 45, 2))", "lz": "sum(w * ln((4 + pow((x - 45) / 30, 2)) / 2))",
    },
}

for _name, (_e, _what) in CASES.items():
    _register(f"logpdf_{_name}", _logpdf(_e, _what), f"{_rows_sql(_what)} SELECT id, {s6(LOGPDF[_e.tag](_e, 'x'))} AS logpdf FROM o")
    _source = "positive" if _name in ("weibull", "rayleigh") else _what
    _plain, _weighted = CLOSED.get(_name, (None, None))
    for _prefix, _closed, _uses in (("fit", _plain, False), ("weighted_fit", _weighted, True)):
        _sql = fit_sql(_name, _rows_sql(_source), _uses, s6) if _name in FITS else _named(_source, _closed, "parameter")
        _register(f"{_prefix}_{_name}", _fit(_e.reset() if _name != "discrete" else Discrete(), _source, _uses), _sql)
    if _name in STATISTICS:
        _register(f"stats_{_name}", _statistics(_e, _what), _named(_what, STATISTICS[_name], "statistic"))

# -- distribution functions and moments ------------------------------------------------------------------------


def _cdf(e: Emission, what: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.pandas_udf("double")
        def cdf(x):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series(e.cdf(x.to_numpy()))

        rows = _observed(spark, sf_dir, what)
        found = e.cdf_column(F.col("x"))  # where the family has an expression, no Python worker starts
        return rows.select("id", r6(cdf("x") if found is None else found).alias("cdf"))

    return query


for _name, (_e, _what) in CASES.items():
    _register(f"cdf_{_name}", _cdf(_e, _what), f"{_rows_sql(_what)} SELECT id, {s6(CDF[_name](_e))} AS cdf FROM o")


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, k, float(v)) for n, (e, _) in CASES.items() for k, v in e.moments().items() if math.isfinite(v)]
    return spark.createDataFrame(rows, "family string, moment string, value double").select("family", "moment", r6(F.col("value")).alias("value"))


def _moments_sql() -> str:
    parts = []
    for name, (e, _) in CASES.items():
        values = MOMENTS[name](e)
        values |= {"sd": f"sqrt({values['variance']})"} if "variance" in values else {}
        parts += [f"SELECT '{name}' AS family, '{k}' AS moment, {s6(f'CAST({v} AS DOUBLE)')} AS value" for k, v in values.items()]
    return " UNION ALL ".join(parts)


_register("emission_moments", _moments, _moments_sql())

# -- hard assignments ------------------------------------------------------------------------------------------


def _hard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = _log_values(spark, sf_dir)
    return training._assigned(seqs, inference.viterbi(seqs, MODEL))


def _hard_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.hard_counts(_hard_steps(spark, sf_dir)).where("following IS NOT NULL").select("state", "following", "n")


def _hard_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.hard_counts(_hard_steps(spark, sf_dir)).where("following IS NULL").select("state", "n")


def _model_rows(spark: SparkSession, model: Hmm) -> DataFrame:
    """(name, i, j, value): a model of Gaussians as rows."""
    rows = [("pi", i, 0, p) for i, p in enumerate(model.pi)] + [("trans", i, j, p) for i, r in enumerate(model.trans) for j, p in enumerate(r)]
    for i, e in enumerate(model.emissions):
        rows += [(name, i, 0, float(v)) for name, v in e.params().items()]
    return spark.createDataFrame(rows, "name string, i int, j int, value double").select("name", "i", "j", r6(F.col("value")).alias("value"))


def _viterbi_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_rows(spark, training.viterbi_step(_log_values(spark, sf_dir), MODEL).model)


_HARD = "y AS (SELECT w.seq_id, w.t, w.state, o.x, lead(w.state) OVER (PARTITION BY w.seq_id ORDER BY w.t) AS following FROM w JOIN o ON o.seq_id = w.seq_id AND o.t = w.t)"
_HARD_MODEL = f"""SELECT 'pi' AS name, state AS i, 0 AS j, {s6('count(*) / (SELECT count(*) FROM y WHERE t = 0)')} AS value FROM y WHERE t = 0 GROUP BY state
UNION ALL SELECT 'trans', state, following, {s6('count(*) / any_value(total)')} FROM (SELECT *, count(*) OVER (PARTITION BY state) AS total FROM y WHERE following IS NOT NULL) GROUP BY state, following
UNION ALL SELECT 'mu', state, 0, {s6('avg(x)')} FROM y GROUP BY state
UNION ALL SELECT 'sigma', state, 0, {s6('stddev_pop(x)')} FROM y GROUP BY state"""
_register("hard_transition_counts", _hard_transitions, _with(_E, _V, _HARD) + "SELECT state, following, count(*) AS n FROM y WHERE following IS NOT NULL GROUP BY ALL")
_register("hard_initial_counts", _hard_initial, _with(_E, _V, _HARD) + "SELECT state, count(*) AS n FROM y WHERE t = 0 GROUP BY state")
_register("viterbi_training_step", _viterbi_step, _with(_E, _V, _HARD) + _HARD_MODEL)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.steps(training.even_paths(_log_values(spark, sf_dir), 2))


def _segment_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = _log_values(spark, sf_dir)
    return _model_rows(spark, training._maximise(training._assigned(seqs, training.even_paths(seqs, 2)), Hmm.blank(2), float(seqs.count())))


_EVEN = "w AS (SELECT seq_id, t, CAST(floor((row_number() OVER (ORDER BY seq_id, t) - 1) * 2 / (SELECT count(*) FROM o)) AS INTEGER) AS state FROM o)"
_register("segmental_init", _segments, _with(_E, _EVEN) + "SELECT seq_id, t, state FROM w")
_register(
    "segmental_one_iter", _segment_step,
    _with(_E, _EVEN, _HARD, "g AS (" + _HARD_MODEL + ")", "s AS (SELECT * FROM (VALUES ('pi', 0, 0), ('pi', 1, 0), ('trans', 0, 0), ('trans', 0, 1), ('trans', 1, 0), ('trans', 1, 1), ('mu', 0, 0), ('mu', 1, 0), ('sigma', 0, 0), ('sigma', 1, 0)) AS v(name, i, j))")
    + "SELECT s.name, s.i, s.j, coalesce(g.value, 0) AS value FROM s LEFT JOIN g ON s.name = g.name AND s.i = g.i AND s.j = g.j",
)

# -- expectation-maximisation ----------------------------------------------------------------------------------


def _expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = training.expectation(_log_values(spark, sf_dir), MODEL)
    rows = [("sequences", 0, 0, float(e.sequences)), ("logp", 0, 0, e.logp)]
    rows += [(n, i, 0, float(v)) for n, vs in (("initial", e.initial), ("leaving", e.leaving), ("occupancy", e.occupancy)) for i, v in enumerate(vs)]
    rows += [("transitions", i, j, float(v)) for i, r in enumerate(e.transitions) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "name string, i int, j int, value double").select("name", "i", "j", (F.round("value", 5) + F.lit(0.0)).alias("value"))


def _em_step(pseudo: float) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _model_rows(spark, training.baum_welch_step(_log_values(spark, sf_dir), MODEL, pseudo).model)

    return query


def _xi(i: int, j: int) -> str:
    return f"sum(exp(a.a{i} + {num(MODEL.log_trans[i][j])} + b.b{j} + b.g{j} - a.logp))"


_XI = "x AS (SELECT " + ", ".join(f"{_xi(i, j)} AS x{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM c AS a JOIN c AS b ON b.seq_id = a.seq_id AND b.t = a.t + 1)"
_SUMS = """g AS (SELECT count(DISTINCT c.seq_id) AS n, sum(CASE WHEN c.t = 0 THEN logp END) AS logp,
 sum(CASE WHEN c.t = 0 THEN p0 ELSE 0 END) AS i0, sum(CASE WHEN c.t = 0 THEN p1 ELSE 0 END) AS i1,
 sum(CASE WHEN c.t < c.last THEN p0 ELSE 0 END) AS l0, sum(CASE WHEN c.t < c.last THEN p1 ELSE 0 END) AS l1, sum(p0) AS o0, sum(p1) AS o1,
 sum(p0 * o.x) / sum(p0) AS m0, sum(p1 * o.x) / sum(p1) AS m1 FROM c JOIN o ON o.seq_id = c.seq_id AND o.t = c.t)"""
_SD = "s AS (SELECT sqrt(sum(p0 * pow(o.x - m0, 2)) / any_value(o0)) AS s0, sqrt(sum(p1 * pow(o.x - m1, 2)) / any_value(o1)) AS s1 FROM c JOIN o ON o.seq_id = c.seq_id AND o.t = c.t, g)"


def _unpivot(values: list[tuple[str, int, int, str]], source: str, places: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {i} AS i, {j} AS j, round(CAST({v} AS DOUBLE), {places}) + 0.0 AS value FROM {source}" for n, i, j, v in values)


def _step_sql(c: float) -> str:
    values = [("pi", i, 0, f"(i{i} + {c}) / (i0 + i1 + {2 * c})") for i in (0, 1)]
    values += [("trans", i, j, f"(x{i}{j} + {c}) / (l{i} + {2 * c})") for i in (0, 1) for j in (0, 1)]
    values += [("mu", i, 0, f"m{i}") for i in (0, 1)] + [("sigma", i, 0, f"s{i}") for i in (0, 1)]
    return _with(_E, _F, _B, _G.replace("c AS (", "c AS MATERIALIZED ("), _XI, _SUMS, _SD) + _unpivot(values, "g, x, s")


_register(
    "em_expectation", _expectation,
    _with(_E, _F, _B, _G.replace("c AS (", "c AS MATERIALIZED ("), _XI, _SUMS)
    + _unpivot(
        [("sequences", 0, 0, "n"), ("logp", 0, 0, "logp")]
        + [(n, i, 0, f"{k}{i}") for n, k in (("initial", "i"), ("leaving", "l"), ("occupancy", "o")) for i in (0, 1)]
        + [("transitions", i, j, f"x{i}{j}") for i in (0, 1) for j in (0, 1)],
        "g, x", 5,
    ),
)
_register("em_one_iter", _em_step(0.0), _step_sql(0.0))
_register("map_one_iter", _em_step(2.0), _step_sql(2.0))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = _log_values(spark, sf_dir).cache()
    done = training.baum_welch(seqs, MODEL)
    seqs.unpersist()
    return spark.createDataFrame([(i, v) for i, v in enumerate(done.history)], "iteration int, logp double").select("iteration", r6(F.col("logp")).alias("logp"))


def _trained(train: Callable[[DataFrame], Hmm]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        seqs = _log_values(spark, sf_dir).cache()
        model = train(seqs)
        seqs.unpersist()
        return _model_rows(spark, model)

    return query


def _best_of_three(seqs: DataFrame) -> Hmm:
    from ..operators.restarts import fit_best_of_n

    return fit_best_of_n(seqs, MODEL, 3, seed=1).model


_register("baum_welch_history", _history)
_register("viterbi_training_fit", _trained(lambda s: training.viterbi_training(s, MODEL, training.BALANCED).model))
_register("segmental_kmeans_fit", _trained(lambda s: training.segmental_k_means(s, Hmm.blank(2)).model))
_register("fit_best_of_n", _trained(_best_of_three))
_register("left_to_right_em", _trained(lambda s: training.baum_welch(s, initialize(MODEL, Topology("left_to_right")), topology=Topology("left_to_right")).model))


def _log_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, training.log_prior(TYPES, c)) for c in (0.0, 0.5, 2.0)]
    return spark.createDataFrame(rows, "pseudo_count double, log_prior double").select("pseudo_count", r6(F.col("log_prior")).alias("log_prior"))


_PRIOR = " + ".join(f"ln({num(p)})" for p in [*TYPES.pi, *(p for r in TYPES.trans for p in r), *(p for e in TYPES.emissions for p in e.probs)])
_register("map_log_prior", _log_prior, f"SELECT c AS pseudo_count, {s6(f'c * ({_PRIOR})')} AS log_prior FROM (SELECT unnest([0.0, 0.5, 2.0])::DOUBLE AS c)")

# -- selection, topology, sampling, files ----------------------------------------------------------------------

CANDIDATES = {"two_gaussians": MODEL, "one_wide": Hmm((0.5, 0.5), ((0.5, 0.5), (0.5, 0.5)), (Gaussian(3.0, 1.2), Gaussian(3.0, 1.2)))}


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = selection.compare(_log_values(spark, sf_dir), CANDIDATES)
    return t.select("model", "k", "n", *(r6(F.col(c)).alias(c) for c in ("logp", "aic", "bic", "aicc")))


def _selection_sql() -> str:
    parts = []
    for name, m in CANDIDATES.items():
        k = selection.free_parameters(m)
        inner = _with(_steps_sql(m), _forward_sql(m)) + "SELECT sum(logp) AS logp, CAST(sum(n) AS BIGINT) AS n FROM l"
        a = f"(2 * {k} - 2 * logp)"
        values = {"logp": "logp", "aic": a, "bic": f"({k} * ln(n) - 2 * logp)", "aicc": f"({a} + 2.0 * {k} * ({k} + 1) / (n - {k} - 1))"}
        parts.append(f"SELECT '{name}' AS model, {k} AS k, n, " + ", ".join(f"{s6(v)} AS {c}" for c, v in values.items()) + f" FROM ({inner})")
    return " UNION ALL ".join(parts)


_register("model_selection", _selection, _selection_sql())

_KINDS = {"ergodic": Topology(), "left_to_right": Topology("left_to_right"), "left_to_right_skip": Topology("left_to_right_skip", 2), "banded": Topology("banded", 1)}
_ALLOWED = {"ergodic": "true", "left_to_right": "j >= i", "left_to_right_skip": "j >= i AND j <= i + 2", "banded": "abs(i - j) <= 1"}


def _topologies(start: Callable[[Hmm, Topology], Hmm]) -> Query:
    base = Hmm((0.2,) * 5, tuple(tuple((i + 1) * (j + 2) / ((i + 1) * 20) for j in range(5)) for i in range(5)), (Gaussian(),) * 5)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(kind, i, j, p) for kind, t in _KINDS.items() for i, r in enumerate(start(base, t).trans) for j, p in enumerate(r)]
        return spark.createDataFrame(rows, "topology string, i int, j int, p double").select("topology", "i", "j", r6(F.col("p")).alias("p"))

    return query


def _topology_sql(weight: str) -> str:
    parts = [f"SELECT '{k}' AS topology, i, j, CASE WHEN {a} THEN {weight} ELSE 0 END AS w FROM n" for k, a in _ALLOWED.items()]
    return (
        "WITH n AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM range(5) AS a(i), range(5) AS b(j)), t AS (" + " UNION ALL ".join(parts) + ") "
        f"SELECT topology, i, j, {s6('w / sum(w) OVER (PARTITION BY topology, i)')} AS p FROM t"
    )


_register("topology_init", _topologies(initialize), _topology_sql("1.0"))
_register("topology_enforce", _topologies(enforce), _topology_sql("(j + 2) / 20.0"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.sample(spark, MODEL, 200, 30, seed=5)
    return drawn.select("seq_id", F.posexplode(F.arrays_zip("states", "xs")).alias("t", "z")).select("seq_id", "t", F.col("z.states").alias("state"), r6(F.col("z.xs")).alias("x"))


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"gaussian": MODEL, "discrete": TYPES} | {n: Hmm.uniform([e, e]) for n, (e, _) in CASES.items()} | {"vector": VECTOR}
    back = model_json.from_table(model_json.models_table(spark, models))
    text = {n: model_text.from_xml(model_text.to_xml(m)).emissions[0].tag == m.emissions[0].tag for n, m in models.items() if not m.multivariate}
    return spark.createDataFrame([(n, back[n] == m, text.get(n)) for n, m in models.items()], "model string, same boolean, text_same boolean")


# -- multivariate ----------------------------------------------------------------------------------------------

DIAGONAL = DiagonalGaussian((3.0, 6.0), (1.5, 2.0))
FULL = FullCovarianceGaussian((3.0, 6.0), ((1.5, 0.4), (0.4, 2.0)), 1e-5)
PARTS = IndependentComponents((Gamma(3.0, 1.0), Gaussian(6.0, 1.4)))
VECTOR = Hmm((0.5, 0.5), ((0.8, 0.2), (0.3, 0.7)), (DiagonalGaussian((2.5, 5.0), (1.0, 2.0)), DiagonalGaussian((4.0, 7.0), (0.8, 1.5))))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")
    return rows.select(F.col("event_id").alias("id"), F.array(F.ln(F.col("value") + 1), F.ln(F.col("gap") + 1)).alias("x"))


def _vector_logpdf(e: Emission) -> Query:
    return lambda spark, sf_dir: _vectors(spark, sf_dir).select("id", r6(e.column("x")).alias("logpdf"))


_GAP = """g AS (SELECT event_id AS id, user_id, ts, value, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
d AS (SELECT id, user_id, ts, ln(value + 1) AS x0, ln(gap + 1) AS x1 FROM g WHERE gap IS NOT NULL)"""


def _diagonal_sql(e: DiagonalGaussian) -> str:
    terms = " + ".join(f"pow(x{d} - {num(e.mean[d])}, 2) / {num(e.var[d])}" for d in range(e.dim))
    return f"(-0.5 * ({terms}) - {num(0.5 * (e.dim * math.log(2 * math.pi) + sum(map(math.log, e.var))))})"


def _full_sql(e: FullCovarianceGaussian) -> str:
    (a, b), (_, d) = ((e.cov[0][0] + e.reg, e.cov[0][1]), (e.cov[1][0], e.cov[1][1] + e.reg))
    det = a * d - b * b
    z0, z1 = f"(x0 - {num(e.mean[0])})", f"(x1 - {num(e.mean[1])})"
    return f"(-0.5 * ({num(d / det)} * {z0} * {z0} - {num(2 * b / det)} * {z0} * {z1} + {num(a / det)} * {z1} * {z1}) - {num(math.log(2 * math.pi) + 0.5 * linalg.log_det(e.factor()))})"


def _parts_sql(e: IndependentComponents) -> str:
    return "(" + " + ".join(LOGPDF[c.tag](c, f"x{d}") for d, c in enumerate(e.components)) + ")"


for _name, _e, _sql in (("diag_gaussian", DIAGONAL, _diagonal_sql(DIAGONAL)), ("full_gaussian_2d", FULL, _full_sql(FULL)), ("indep_components", PARTS, _parts_sql(PARTS))):
    _register(f"logpdf_{_name}", _vector_logpdf(_e), f"WITH {_GAP} SELECT id, {s6(_sql)} AS logpdf FROM d")


def _vector_fit(e: Emission) -> Query:
    return lambda spark, sf_dir: _parameters_of_vector(spark, fit_column(_vectors(spark, sf_dir), e.reset(), "x"))


def _parameters_of_vector(spark: SparkSession, e: Any) -> DataFrame:
    rows = [(f"mean{i}", v) for i, v in enumerate(e.mean)]
    rows += [(f"var{i}", v) for i, v in enumerate(e.var)] if isinstance(e, DiagonalGaussian) else [(f"cov{i}{j}", v) for i, r in enumerate(e.cov) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "parameter string, value double").select("parameter", r6(F.col("value")).alias("value"))


_MEANS = [("mean0", "avg(x0)"), ("mean1", "avg(x1)")]


def _vector_fit_sql(values: list[tuple[str, str]]) -> str:
    return f"WITH {_GAP} " + " UNION ALL ".join(f"SELECT '{n}' AS parameter, {s6(v)} AS value FROM d" for n, v in values)


_register("fit_diag_gaussian", _vector_fit(DIAGONAL), _vector_fit_sql([*_MEANS, ("var0", "var_pop(x0)"), ("var1", "var_pop(x1)")]))
_register(
    "fit_full_gaussian_2d", _vector_fit(FULL),
    _vector_fit_sql([*_MEANS, ("cov00", "var_pop(x0)"), ("cov01", "covar_pop(x0, x1)"), ("cov10", "covar_pop(x0, x1)"), ("cov11", "var_pop(x1)")]),
)


def _vector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.score(event_sequences(spark, sf_dir, "vector"), VECTOR).select("seq_id", "n", r6(F.col("logp")).alias("logp"))


_VECTOR_E = f"""{_GAP}, o AS (SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - 1 AS INTEGER) AS t, x0, x1 FROM d),
z AS (SELECT seq_id, max(t) AS last FROM o GROUP BY seq_id),
e AS MATERIALIZED (SELECT o.seq_id, o.t, z.last, {_diagonal_sql(VECTOR.emissions[0])} AS b0, {_diagonal_sql(VECTOR.emissions[1])} AS b1 FROM o JOIN z ON o.seq_id = z.seq_id)"""
_register("forward_loglik_vector", _vector_score, _with(_VECTOR_E, _forward_sql(VECTOR)) + f"SELECT seq_id, CAST(n AS INTEGER) AS n, {s6('logp')} AS logp FROM l")


def _vector_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = event_sequences(spark, sf_dir, "vector").cache()
    model = training.baum_welch(seqs, kmeans.kmeans_init(seqs, VECTOR, seed=3)).model
    seqs.unpersist()
    return spark.createDataFrame([(i, d, m, v) for i, e in enumerate(model.emissions) for d, (m, v) in enumerate(zip(e.mean, e.var, strict=True))], "state int, d int, mean double, variance double")


#: Three centres in the 64 dimensions of the embeddings.
CENTRES = [[((7 * i + 3 * d) % 11 - 5) / 50 for d in range(64)] for i in range(3)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vec_id", kmeans.nearest(F.col("x"), CENTRES).alias("cluster"))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _points(spark, sf_dir).select("x", kmeans.nearest(F.col("x"), CENTRES).alias("cluster"))
    means = near.select("cluster", F.posexplode("x").alias("d", "v")).groupBy("cluster", "d").agg(F.avg("v").alias("mean"))
    return means.select("cluster", "d", r6(F.col("mean")).alias("mean"))


def _kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).select("x").cache()
    centres = kmeans.lloyd(points, kmeans.seed_centres(points, 3, seed=2))
    return spark.createDataFrame([(i, d, float(v)) for i, c in enumerate(centres) for d, v in enumerate(c)], "cluster int, d int, mean double")


_DISTANCES = [" + ".join(f"pow(CAST(embedding[{d + 1}] AS DOUBLE) - {num(v)}, 2)" for d, v in enumerate(c)) for c in CENTRES]
_NEAR = f"p AS (SELECT vec_id, embedding, {', '.join(f'{s} AS d{i}' for i, s in enumerate(_DISTANCES))} FROM embeddings), a AS (SELECT vec_id, embedding, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM p)"
_register("kmeans_assign", _assign, f"WITH {_NEAR} SELECT vec_id, cluster FROM a")
_register("kmeans_update", _centres, f"WITH {_NEAR} SELECT cluster, CAST(d AS INTEGER) AS d, {s6('avg(CAST(embedding[d + 1] AS DOUBLE))')} AS mean FROM a, range(64) AS t(d) GROUP BY cluster, d")
_register("kmeans_fit", _kmeans_fit)
_register("vector_em_from_kmeans", _vector_em)
_register("sample_sequences", _samples)
_ROUND = [("gaussian", True), ("discrete", True), *((n, True) for n in CASES if n not in ("gaussian", "discrete")), ("vector", None)]
_register(
    "model_round_trip", _round_trip,
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true, {'true' if t else 'CAST(NULL AS BOOLEAN)'})" for n, t in _ROUND) + ") AS v(model, same, text_same)",
)


def _effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(inference.effect_size(_labelled(spark, sf_dir), "odd"),)], "d double").select(r6(F.col("d")).alias("cohens_d"))


_register(
    "effect_size", _effect,
    _with(_E, _F, _N) + f"SELECT {s6('(avg(score) FILTER (WHERE NOT odd) - avg(score) FILTER (WHERE odd)) / sqrt((var_pop(score) FILTER (WHERE odd) + var_pop(score) FILTER (WHERE NOT odd)) / 2)')} AS cohens_d FROM q",
)


def _discrete_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One MAP step of a model of Discrete emissions: the pseudo-counts smooth these as well."""
    model = training.baum_welch_step(event_sequences(spark, sf_dir, "type"), TYPES, 2.0).model
    rows = [("pi", i, 0, p) for i, p in enumerate(model.pi)] + [("trans", i, j, p) for i, r in enumerate(model.trans) for j, p in enumerate(r)]
    rows += [("probs", i, j, p) for i, e in enumerate(model.emissions) for j, p in enumerate(e.probs)]
    return spark.createDataFrame(rows, "name string, i int, j int, value double").select("name", "i", "j", r6(F.col("value")).alias("value"))


def _discrete_map_sql(c: float) -> str:
    xi = [(i, j, f"sum(exp(a.a{i} + {num(TYPES.log_trans[i][j])} + b.b{j} + b.g{j} - a.logp))") for i in (0, 1) for j in (0, 1)]
    moves = "x AS (SELECT " + ", ".join(f"{v} AS x{i}{j}" for i, j, v in xi) + " FROM c AS a JOIN c AS b ON b.seq_id = a.seq_id AND b.t = a.t + 1)"
    seen = ", ".join(f"sum(CASE WHEN o.x = {k} THEN p{i} ELSE 0 END) AS s{i}{k}" for i in (0, 1) for k in range(5))
    sums = f"""g AS (SELECT sum(CASE WHEN c.t = 0 THEN p0 ELSE 0 END) AS i0, sum(CASE WHEN c.t = 0 THEN p1 ELSE 0 END) AS i1,
 sum(CASE WHEN c.t < c.last THEN p0 ELSE 0 END) AS l0, sum(CASE WHEN c.t < c.last THEN p1 ELSE 0 END) AS l1, sum(p0) AS o0, sum(p1) AS o1, {seen}
 FROM c JOIN o ON o.seq_id = c.seq_id AND o.t = c.t)"""
    values = [("pi", i, 0, f"(i{i} + {c}) / (i0 + i1 + {2 * c})") for i in (0, 1)]
    values += [("trans", i, j, f"(x{i}{j} + {c}) / (l{i} + {2 * c})") for i in (0, 1) for j in (0, 1)]
    values += [("probs", i, k, f"(s{i}{k} + {c}) / (o{i} + {5 * c})") for i in (0, 1) for k in range(5)]
    parts = _steps_sql(TYPES, "type"), _forward_sql(TYPES), _backward_sql(TYPES), _G.replace("c AS (", "c AS MATERIALIZED (")
    return _with(*parts, moves, sums) + _unpivot(values, "g, x")


_register("map_discrete_one_iter", _discrete_map, _discrete_map_sql(2.0))


def _order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Hmm((0.5, 0.5), ((0.7, 0.3), (0.4, 0.6)), (Gaussian(11.0, 0.8), Gaussian(12.2, 0.5)))
    return inference.score(order_sequences(spark, sf_dir), model).select("seq_id", "n", r6(F.col("logp")).alias("logp"))


_ORDERS = Hmm((0.5, 0.5), ((0.7, 0.3), (0.4, 0.6)), (Gaussian(11.0, 0.8), Gaussian(12.2, 0.5)))
_ORDER_E = f"""o AS (SELECT o_custkey AS seq_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS t, ln(o_totalprice) AS x FROM orders),
z AS (SELECT seq_id, max(t) AS last FROM o GROUP BY seq_id),
e AS MATERIALIZED (SELECT o.seq_id, o.t, o.x, z.last, {_gaussian_sql(_ORDERS.emissions[0], 'x')} AS b0, {_gaussian_sql(_ORDERS.emissions[1], 'x')} AS b1 FROM o JOIN z ON o.seq_id = z.seq_id)"""
_register("forward_loglik_orders", _order_scores, _with(_ORDER_E, _forward_sql(_ORDERS)) + f"SELECT seq_id, CAST(n AS INTEGER) AS n, {s6('logp')} AS logp FROM l")
