"""DuckDB SQL for what the database lacks: psi functions, roots, distribution functions. Used by the catalogue's oracles."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from ..functions.special import BERNOULLI

PI = "pi()"


def num(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def total(n: int | str, term: str) -> str:
    """Sum of `term` over i = 0 .. n - 1."""
    return f"list_sum(list_transform(range(CAST({n} AS BIGINT)), lambda i: CAST({term} AS DOUBLE)))"


def psi(x: str) -> str:
    y = f"({x} + 8.0)"
    series = " + ".join(f"{num(b / (2 * k))} * pow({y}, {-2 * k})" for k, b in enumerate(BERNOULLI, 1))
    return f"(ln({y}) - 0.5 / {y} - ({series}) - ({' + '.join(f'1.0 / ({x} + {i}.0)' for i in range(8))}))"


def psi_slope(x: str) -> str:
    y = f"({x} + 8.0)"
    series = " + ".join(f"{num(b)} * pow({y}, {-2 * k - 1})" for k, b in enumerate(BERNOULLI, 1))
    return f"(1.0 / {y} + 0.5 / ({y} * {y}) + ({series}) + ({' + '.join(f'1.0 / (({x} + {i}.0) * ({x} + {i}.0))' for i in range(8))}))"


def root(f: str, low: float, high: float, data: str = "", steps: int = 110) -> str:
    """r AS (...): 110 halvings (of the logarithm) for the root of f, which rises in m, between low and high; the root
    is in `m` of the last row. f may use the columns of the one-row table s, and with `data` (a table) aggregates."""
    values = f"SELECT r.i, r.lo, r.hi, r.m, {f} AS f FROM r, s{', ' + data if data else ''} WHERE r.i < {steps}" + (" GROUP BY r.i, r.lo, r.hi, r.m" if data else "")
    low_, high_ = num(low), num(high)
    return f"""r AS (SELECT 0 AS i, {low_} AS lo, {high_} AS hi, sqrt({low_} * {high_}) AS m UNION ALL
 SELECT i + 1, CASE WHEN f < 0 THEN m ELSE lo END, CASE WHEN f < 0 THEN hi ELSE m END, sqrt(CASE WHEN f < 0 THEN m * hi ELSE lo * m END) FROM ({values})),
z AS (SELECT m AS root FROM r ORDER BY i DESC LIMIT 1)"""


#: Fits by root search: family to the tables s (statistics), r and z (root) for a weight, and the parameters.
def _gamma(w: str, n: str) -> tuple[list[str], dict[str, str]]:
    s = f"s AS (SELECT sum(w * x) / sum(w) AS mean, ln(sum(w * x) / sum(w)) - sum(w * ln(x)) / sum(w) AS gap FROM (SELECT x, {w} AS w FROM o WHERE x > 0))"
    return [s, root(f"gap - ln(m) + {psi('m')}", 1e-10, 1e15)], {"k": "root", "theta": "mean / root"}


def _chi_squared(w: str, n: str) -> tuple[list[str], dict[str, str]]:
    s = f"s AS (SELECT sum(w * ln(x)) / sum(w) - ln(2) AS want FROM (SELECT x, {w} AS w FROM o WHERE x > 0))"
    return [s, root(f"{psi('m')} - want", 0.05, 500)], {"k": "2 * root"}


def _student_t(w: str, n: str) -> tuple[list[str], dict[str, str]]:
    """One step from 1 degree of freedom, place 0 and scale 1."""
    s = f"""s AS (SELECT sum(w * e * x) / sum(w * e) AS place, (sum(w * e * x * x) - sum(w * e * x) * sum(w * e * x) / sum(w * e)) / sum(w) AS variance,
 (sum(w * ln((1 + x * x) / 2)) + sum(w * e)) / sum(w) - {psi('1.0')} - 1 AS open FROM (SELECT x, {w} AS w, 2 / (1 + x * x) AS e FROM o))"""
    return [s, root(f"open - ln(m) + {psi('m')}", 0.05, 500)], {"df": "2 * root", "mu": "place", "sigma": "sqrt(variance)"}


def _von_mises(w: str, n: str) -> tuple[list[str], dict[str, str]]:
    s = f"s AS (SELECT sum(w * sin(x)) AS a, sum(w * cos(x)) AS b, sqrt(pow(sum(w * sin(x)), 2) + pow(sum(w * cos(x)), 2)) / sum(w) AS r FROM (SELECT x, {w} AS w FROM o))"
    angle = f"2 * {PI} * i / 256"
    bent = f"{total(256, f'cos({angle}) * exp(m * (cos({angle}) - 1))')} / {total(256, f'exp(m * (cos({angle}) - 1))')}"
    return [s.replace(" AS r ", " AS length "), root(f"{bent} - length", 1e-12, 1e6)], {"mu": "atan2(a, b)", "kappa": "root"}


def _weibull(w: str, n: str) -> tuple[list[str], dict[str, str]]:
    t = f"t AS (SELECT ln(x) AS l, {w} AS w FROM o)"
    s = "s AS (SELECT sum(w) AS sw, sum(w * l) / sum(w) AS mean, max(l) AS top FROM t)"
    f = "sum(t.w * t.l * exp(r.m * (t.l - s.top))) / sum(t.w * exp(r.m * (t.l - s.top))) - 1 / r.m - any_value(s.mean)"
    scale = "u AS (SELECT any_value(root) AS k, any_value(top) + ln(sum(t.w * exp(root * (t.l - top))) / any_value(sw)) / any_value(root) AS log_scale FROM t, s, z)"
    return [t, s, root(f, 1e-6, 1e6, "t", 75), scale], {"k": "k", "lambda": "exp(log_scale)"}


def _negative_binomial(w: str, n: str) -> tuple[list[str], dict[str, str]]:
    t = f"t AS (SELECT x AS k, sum({w}) AS w FROM o GROUP BY x)"
    s = "s AS (SELECT sum(w) AS sw, sum(w * k) / sum(w) AS mean FROM t)"
    f = f"any_value(ln(1 + mean / m)) - sum(t.w * ({psi('(t.k + m)')} - {psi('m')})) / any_value(sw)"
    return [t, s, root(f, 1e-6, 1e9, "t", 90)], {"r": "root", "p": "root / (root + mean)"}


def _beta(w: str, n: str) -> tuple[list[str], dict[str, str]]:
    """Newton steps for both shapes from the moments."""
    s = f"s AS (SELECT sum(w * x) / sum(w) AS mean, (sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) * {n} AS variance, sum(w * ln(x)) / sum(w) AS lx, sum(w * ln(1 - x)) / sum(w) AS ly FROM (SELECT x, {w} AS w FROM o))"
    g, h, c = f"lx - {psi('a')} + {psi('(a + b)')}", f"ly - {psi('b')} + {psi('(a + b)')}", psi_slope("(a + b)")
    steps = f"""r AS (SELECT 0 AS i, mean * (mean * (1 - mean) / variance - 1) AS a, (1 - mean) * (mean * (1 - mean) / variance - 1) AS b FROM s UNION ALL
 SELECT i + 1, a + ((q - c) * g + c * h) / d, b + (c * g + (p - c) * h) / d FROM (SELECT *, (p - c) * (q - c) - c * c AS d FROM
 (SELECT i, a, b, {g} AS g, {h} AS h, {psi_slope('a')} AS p, {psi_slope('b')} AS q, {c} AS c FROM r, s WHERE i < 40))),
z AS (SELECT a, b FROM r ORDER BY i DESC LIMIT 1)"""
    return [s, steps], {"alpha": "a", "beta": "b"}


FITS: dict[str, Callable[[str, str], tuple[list[str], dict[str, str]]]] = {
    "gamma": _gamma,
    "beta": _beta,
    "weibull": _weibull,
    "student_t": _student_t,
    "chi_squared": _chi_squared,
    "von_mises": _von_mises,
    "negative_binomial": _negative_binomial,
}


def fit_sql(name: str, rows: str, weighted: bool, shown: Callable[[str], str]) -> str:
    """(parameter, value) of a fit over `rows`, the text WITH ..., o AS (...)."""
    tables, parameters = FITS[name]("w" if weighted else "CAST(1 AS DOUBLE)", "1" if weighted else "count(*) / (count(*) - 1)")
    from_ = "u" if name == "weibull" else "z, s"
    rows = rows.replace("WITH ", "WITH RECURSIVE ", 1)
    return rows + ", " + ",\n".join(tables) + " " + " UNION ALL ".join(f"SELECT '{n}' AS parameter, {shown(v)} AS value FROM {from_}" for n, v in parameters.items())


# -- distribution functions ------------------------------------------------------------------------------------


def normal(z: str) -> str:
    """By the series of z^(2n+1) / (2n+1)!!, whose terms have one sign."""
    log_term = f"(2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - (i + 1) * ln(2) - lgamma(i + 1.5) + 0.5 * ln({PI}) - pow({z}, 2) / 2 - 0.5 * ln(2 * {PI})"
    return f"(0.5 + sign({z}) * {total(240, f'exp({log_term})')})"


def incomplete_gamma(a: float, x: str, terms: int) -> str:
    return f"{total(terms, f'exp(({num(a)} + i) * ln({x}) - ({x}) - lgamma({num(a)} + i + 1))')}"


def _student_cdf(e: Any) -> str:
    """Four degrees of freedom have a closed form."""
    z = f"((x - {num(e.mu)}) / {num(e.sigma)})"
    u = f"(1 + {z} * {z} / 4)"
    return f"0.5 + 0.375 * {z} / sqrt({u}) * (1 - {z} * {z} / {u} / 12)"


def _von_mises_cdf(e: Any) -> str:
    """The trapezoid rule in 512 steps from -pi."""
    at = f"(-{PI} + (x + {PI}) * i / 512)"
    inner = total(513, f"(CASE WHEN i = 0 OR i = 512 THEN 0.5 ELSE 1 END) * exp({num(e.kappa)} * cos({at} - {num(e.mu)}))")
    whole = total(512, f"exp({num(e.kappa)} * cos(2 * {PI} * i / 512)) / 512")
    return f"({inner}) * (x + {PI}) / 512 / (2 * {PI} * ({whole}))"


CDF: dict[str, Callable[[Any], str]] = {
    "gaussian": lambda e: normal(f"((x - {num(e.mu)}) / {num(e.sigma)})"),
    "lognormal": lambda e: normal(f"((ln(x) - {num(e.mu)}) / {num(e.sigma)})"),
    "exponential": lambda e: f"1 - exp(-{num(e.lambda_)} * x)",
    "gamma": lambda e: f"CASE WHEN x > 0 THEN {incomplete_gamma(e.k, f'(greatest(x, 1e-300) / {num(e.theta)})', 300)} ELSE 0 END",
    "chi_squared": lambda e: incomplete_gamma(e.k / 2, "(x / 2)", 1500),
    "beta": lambda e: " + ".join(f"{math.comb(int(e.alpha + e.beta - 1), j)} * pow(x, {j}) * pow(1 - x, {int(e.alpha + e.beta - 1) - j})" for j in range(int(e.alpha), int(e.alpha + e.beta))),
    "uniform": lambda e: f"least(1, greatest(0, (x - {num(e.a)}) / ({num(e.b)} - {num(e.a)})))",
    "weibull": lambda e: f"1 - exp(-pow(x / {num(e.lambda_)}, {num(e.k)}))",
    "pareto": lambda e: f"1 - pow({num(e.xm)} / greatest(x, {num(e.xm)}), {num(e.k)})",
    "rayleigh": lambda e: f"1 - exp(-x * x / {num(2 * e.sigma**2)})",
    "student_t": _student_cdf,
    "von_mises": _von_mises_cdf,
    "discrete": lambda e: "CASE " + " ".join(f"WHEN x < {i + 1} THEN {num(sum(e.probs[: i + 1]))}" for i in range(len(e.probs))) + " ELSE 1 END",
    "poisson": lambda e: f"least(1, {total('floor(x) + 1', f'exp(i * ln({num(e.lambda_)}) - {num(e.lambda_)} - lgamma(i + 1.0))')})",
    "binomial": lambda e: f"least(1, {total('floor(x) + 1', f'exp(lgamma({num(e.n + 1)}) - lgamma(i + 1.0) - lgamma({num(e.n + 1)} - i) + i * ln({num(e.p)}) + ({num(e.n)} - i) * ln({num(1 - e.p)}))')})",
    "negative_binomial": lambda e: f"least(1, {total('floor(x) + 1', f'exp(lgamma(i + {num(e.r)}) - lgamma(i + 1.0) - lgamma({num(e.r)}) + {num(e.r)} * ln({num(e.p)}) + i * ln({num(1 - e.p)}))')})",
}

#: Moments besides the mean and the variance; these from the parameters in closed form.
_BENT = f"({total(512, f'cos(2 * {PI} * i / 512) * exp(k * cos(2 * {PI} * i / 512))')} / {total(512, f'exp(k * cos(2 * {PI} * i / 512))')})"
_ENTROPY = lambda e: "-(" + " + ".join(f"{p!r} * ln({p!r})" for p in e.probs if p > 0) + ")"
_SUM = lambda e, power: " + ".join(f"{p!r} * {i**power}" for i, p in enumerate(e.probs))
MOMENTS: dict[str, Callable[[Any], dict[str, str]]] = {
    "gaussian": lambda e: {"mean": num(e.mu), "variance": f"pow({num(e.sigma)}, 2)"},
    "exponential": lambda e: {"mean": f"1 / {num(e.lambda_)}", "variance": f"pow({num(e.lambda_)}, -2)"},
    "gamma": lambda e: {"mean": f"{num(e.k)} * {num(e.theta)}", "variance": f"{num(e.k)} * pow({num(e.theta)}, 2)", "mode": f"({num(e.k)} - 1) * {num(e.theta)}", "rate": f"1 / {num(e.theta)}"},
    "lognormal": lambda e: {
        "mean": f"exp({num(e.mu)} + pow({num(e.sigma)}, 2) / 2)", "variance": f"(exp(pow({num(e.sigma)}, 2)) - 1) * exp(2 * {num(e.mu)} + pow({num(e.sigma)}, 2))",
        "mode": f"exp({num(e.mu)} - pow({num(e.sigma)}, 2))", "median": f"exp({num(e.mu)})",
    },
    "beta": lambda e: {"mean": num(e.alpha) + f" / {num(e.alpha + e.beta)}", "variance": f"{num(e.alpha * e.beta)} / ({num((e.alpha + e.beta) ** 2)} * {num(e.alpha + e.beta + 1)})"},
    "uniform": lambda e: {"mean": f"({num(e.a)} + {num(e.b)}) / 2", "variance": f"pow({num(e.b)} - {num(e.a)}, 2) / 12"},
    "weibull": lambda e: {
        "mean": f"{num(e.lambda_)} * exp(lgamma(1 + 1 / {num(e.k)}))",
        "variance": f"pow({num(e.lambda_)}, 2) * (exp(lgamma(1 + 2 / {num(e.k)})) - exp(2 * lgamma(1 + 1 / {num(e.k)})))",
    },
    "pareto": lambda e: {"mode": num(e.xm), "median": f"{num(e.xm)} * pow(2, 1 / {num(e.k)})"},
    "rayleigh": lambda e: {"mean": f"{num(e.sigma)} * sqrt({PI} / 2)", "variance": f"(4 - {PI}) / 2 * pow({num(e.sigma)}, 2)", "mode": num(e.sigma), "median": f"{num(e.sigma)} * sqrt(2 * ln(2))"},
    "student_t": lambda e: {"mean": num(e.mu), "variance": f"pow({num(e.sigma)}, 2) * {num(e.df)} / ({num(e.df)} - 2)", "mode": num(e.mu)},
    "chi_squared": lambda e: {"mean": num(e.k), "variance": f"2 * {num(e.k)}", "mode": f"{num(e.k)} - 2"},
    "von_mises": lambda e: {"mean": num(e.mu)} | {n: f"(SELECT 1 - {_BENT} FROM (SELECT {num(e.kappa)} AS k))" for n in ("variance", "circular_variance")},
    "discrete": lambda e: {"mean": _SUM(e, 1), "variance": f"{_SUM(e, 2)} - pow({_SUM(e, 1)}, 2)", "mode": "0", "entropy": _ENTROPY(e), "probability_sum": "1"},
    "poisson": lambda e: {"mean": num(e.lambda_), "variance": num(e.lambda_)},
    "binomial": lambda e: {"mean": f"{e.n} * {num(e.p)}", "variance": f"{e.n} * {num(e.p)} * (1 - {num(e.p)})"},
    "negative_binomial": lambda e: {
        "mean": f"{num(e.r)} * (1 - {num(e.p)}) / {num(e.p)}", "variance": f"{num(e.r)} * (1 - {num(e.p)}) / pow({num(e.p)}, 2)", "mode": f"floor(({num(e.r)} - 1) * (1 - {num(e.p)}) / {num(e.p)})",
        "skewness": f"(2 - {num(e.p)}) / sqrt({num(e.r)} * (1 - {num(e.p)}))", "kurtosis": f"6 / {num(e.r)} + pow({num(e.p)}, 2) / ({num(e.r)} * (1 - {num(e.p)}))",
    },
}
