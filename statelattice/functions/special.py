"""Special functions of parameters (driver side) and of NumPy arrays (inside Arrow batches)."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator

import numpy as np

INF = math.inf
# Thresholds that decide which fits count as degenerate.
ZERO = 1e-30
MIN_SD = 1e-6
LIMIT = 1e-6
MAX_PARAMETER, MIN_PARAMETER = 1e6, 1e-6
MIN_DF, MAX_DF = 0.1, 1000.0
MIN_VAR = 1e-6
RIDGE = 1e-5
EM_TOLERANCE = 3e-7


def _climb(x, least: float, term: Callable):  # noqa: ANN001, ANN202
    """Shifts x up to `least` by the recurrence whose terms are term(x); the shifted x and the sum."""
    x = np.asarray(x, float).copy()
    total = np.zeros_like(x)
    while (low := x < least).any():
        total = np.where(low, total + term(np.where(low, x, 1.0)), total)
        x = np.where(low, x + 1, x)
    return x, total


# Bernoulli numbers B2, B4, ... as the asymptotic series use them.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def digamma(x):  # noqa: ANN001, ANN201
    y, shift = _climb(x, 8.0, lambda v: 1 / v)
    series = sum(b / (2 * k) * y ** (-2 * k) for k, b in enumerate(BERNOULLI, 1))
    out = np.log(y) - 0.5 / y - series - shift
    return float(out) if out.ndim == 0 else out


def trigamma(x):  # noqa: ANN001, ANN201
    y, shift = _climb(x, 8.0, lambda v: 1 / v**2)
    series = sum(b * y ** (-2 * k - 1) for k, b in enumerate(BERNOULLI, 1))
    out = 1 / y + 0.5 / y**2 + series + shift
    return float(out) if out.ndim == 0 else out


def lgamma(x):  # noqa: ANN001, ANN201
    """ln |gamma(x)| for x > 0; inf elsewhere."""
    x = np.asarray(x, float)
    good = np.isfinite(x) & (x > 0)
    y, shift = _climb(np.where(good, x, 8.0), 8.0, np.log)
    series = sum(b / (2 * k * (2 * k - 1)) * y ** (1 - 2 * k) for k, b in enumerate(BERNOULLI, 1))
    out = np.where(good, (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift, INF)
    return float(out) if out.ndim == 0 else out


def log_factorial(k):  # noqa: ANN001, ANN201
    """ln k!; inf for negative k."""
    k = np.asarray(k, float)
    out = np.where(k < 0, INF, lgamma(np.where(k < 0, 0, k) + 1))
    return float(out) if out.ndim == 0 else out


def erf(x):  # noqa: ANN001, ANN201
    x = np.asarray(x, float)
    out = np.vectorize(math.erf, otypes=[float])(x) if x.size else x.copy()
    return float(out) if out.ndim == 0 else out


def erf_inv(y: float) -> float:
    """The inverse of erf on (-1, 1): an explicit start (Winitzki) and Halley steps."""
    if not -1 < y < 1:
        return math.copysign(INF, y) if abs(y) == 1 else math.nan
    if y == 0:
        return 0.0
    half = math.log1p(-y * y) / 2
    head = 2 / (math.pi * 0.147) + half
    x = math.copysign(math.sqrt(math.sqrt(head * head - 2 * half / 0.147) - head), y)
    for _ in range(3):
        step = (math.erf(x) - y) / (2 / math.sqrt(math.pi) * math.exp(-x * x))
        x -= step / (1 + x * step)
    return x


def log_i0(x: float) -> float:
    """ln I0(x) for x >= 0: the power series for small x, else the large-argument series."""
    if x < 30:
        term, total, k = 1.0, 1.0, 1
        while term > 1e-17 * total:
            term *= (x / 2) ** 2 / k**2
            total, k = total + term, k + 1
        return math.log(total)
    return x - 0.5 * math.log(2 * math.pi * x) + math.log(_hankel(x, 0))


def _hankel(x: float, order: int) -> float:
    term, total = 1.0, 1.0
    for k in range(1, 30):
        step = term * -(4 * order**2 - (2 * k - 1) ** 2) / (8 * k * x)
        if abs(step) >= abs(term):
            break
        term = step
        total += term
    return total


def bessel_ratio(x: float) -> float:
    """I1(x) / I0(x) for x >= 0."""
    if x >= 30:
        return _hankel(x, 1) / _hankel(x, 0)
    num, den, a, b, k = x / 2, 1.0, x / 2, 1.0, 1
    while a > 1e-17 * num or b > 1e-17 * den:
        b *= (x / 2) ** 2 / k**2
        a *= (x / 2) ** 2 / (k * (k + 1))
        num, den, k = num + a, den + b, k + 1
    return num / den


def bessel_i0(x: float) -> float:
    return math.exp(log_i0(abs(x)))


def bessel_i1(x: float) -> float:
    return math.copysign(bessel_ratio(abs(x)) * bessel_i0(x), x) if x else 0.0


def gamma_p(a: float, x):  # noqa: ANN001, ANN201
    """Regularised lower incomplete gamma P(a, x): series below a + 1, continued fraction above."""
    x = np.asarray(x, float)
    safe = np.where(np.isfinite(x) & (x > 0), x, 1.0)
    scale = np.exp(a * np.log(safe) - safe - lgamma(a))
    term = np.full_like(safe, 1 / a)
    total = term.copy()
    low = np.where(safe < a + 1, safe, 0)
    for k in range(1, 10_000):
        term = term * low / (a + k)
        total += term
        if (term <= 1e-16 * total).all():
            break
    high = np.where(safe < a + 1, a + 2, safe)
    b = high + 1 - a
    c, d = np.full_like(high, 1e300), 1 / b
    h = d.copy()
    for k in range(1, 10_000):
        step = -k * (k - a)
        b = b + 2
        d, c = 1 / (step * d + b), b + step / c
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    out = np.where(safe < a + 1, total * scale, 1 - scale * h)
    out = np.where(x <= 0, 0.0, np.where(np.isposinf(x), 1.0, np.where(np.isnan(x), np.nan, out)))
    return float(out) if out.ndim == 0 else out


def beta_i(x, a: float, b: float):  # noqa: ANN001, ANN201
    """Regularised incomplete beta I_x(a, b) by the continued fraction, mirrored where that converges better."""
    x = np.clip(np.asarray(x, float), 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inside = (y > 0) & (y < 1)
    y = np.where(inside, y, 0.5)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 2000):
        change = np.ones_like(y)
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = d * c
            h = h * change
        if (np.abs(change - 1) < 1e-15).all():
            break
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    part = front * h
    out = np.where(flip, 1 - part, part)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    return float(out) if out.ndim == 0 else out


Search = Generator[list[float], list[float], float]


def root_search(start: float, low: float, high: float, tolerance: float = 1e-12) -> Search:
    """The place in [low, high] where a function of a positive number turns from negative to positive.

    A coroutine: it yields several places at a time and is sent the function's values there, so that one pass over the
    data answers a whole round. A ladder of powers of four about `start` climbs until it holds the root; then each
    round takes a finer ladder about the root of a curve through the places nearest to it. The end of the range is
    returned where the function doesn't change sign. Values that aren't finite are passed over."""
    known: dict[float, float] = {}
    wanted = sorted({min(max(start * 4.0**i, low), high) for i in range(-3, 4)})
    guess = start
    for _ in range(60):
        for x, f in zip(wanted, (yield wanted), strict=True):
            if math.isfinite(f):
                known[x] = f
        below, above = [x for x in known if known[x] < 0], [x for x in known if known[x] >= 0]
        if not known:
            return start
        if not above or not below:
            edge, limit = (max(below), high) if below else (min(above), low)
            if edge == limit:
                return limit
            out = 4.0 if below else 0.25
            wanted = sorted({min(max(edge * out**i, low), high) for i in range(1, 8)})
            continue
        a, b = max(below), min(above)
        if a > b or b - a <= tolerance * b or known[b] == 0:
            return b
        near = sorted(known, key=lambda x: abs(math.log(x) - math.log(a) / 2 - math.log(b) / 2))[:4]
        last, guess = guess, _through(near, [known[x] for x in near])
        if not a < guess < b:
            guess = math.sqrt(a * b)
        elif abs(guess - last) <= tolerance * guess:
            return guess
        width = math.log(b / a)
        wanted = sorted({x for u in (-0.2, -1e-2, -1e-4, 0.0, 1e-4, 1e-2, 0.2) if a < (x := guess * math.exp(u * width)) < b} | {math.sqrt(a * b)} - {a, b})
    return guess


def _through(xs: list[float], fs: list[float]) -> float:
    """Where a polynomial of ln x in f through the given points has f = 0 (Neville's scheme)."""
    at = [math.log(x) for x in xs]
    for size in range(1, len(xs)):
        for i in range(len(xs) - size):
            gap = fs[i] - fs[i + size]
            at[i] = (fs[i] * at[i + 1] - fs[i + size] * at[i]) / gap if gap else math.inf
    return math.exp(at[0]) if abs(at[0]) < 700 else math.inf


def solve(f: Callable[[float], float], start: float, low: float, high: float) -> float:
    """root_search for a function that is at hand."""
    search = root_search(start, low, high)
    try:
        wanted = next(search)
        while True:
            wanted = search.send([f(x) for x in wanted])
    except StopIteration as end:
        return end.value
