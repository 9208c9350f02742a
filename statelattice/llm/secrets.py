"""Secret scanning: fixed patterns, and tokens that a battery of randomness tests accepts.

A token of TOKEN_CHARS characters or more gets an encoding from its characters: hex, base32, base36 (each in either
case), base62 or base64 (with + and / or - and _). Tokens with such signs that aren't base64 are split at them, and all
at `=`. A token needs digits and letters: words and numbers have no encoding. For its symbols the battery takes

* chi-squared against a uniform alphabet,
* the runs test about the middle of the alphabet,
* the lag-1 serial correlation,

and combines them (Bonferroni) to one p-value of randomness; below REJECT the token is left. That alone would accept
short ordinary words, so discoveries are controlled against ordinary text: under the first-order transition counts of
the whole corpus but for these tokens, the likelihood ratio of text to uniform symbols is a valid p-value (its inverse
has a mean of 1 over text), and it falls with length. Weighted Benjamini-Hochberg at level FDR within bands of length, the weights being
twice the battery's p-values, turns these into one cut-off per band; every token with an encoding counts as a test.
Everything that is gathered is of fixed size: 128 x 128 pair counts, and counts of p-values by band and bin.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import lean, map_texts

# The base kinds in their listed order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("passw", "secret", "token", "key")

#: Shortest token that is tested: 16 symbols of hex are 64 bits, and shorter runs hold hardly any evidence.
TOKEN_CHARS = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_CHARS)
SIGNS = re.compile(r"[+/_-]+")
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried.
ALPHABETS = {
    "hex": _DIGITS + _LOWER[:6],
    "HEX": _DIGITS + _UPPER[:6],
    "base32": _LOWER + "234567",
    "BASE32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {name: frozenset(alphabet) for name, alphabet in ALPHABETS.items()}
_PLACES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ALPHABETS.items()}
REJECT, FDR = 0.01, 0.01
#: P-values are counted in bins of a tenth of a decade; lengths in bands by powers of the square root of 2.
BINS, BANDS = 400, 40

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base kinds' spans (kind, start, end), by start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in RUN.finditer(text):  # a run of 24 hex digits lies within one of these
        if run.end() - run.start() >= 24:
            out += [("hex", run.start() + m.start(), run.start() + m.end()) for m in HEX.finditer(run[0]) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def encoding_of(token: str) -> tuple[str, np.ndarray] | None:
    """The first encoding whose alphabet has all characters, and the symbols' places in it; none for a token without
    digits or without letters, and base64 with signs only where both cases and digits occur."""
    chars = set(token)
    digit, upper, lower = (not chars.isdisjoint(x) for x in (_DIGITS, _UPPER, _LOWER))
    if not digit or not (upper or lower):
        return None
    for name, alphabet in _SETS.items():
        if chars <= alphabet:
            if name.startswith("base64") and not (upper and lower):
                return None
            return name, np.array([_PLACES[name][c] for c in token])
    return None


def _tokens(text: str) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """(start, end, encoding, symbols) of every token with an encoding; `end` takes in padding."""
    for run in RUN.finditer(text):
        at = run.start()
        for piece in run[0].split("="):
            here, at = at, at + len(piece) + 1
            if len(piece) < TOKEN_CHARS:
                continue
            if found := encoding_of(piece):
                end = here + len(piece)
                while end < run.end() and end < here + len(piece) + 2 and text[end] == "=" and (end + 1 == run.end() or text[end + 1] == "="):
                    end += 1
                yield here, end, *found
                continue
            for part in re.finditer(r"[A-Za-z0-9]{%d,}" % TOKEN_CHARS, piece):
                if found := encoding_of(part[0]):
                    yield here + part.start(), here + part.end(), *found


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness_p(symbols: np.ndarray, size: int) -> float:
    """The battery's p-value that the symbols are uniform and independent: three times the least of its three."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=size)
    chi = size / n * float((counts.astype(float) ** 2).sum()) - n
    free = size - 1
    spread = 2 / (9 * free)
    p_chi = 0.5 * math.erfc((((chi / free) ** (1 / 3) - 1 + spread) / math.sqrt(spread)) / math.sqrt(2)) if chi > 0 else 1.0
    high = symbols >= size / 2
    a = int(high.sum())
    b = n - a
    p_runs = 0.0
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    x = symbols - symbols.mean()
    total = float((x * x).sum())
    p_serial = _two_sided((float((x[1:] * x[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def band_of(n: int) -> int:
    return min(BANDS - 1, int(2 * math.log2(n)))


@dataclass(frozen=True)
class Model:
    """Counts of ASCII characters after one another in the corpus, and the largest accepted p-value by band of length
    (0: none)."""

    pairs: np.ndarray  # 128 x 128
    cuts: tuple[float, ...]


class TextNull:
    """Log-probabilities of symbols in ordinary text, for each encoding."""

    def __init__(self, pairs: np.ndarray) -> None:
        self.pairs, self.known = pairs.astype(float), {}

    def of(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """ln of (first symbol; symbol after symbol) given that all are of the encoding's alphabet."""
        if name not in self.known:
            at = np.array([ord(c) for c in ALPHABETS[name]])
            alone = self.pairs[:, at].sum(0) + 1
            alone /= alone.sum()
            after = self.pairs[np.ix_(at, at)] + alone  # one more observation a row, dealt as the symbols are
            self.known[name] = np.log(alone), np.log(after / after.sum(1, keepdims=True))
        return self.known[name]

    def p(self, symbols: np.ndarray, name: str) -> float:
        """The likelihood ratio of text to uniform symbols, 1 at most: over text its inverse has a mean of 1, so it is
        this small or smaller with no more than this probability."""
        first, after = self.of(name)
        text = float(first[symbols[0]] + after[symbols[:-1], symbols[1:]].sum())
        return math.exp(min(0.0, max(-690.0, text + len(symbols) * math.log(len(ALPHABETS[name])))))


def discovery_p(symbols: np.ndarray, name: str, null: TextNull) -> float:
    """The text null's p-value over its weight, twice the battery's; 1 where the battery rejects."""
    random = randomness_p(symbols, len(ALPHABETS[name]))
    return 1.0 if random < REJECT else min(1.0, null.p(symbols, name) / (2 * random))


def _bin(p: float) -> int:
    return min(BINS, int(-10 * math.log10(max(p, 1e-300))))


def _text(docs: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text")


def _ordinary(raw: bytes) -> bytes:
    """A text without its tokens, which would make themselves look ordinary."""
    text, at, out = raw.decode("utf-8", "replace"), 0, []
    for start, end, _, _ in _tokens(text):
        out.append(text[at:start])
        at = end
    return "\n".join([*out, text[at:]]).encode() if out else raw


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of docs: one pass for pair counts, one for the p-values of all tokens that have an encoding."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                raw = np.frombuffer(b"\n".join([_ordinary(x.as_py()) for x in batch.column(0).slice(at, 64)]), np.uint8)
                for start in range(0, len(raw) - 1, 1 << 22):  # very long texts in parts that overlap by one
                    part = raw[start : start + (1 << 22) + 1].astype(np.int64)
                    total += np.bincount(part[:-1] << 8 | part[1:], minlength=1 << 16)
        pairs = np.flatnonzero(total.reshape(256, 256)[:128, :128])
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(total.reshape(256, 256)[:128, :128].reshape(-1)[pairs], pa.int64())], ["pair", "n"])

    texts = docs.select(_text(docs, text_col))
    pairs = np.zeros(1 << 14, np.int64)
    for pair, n in texts.mapInArrow(lean(count), "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():  # 16,384 rows at most
        pairs[pair] = n
    pairs = pairs.reshape(128, 128)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null, total = TextNull(pairs), np.zeros((BANDS, BINS + 1), np.int64)
        for batch in batches:
            for x in batch.column(0):
                for _, _, name, symbols in _tokens(x.as_py().decode("utf-8", "replace")):
                    total[band_of(len(symbols)), _bin(discovery_p(symbols, name, null))] += 1
        band, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(at, pa.int32()), pa.array(total[band, at], pa.int64())], ["band", "bin", "n"])

    found = texts.mapInArrow(lean(test), "band int, bin int, n long").groupBy("band", "bin").agg(F.sum("n").alias("n")).collect()  # BANDS * BINS at most
    return Model(pairs, cuts_of([(r["band"], r["bin"], r["n"]) for r in found]))


def cuts_of(counted: list[tuple[int, int, int]]) -> tuple[float, ...]:
    """Benjamini-Hochberg's largest accepted p-value of each band, from (band, bin, tests)."""
    cuts = [0.0] * BANDS
    for band in range(BANDS):
        own = {at: n for b, at, n in counted if b == band}
        total, seen = sum(own.values()), 0
        for at in sorted(own, reverse=True):
            seen += own[at]
            if (p := 10 ** (-at / 10)) <= FDR * seen / total:
                cuts[band] = p
    return tuple(cuts)


def all_spans(text: str, model: Model, null: TextNull) -> tuple[list[Span], list[Span]]:
    """The base spans; these and the random tokens that touch none of them, by start and kind."""
    base = base_spans(text)
    extra: list[Span] = []
    for start, end, name, symbols in _tokens(text):
        cut = model.cuts[band_of(len(symbols))]
        if cut and 10 ** (-_bin(discovery_p(symbols, name, null)) / 10) <= cut and not any(a < end and start < b for _, a, b in base):
            extra.append(("random", start, end))
    return base, sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_secrets(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind as listed in KINDS, joined by
    commas; base_sha256 is over those of the first three kinds. Null and empty texts have none, and very long ones are
    read whole. Null or repeated ids are kept as they are; other columns, whatever their names, aren't read. An empty
    table gives an empty result. Without a model, one is fitted on docs.
    """
    model = model or fit(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null = TextNull(model.pairs)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                base, spans = all_spans(x.as_py().decode("utf-8", "replace"), model, null)
                kinds = [s[0] for s in spans]
                rows.append([*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)])
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(docs, text_col)).mapInArrow(
        lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    )


def redact_secrets(docs: DataFrame, model: Model | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by `mark`, overlapping ones once; null texts stay null, other columns
    and all rows as they are. Very long texts are read whole; an empty table gives an empty result."""
    model = model or fit(docs, text_col)

    null = TextNull(model.pairs)

    def one(text: str | None) -> tuple:
        if text is None:
            return (None,)
        out, at = [], 0
        for _, a, b in all_spans(text, model, null)[1]:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return ("".join([*out, text[at:]]),)

    return map_texts(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, {text_col: (StringType(), pa.string())}, one)
