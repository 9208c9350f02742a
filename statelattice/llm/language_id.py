"""Language identification by multilingual mixture inference.

Each language has a smoothed model of letter trigrams. A document is taken as a mixture: expectation-maximisation
estimates the share of each language from the trigrams' likelihoods, and the set of languages is grown from the
largest share as long as the penalised likelihood (BIC over the effective number of trigrams) improves. The largest
share of the chosen set is the prediction, the share its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from .common import lean, map_texts

#: Buckets of hashed trigrams; documents of each language that are fitted on, at most; EM steps, at most.
BUCKETS, SAMPLE, STEPS = 1 << 16, 1000, 20
#: Overlapping trigrams carry about a third of the evidence of independent ones.
EVIDENCE = 1 / 3

_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    out = _letters[0][np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        out[at] = chr(codes[at]).isalpha()
    return out


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text in lower case, words set apart by one space; none without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _is_letter(codes)
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:]
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages in ascending order and the log-likelihood of each bucket under each."""

    languages: tuple[str, ...]
    loglik: np.ndarray  # BUCKETS x languages, float32


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: Column | None = None, sample: int = SAMPLE) -> Model:
    """The model of labelled rows: of each language about `sample` rows at most, the whole texts of those that a
    hash of `order` (the text by default) puts first, so reruns agree. Rows without text or language are left out."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(F.col(text_col) if order is None else order), F.lit(1_000_003))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), _text(text_col), place.alias("place"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("m"))
    # twice the wanted share by hash first, so that no language is ever sorted as a whole
    near = rows.join(F.broadcast(sizes), "lang").where(F.col("place") < 2 * sample * 1_000_003 / F.col("m"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", F.xxhash64("text")))
    chosen = near.withColumn("nth", nth).where(F.col("nth") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = total.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text.as_py().decode("utf-8", "replace")), minlength=BUCKETS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    found = chosen.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    languages = tuple(sorted(found["lang"].unique()))
    counts = np.zeros((BUCKETS, len(languages)))
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    return Model(languages, np.log((counts + 0.1) / (counts + 0.1).sum(0)).astype(np.float32))


def _mixture(like: np.ndarray, weight: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """EM from `shares`; the log-likelihood is that of the last shares but one step."""
    total = weight.sum()
    for _ in range(STEPS):
        mix = like @ shares
        last, shares = shares, shares * ((weight / mix) @ like) / total
        if np.abs(shares - last).max() < 1e-3:
            break
    return shares, float(weight @ np.log(like @ shares))


def infer(text: str, model: Model) -> tuple[str, float, dict[str, float]]:
    """(prediction, score, shares of the chosen languages); `und` with 0 where there are no letters."""
    found = trigrams(text)
    if not len(found) or not model.languages:
        return "und", 0.0, {}
    counts = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    weight = counts[at] * EVIDENCE
    log = model.loglik[at].astype(np.float64)
    top = log.max(1, keepdims=True)
    like = np.exp(log - top)
    shares, _ = _mixture(like, weight, np.full(len(model.languages), 1 / len(model.languages)))
    order = np.argsort(-shares, kind="stable")
    chosen, best = order[:1], float(weight @ (log - top)[:, order[0]])
    share = np.ones(1)
    for size in range(2, len(order) + 1):
        if shares[order[size - 1]] < 0.005:
            break
        trial = order[:size]
        own, score = _mixture(like[:, trial], weight, np.maximum(shares[trial], 1e-3) / np.maximum(shares[trial], 1e-3).sum())
        if score - best <= max(1.0, np.log(weight.sum())):
            break
        chosen, best, share = trial, score, own
    first = int(np.argmax(share))
    return model.languages[chosen[first]], float(min(1.0, share[first])), {model.languages[c]: float(s) for c, s in zip(chosen, share, strict=True)}


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with {prefix}pred, {prefix}score and {prefix}shares (map) from whole texts alone.

    Texts that are null or have no letters get `und`, 0 and an empty map. An existing column of one of these
    names is replaced; all others, and the number of rows, stay.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.loglik))  # fixed size: BUCKETS floats a language
    names = [f"{prefix}pred", f"{prefix}score", f"{prefix}shares"]
    kinds = [(StringType(), pa.string()), (DoubleType(), pa.float64()), (MapType(StringType(), DoubleType()), pa.map_(pa.string(), pa.float64()))]

    def one(text: str | None) -> tuple:
        pred, score, shares = infer(text or "", Model(*held.value))
        return pred, score, list(shares.items())

    return map_texts(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, dict(zip(names, kinds, strict=True)), one)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fits on the rows that aren't held out and predicts every row."""
    learn = docs.where(~held_out(F.col(id_col))).select(text_col, lang_col, id_col)
    model = fit(learn, text_col, lang_col, F.col(id_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


