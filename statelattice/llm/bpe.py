"""Byte-level BPE with a hierarchical-bitmap rank queue.

The pre-tokens that a batch meets for the first time lie end to end in one buffer, each a linked list of tokens, and
share one queue. A pair's merge rank names a bucket, which holds the positions where that pair stands; a two-level
bitmap marks the buckets that aren't empty, and find-first-set gives the lowest rank. A bucket is worked off from the
left; where a merge makes a pair of lower rank, that one goes first. Entries whose pair has changed since are skipped
when they come up. A merge touches two neighbours, so n bytes take O(n log n) however long a pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Ranks in one word of the lower bitmap.
WORD = 256
#: Encoded pre-tokens that a task remembers, and the longest it does (characters).
CACHE, CACHE_CHARS = 400_000, 64
#: Pre-tokens that share a queue: its lists should stay in the processor's caches.
TOGETHER = 1000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """The merges of one rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the single bytes {missing}")
        #: Ids of single bytes, and ranks of pairs of these (-1: none).
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.double = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        data = b"".join(pieces)
        raw = np.frombuffer(data, np.uint8)
        stops = np.cumsum(sizes)
        rank = np.full(len(data), -1, np.int64)
        rank[:-1] = self.double[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank[stops[sizes > 0] - 1] = -1  # a pre-token's last byte has no partner
        found = np.flatnonzero(rank >= 0)
        found = found[np.argsort(rank[found], kind="stable")]
        kinds, first = np.unique(rank[found], return_index=True)
        buckets = {k: b.tolist() for k, b in zip(kinds.tolist(), np.split(found, first[1:]), strict=False)} if len(kinds) else {}
        ids = self.single[raw].tolist()
        self._run(data, rank.tolist(), buckets, np.repeat(stops, sizes).tolist(), ids)
        ids = np.array(ids, np.int64)
        tokens = ids >= 0
        before = np.concatenate([[0], np.cumsum(tokens)])
        return np.split(ids[tokens].astype("<u4"), before[stops[:-1]])

    def _run(self, data: bytes, now: list[int], buckets: dict[int, list[int]], stop: list[int], ids: list[int]) -> None:
        """Merges until the queue is empty; `ids` gets a token's id at its first byte and -1 at the others.

        now[i] is the rank of the pair that starts at i, stop[i] where the pre-token of i ends."""
        rank_of = self.ranks.get
        end = list(range(1, len(data) + 1))  # of the token that starts here
        before = list(range(-1, len(data)))  # start of the token before the one that starts here
        top, words = 0, {}  # bit w of top: word w isn't 0; bit r of word w: bucket w * WORD + r isn't empty
        for rank in buckets:
            words[rank // WORD] = words.get(rank // WORD, 0) | 1 << rank % WORD
            top |= 1 << rank // WORD
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word * WORD + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            lower = False
            while bucket and not lower:
                at = heappop(bucket)
                if now[at] != rank:
                    continue  # stale
                middle = end[at]
                after = end[at] = end[middle]
                ids[at] = rank
                ids[middle] = now[middle] = now[at] = -1
                last = stop[at]
                if after < last:
                    before[after] = at
                    new = rank_of(data[at : end[after]])
                    if new is not None:
                        now[at] = new
                        if waiting := buckets.get(new):
                            heappush(waiting, at)
                        else:
                            buckets[new] = [at]
                            words[new // WORD] = words.get(new // WORD, 0) | 1 << new % WORD
                            top |= 1 << new // WORD
                        lower |= new < rank
                left = before[at]
                if left >= 0 and stop[left] == last:
                    new = rank_of(data[left:after])
                    if new is None:
                        now[left] = -1
                    else:
                        now[left] = new
                        if waiting := buckets.get(new):
                            heappush(waiting, left)
                        else:
                            buckets[new] = [left]
                            words[new // WORD] = words.get(new // WORD, 0) | 1 << new % WORD
                            top |= 1 << new // WORD
                        lower |= new < rank
            if not bucket:
                bits = words[word] & ~(1 << rank % WORD)
                words[word] = bits
                if not bits:
                    top &= ~(1 << word)


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.merger = Merger(self.ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def trim(self) -> None:
        """Forgets all where the memory is full; until then the pre-tokens that came first, the frequent ones, stay."""
        if len(self.known) >= CACHE:
            self.known.clear()

    def _merged(self, pieces: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(pieces), TOGETHER):
            for ids in self.merger.merge(pieces[at : at + TOGETHER]):
                yield ids.tobytes()

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        known, ranks = self.known, self.ranks
        split = [self.split(t) for t in texts]
        new = list(set().union(*split).difference(known))
        raw = [p.encode() for p in new]
        whole = [ranks.get(r) for r in raw]  # most pre-tokens that are new aren't tokens
        some = self._merged([r for r, w in zip(raw, whole, strict=True) if w is None])
        for piece, rank in zip(new, whole, strict=True):
            known[piece] = next(some) if rank is None else rank.to_bytes(4, "little")
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        over = len(known) - CACHE
        for piece in new:
            if over > 0 or len(piece) > CACHE_CHARS:
                del known[piece]
                over -= 1
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary]): one row for each row of docs.

    ids are little-endian unsigned 32-bit integers; the two digests are lower-case hex, the second of the bytes
    that these ids decode to. Special tokens aren't recognised. A null text counts as empty: no ids, and the
    digests of nothing. Rows with a null or repeated id are encoded like others. A very long text, or one that is a
    single pre-token, is encoded whole. An empty table gives an empty result. Other columns, whatever their names,
    aren't read.
    """

    memo = docs.sparkSession.sparkContext.broadcast({})  # one dict in each worker process, kept from task to task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = memo.value.get("codec")
        if codec is None:
            codec = memo.value["codec"] = Codec(path, pattern)
        codec.trim()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = codec.encode_all([(x.as_py() or b"").decode("utf-8", "replace") for x in part.column(1)])
                n = [len(data) // 4 for data in raw]
                sha = [hashlib.sha256(data).hexdigest() for data in raw]
                back = [hashlib.sha256(codec.decode(np.frombuffer(data, "<u4"))).hexdigest() for data in raw]
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    text: Column = F.col(text_col).cast("string").cast("binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), schema)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) of encoded(doc_id, ids binary); null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            data = [x.is_valid and codec.decode(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is False else x for x in data], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, data binary")
