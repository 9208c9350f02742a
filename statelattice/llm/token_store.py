"""Token ids in a content-addressed binary store, in ascending document order."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunk_store import ITEMS, gear_cuts, item_batch, read_back, write_store
from .common import join_spread, materialize

#: Encoded words that a worker remembers, and the longest word it does (characters).
WORDS, CHARS = 1_000_000, 64
#: Bytes of text from which texts are encoded together, and rows at most.
TOGETHER, ROWS = 6 << 20, 4096
# The normaliser and the pre-tokeniser for which words can be encoded one by one, and the pieces that
# this pre-tokeniser makes of a normalised text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPLIT = regex.compile(PIECES)
#: Up to here (U+023F) every character is its own NFC form and lower case goes character by character; in UTF-8, no
#: byte of them is above PLAIN_BYTE and each byte of the characters beyond starts with one that is.
PLAIN, PLAIN_BYTE = "\u023f", 0xC8

# Bytes of plain text by kind: white space, letters, digits, signs, and those whose kind isn't plain from the byte alone
# or which may be part of a piece of two kinds (the apostrophe).
SPACE, LETTER, DIGIT, SIGN, UNCLEAR = range(5)
KIND = np.full(256, UNCLEAR, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[*range(9, 14), 0x20]] = SPACE
KIND[ord("'")] = UNCLEAR


def _parts_here() -> np.ndarray:
    """Whether a part of a text starts between bytes of two kinds, at 8 * kind before + kind after: where PIECES surely
    ends a piece, and never beside what is unclear but for white space."""
    out = np.zeros(64, bool)
    for a in range(5):
        for b in range(1, 5):
            out[8 * a + b] = a == SPACE or (UNCLEAR not in (a, b) and (a != b or a == DIGIT))
    return out


STARTS = _parts_here()


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def by_words(path: str) -> bool:
    """Whether a tokenizer file normalises and splits as NORMALIZER and PRE_TOKENIZER do, and its added tokens all
    start with `<|`, so that its ids for a text are those of its words in turn."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    plain = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in config["added_tokens"])
    return config["normalizer"] == NORMALIZER and config["pre_tokenizer"] == PRE_TOKENIZER and plain and config["model"]["type"] == "BPE" and not config["model"]["dropout"]


class WordEncoder(dict):
    """Ids (as bytes) of words, for a tokenizer whose words end at white space (by_words); of whole texts for others.

    Each distinct word is encoded once; plain texts are cut and looked up many at a time (encode_all). A word of plain characters is lower-cased and split here, and what can't be
    split goes to the library's BPE model. Any other word goes through the whole library pipeline.
    """

    def __init__(self, path: str, unit: str) -> None:
        super().__init__({"": b""})
        self.tokenizer, letters = Tokenizer.from_file(path), byte_alphabet()
        self.model, self.by_words = self.tokenizer.model, by_words(path)
        self.letters = {b: letters[b] for b in range(256)}
        self.packed = [x.tobytes() for x in np.arange(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=unit)]

    def trim(self) -> None:
        """Starts anew where the memory is full; until then the words that came first, the frequent ones, stay."""
        if len(self) >= WORDS:
            self.clear()
            self[""] = b""

    def _library(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokeniser leaves whole, in lower case."""
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(piece)])

    def __missing__(self, word: str) -> bytes:
        if "<|" in word or not (word.isascii() or max(word) <= PLAIN):
            ids = self._library(word)
        elif (low := word.lower()) != word:
            ids = self[low]
        elif word.isalpha():
            ids = self._piece(word)
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        else:
            parts = SPLIT.findall(word)
            ids = self._piece(word) if parts == [word] else b"".join([self[p] for p in parts])
        if len(word) <= CHARS and len(self) < WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if self.by_words else self._library(text)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts in lower case, without `<|`: each distinct part of theirs is looked up once."""
        data = np.frombuffer(b" ".join([b"", *texts]), np.uint8)
        kind = KIND[data]
        starts = np.concatenate([[False], STARTS[(kind[:-1] << 3) | kind[1:]]])
        ends = np.cumsum([1 + len(x) for x in texts])
        last = np.searchsorted(np.flatnonzero(starts), ends)  # parts up to the end of each text
        solid = kind != SPACE
        offsets = np.append(np.flatnonzero(starts[solid]), np.count_nonzero(solid)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
        ids = pa.array(list(map(self.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False).tolist())), pa.binary()).take(parts.indices)
        at = np.append(0, np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[last]) if len(ids) else np.zeros(len(texts) + 1, np.int32)
        joined = ids.buffers()[2].to_pybytes() if len(ids) else b""
        return [joined[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8; what isn't counts as U+FFFD)."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners: list[int] = []
        held: list[bytes] = []

        def finish() -> None:
            for i, ids in zip(owners, self._together(held) if held else [], strict=True):
                out[i].append(ids)
            owners.clear()
            held.clear()

        room = TOGETHER
        for i, text in enumerate(texts):
            plain = text.isascii() or np.frombuffer(text, np.uint8).max() <= PLAIN_BYTE
            if not (self.by_words and plain) or b"<|" in text:
                out[i].append(self.encode(text.decode("utf-8", "replace")))
                continue
            text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
            at = 0
            while at < len(text):  # a very long text goes on at white space
                end = text.find(b" ", at + TOGETHER) if len(text) - at > TOGETHER else -1
                end = len(text) if end < 0 else end
                owners.append(i)
                held.append(text[at:end])
                room -= end - at
                at = end
                if room <= 0:
                    finish()
                    room = TOGETHER
        finish()
        return [b"".join(x) for x in out]


def encode_words(docs: DataFrame, path: str, end_id: int, cuts: Callable[[bytes], list[int]], unit: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as items of the chunk store: ids of the whole text and end_id as integers of type `unit`. A null text has
    the end id alone."""
    end = np.array([end_id], unit).tobytes()
    memo = docs.sparkSession.sparkContext.broadcast({})  # one dict in each worker process, kept from task to task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo.value.get("encoder")
        if encoder is None:
            encoder = memo.value["encoder"] = WordEncoder(path, unit)
        encoder.trim()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [x + end for x in encoder.encode_all([x.as_py() or b"" for x in part.column(1)])]
                yield item_batch(part.column(0), pa.nulls(len(ids), pa.int64()), ids, cuts)

    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("key"), text.alias("text")).mapInArrow(run, ITEMS)


def _starts(recipes: DataFrame, size: int) -> DataFrame:
    """(doc_id, sha, start): the ids that the files hold before each item, `size` bytes each.

    Files are summed each by itself; only one sum per file is gathered."""
    rows = recipes.withColumn("n", F.floor(F.col("size") / size).cast("long"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n").alias("ids")).select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    within = F.sum("n").over(Window.partitionBy("file").orderBy("place")) - F.col("n")
    rows = rows.withColumn("within", within).join(F.broadcast(files), "file")  # one row a file
    return rows.select(F.col("key").alias("doc_id"), "sha", (F.col("offset") + F.col("within")).alias("start"))


def _figures(unit: str, data: bytes, recipe: bytes) -> tuple:
    ids = np.frombuffer(data, unit)
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of docs, read back from the files that this writes.

    The id stream of all documents in ascending doc_id order (nulls first; rows that share an id by length and
    content) is cut per document by a rolling hash on id boundaries. Each distinct chunk is stored once, in that
    order; every document has a recipe with a Merkle root in the files, in that order too, and all figures come from
    these files, the ids rebuilt and verified. A null or empty text has the end id alone; very long texts are many
    chunks of one item, and one item must fit into a task. Null and repeated ids and equal rows are items like others.
    An empty table gives an empty result; other columns aren't read.
    """
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    unit = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
    cuts = partial(gear_cuts, unit=unit.itemsize)
    store = write_store(encode_words(docs, path, end_id, cuts, unit.str, id_col, text_col), "tokens", ("key", "size", "sha"))
    spark = docs.sparkSession
    values = read_back(store, spark, partial(_figures, unit.str), [("n_tokens", "long", pa.int64()), ("ids_crc32", "long", pa.int64())])
    starts = materialize(_starts(store.recipes(spark), unit.itemsize), "token-starts")
    return join_spread(starts, values, "sha").select("doc_id", "start", "n_tokens", "ids_crc32")
