"""BPE, token files, media, secrets and language identification."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statelattice.llm import bpe, chunk_store, common, language_id, media, secrets, token_store

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "\x00", "a\x1cb \x85 c", "Ǆ É x́ ́", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ'S it's'll", "a b　c\n\n", "İI ı ſ K ﬁ", "한국어", "x" * 3000, "ab " * 3000, "😀" * 50, "trailing\x00\x00"]
SCHEMA = "doc_id long, text string"


CODEC = bpe.Codec(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_pre_tokens():
    for text in ("a" * 5000, "ab" * 2500, "=-" * 2000, "the" * 2000):
        assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_bpe_table(spark):
    rows = [*enumerate(ODD), (None, "no id"), (0, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], f"{SCHEMA}, n_tokens int")
    want = []
    for i, t in rows:
        ids = np.array(LIBRARY.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    found = [(*tuple(r)[:4], bytes(r["ids"])) for r in bpe.encode_texts(df, RANKS, P.PATTERN).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    back = bpe.decode_ids(bpe.encode_texts(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode_texts(df.where("false"), RANKS, P.PATTERN).count() == 0


def test_word_encoder_equals_the_library():
    own = token_store.WordEncoder(WORDS, "<u2")
    rng = random.Random(3)
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice("ab' \n\t\r.,é12漢<|>sΣ \x1d") for _ in range(30)) for _ in range(300)]
    texts += [f"a{chr(i)}b1 {chr(i)} A{chr(i)}{chr(i)}'S." for i in range(1, 0x260)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u2").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_texts_encoded_together_equal_the_library(monkeypatch):
    own = token_store.WordEncoder(WORDS, "<u2")
    rng = random.Random(4)
    signs = ["'", "s", "S", "ll", "re", "a", "É", "é", "ß", "İ", "Ⱥ", "!", "1", "2", " ", "\n", "\t", "\u00a0", "\u0085", "\x1c", "\0", "...", ".", "-", "_", "|", "<", "ª", "²"]
    beyond = [*signs, "Σ", "中", "e\u0301", "=\u0338", "<|", "<|endoftext|>", "\u200b", "🙂"]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 30))) for kinds in (signs, beyond) for _ in range(4000)]
    texts += ["", " ", "\n\n", "one two " * 300, "x" * 3000]
    want = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    data = [t.encode() for t in texts]
    assert own.encode_all(data) == want
    monkeypatch.setattr(token_store, "TOGETHER", 100)
    assert own.encode_all(data) == want
    assert own.encode_all([]) == [] and own.encode_all([b""]) == [b""]
    broken = [b"a\x85b", b"\xc3", b"ok\xffno, x"]
    assert own.encode_all(broken) == [own.encode(x.decode("utf-8", "replace")) for x in broken]


def test_token_files(spark):
    texts = ODD + ["same text here " * 500] * 3 + ["same text here " * 500 + "end"]
    rows = [(10 - i, t) for i, t in enumerate(texts)] + [(4, "repeated id")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], f"{SCHEMA}, start long").repartition(3)
    library = token_store.Tokenizer.from_file(WORDS)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    found = [tuple(r) for r in token_store.token_files(df, WORDS, 1).orderBy("start").collect()]
    assert [r[0] for r in found] == sorted(i for i, _ in rows)
    at = 0
    for _, start, n, _ in found:
        assert start == at
        at += n
    assert sorted((i, n, c) for i, _, n, c in found) == sorted((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    assert token_store.token_files(df.where("false"), WORDS, 1).count() == 0


@pytest.mark.parametrize("most", [1 << 24, -1])
def test_token_files_are_in_order(spark, monkeypatch, most):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    shared = words(4000)
    rows = [(i, shared + words(200) if i % 5 == 0 else "a copy" if i % 7 == 0 else words(20)) for i in range(300)] + [(None, "no id"), (8, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stores, write = [], token_store.write_store
    monkeypatch.setattr(token_store, "write_store", lambda *a: stores.append(write(*a)) or stores[-1])
    monkeypatch.setattr(chunk_store, "BROADCAST_BYTES", most)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = token_store.token_files(df, WORDS, 1).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    files = [pq.read_table(p) for p in sorted(Path(stores[0].path).glob("part-*.parquet"))]
    keys = [-1 if k is None else k for t in files for k in t.column("key").to_pylist()]
    assert keys == sorted(keys) and any(g for t in files for g in t.column("given").to_pylist())
    assert len(found) == len(keys) == len(rows)
    sizes = [n // 2 for t in files for n in t.column("size").to_pylist()]  # a recipe for every document
    assert sorted((-1 if i is None else i, s, n) for i, s, n, _ in found) == sorted(zip(keys, np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True))


def test_gear_cuts():
    data = random.Random(1).randbytes(300_000)
    ends = chunk_store.gear_cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= 1024 and sizes.max() <= 32768 and len(ends) > 30
    moved = chunk_store.gear_cuts(b"x" * 777 + data)
    assert len({e - 777 for e in moved} & set(ends)) > len(ends) * 0.8
    assert all(e % 2 == 0 for e in chunk_store.gear_cuts(data, unit=2))
    assert chunk_store.gear_cuts(b"") == [] and chunk_store.gear_cuts(b"a") == [1]


KIND = [("data", "binary", chunk_store.pa.binary())]


def stored(spark, items, name="test"):
    df = spark.createDataFrame(items, "key long, data binary").withColumn("note", F.lit(None).cast("long"))
    return chunk_store.write_store(chunk_store.described_items(df, chunk_store.gear_cuts), name)


def chunks_of(spark, store):
    rows = spark.read.parquet(store.path).collect()
    return [bytes(c) for r in rows for c in r["own"] if c is not None] + [bytes(g["chunk"]) for r in rows for g in r["given"]]


def test_store_keeps_each_chunk_once_and_notices_damage(spark):
    shared = random.Random(2).randbytes(60_000)
    items = [(1, shared), (2, shared), (3, b"head" + shared), (4, shared + b"tail"), (5, shared * 2), (6, b""), (7, None)]
    store = stored(spark, items)
    back = {bytes(r["data"]) for r in chunk_store.read_back(store, spark, lambda data, recipe: (data,), KIND).collect()}
    assert back == {d or b"" for _, d in items}
    held = chunks_of(spark, store)
    assert len(held) == len(set(held))
    assert sum(map(len, held)) < 2.5 * len(shared)
    broken = spark.read.parquet(store.path).selectExpr("key", "note", "size", "reverse(sha) sha", "root", "digests", "sizes", "copy", "own", "given")
    path = store.path + "-broken"
    broken.write.parquet(path)
    with pytest.raises(Exception, match="manifest"):
        chunk_store.read_back(chunk_store.Store(path), spark, lambda data, recipe: (data,), KIND).collect()


def test_store_of_repeated_rows_and_ids(spark, monkeypatch):
    """Equal rows, one key under many texts, and rows without a key all store each chunk once and lose nothing."""
    rng = random.Random(4)
    passage = rng.randbytes(20_000)
    items = [(1, passage)] * 40 + [(None, passage)] * 40
    items += [(key, rng.randbytes(300) + passage + rng.randbytes(300)) for key in (1, None) for _ in range(30)]
    monkeypatch.setattr(common, "HOT_ROWS", 8)  # frequent digests are dealt out
    store = stored(spark, items)
    held = chunks_of(spark, store)
    assert len(held) == len(set(held))
    recipes = store.recipes(spark).collect()
    assert len(recipes) == len(items)
    back = {bytes(r["sha"]): bytes(r["data"]) for r in chunk_store.read_back(store, spark, lambda data, recipe: (data,), KIND).collect()}
    assert sorted((r["key"] or 0, back[bytes(r["sha"])]) for r in recipes) == sorted((k or 0, d) for k, d in items)


def test_join_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.range(500).selectExpr("id", "IF(id < 300, 7, id % 50) AS k")
    right = spark.range(60).selectExpr("id AS k", "id * 2 AS v")
    assert sorted(map(tuple, common.join_spread(left, right, "k").select("id", "k", "v").collect())) == sorted((i, k, 2 * k) for i in range(500) for k in [7 if i < 300 else i % 50])


def test_other_tokenizers_go_through_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    assert not token_store.by_words(path) and token_store.by_words(WORDS)
    own = token_store.WordEncoder(path, "<u2")
    for t in ("Some Text, twice  over\n", "é漢"):
        assert np.frombuffer(own.encode(t), "<u2").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_merkle_root():
    leaves = [chunk_store.digest(bytes([i])) for i in range(5)]
    assert chunk_store.merkle_root(leaves) != chunk_store.merkle_root(leaves[::-1])
    assert len(chunk_store.merkle_root([])) == chunk_store.DIGEST


def test_media(spark):
    rows = [*enumerate(ODD), (None, "no id"), (0, "again"), (99, "trailing"), (98, "x" * 64)]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], f"{SCHEMA}, sha string")
    found = media.media_columns(df).collect()
    assert len(found) == len(rows)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    key = lambda r: repr(r[:5])
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(want, key=key)
    by = {}
    for r in found:
        by.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_columns(df.where("false")).count() == 0


# -- secrets ---------------------------------------------------------------------------------------------------


def plain_spans(text):
    out = []
    for kind, (pattern, ok) in enumerate(
        [
            (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
            (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
        ]
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "PASSWORD", "api_key", "apikey", "paſſword", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "_.-", "x", "token=abc", "\n"]), max_size=14))
def test_base_spans_equal_plain_matching(parts):
    text = "".join(parts)
    assert ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.base_spans(text)) == plain_spans(text)


@pytest.fixture(scope="module")
def secret_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(200))
    rows, planted = [], {}
    for i in range(120):
        text = prose()
        if i % 4 == 0:
            key = base64.b64encode(rng.randbytes(30)).decode()
            planted[i] = (len(text) + 1, len(text) + 1 + len(key))
            text += f" {key} "
        if i % 4 == 1:
            text += " someLongCamelCaseIdentifierName2WithDigits and anotherVeryLongPathLikeName1 "
        rows.append((i, text))
    return rows, planted


def test_random_tokens_are_found_and_names_are_not(spark, secret_rows):
    rows, planted = secret_rows
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    hits = sum(found[i] == f"random:{a}:{b}" for i, (a, b) in planted.items())
    assert hits >= 0.9 * len(planted)
    assert not any(found[i] for i, _ in rows if i not in planted)
    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    for i, (a, b) in planted.items():
        if found[i]:
            assert rows[i][1][a:b] not in cleaned[i] and "[SECRET]" in cleaned[i]


def test_secret_edges(spark):
    rows = [(1, None), (2, ""), (None, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (2, "é " * 10 + "AKIA" + "A1" * 10), (3, "a" * 50_000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], f"{SCHEMA}, spans string")
    found = {(r["doc_id"], r["spans"]) for r in secrets.find_secrets(df).collect()}
    assert found == {(1, ""), (2, ""), (None, "assign:0:49,hex:9:49"), (2, "access:20:44"), (3, "hex:0:50000")}
    assert secrets.find_secrets(df.where("false")).count() == 0
    assert [r["text"] for r in secrets.redact_secrets(df.where("doc_id = 1")).collect()] == [None]
    assert secrets.redact_secrets(df).columns == df.columns


def slow_random_spans(texts):
    """The random spans of all texts, one character at a time."""
    import math

    signs, plain = "+/_-=", set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    pairs = np.zeros((128, 128))

    def runs(text, allowed):
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in allowed:
                end += 1
            if end > at:
                yield at, end
            at = max(end, at + 1)

    def encoded(token):
        found = next((n for n, letters in secrets.ALPHABETS.items() if set(token) <= set(letters)), None)
        kinds = any(c.isdigit() for c in token), any(c.isupper() for c in token), any(c.islower() for c in token)
        if found is None or not kinds[0] or not (kinds[1] or kinds[2]) or (found.startswith("base64") and not all(kinds)):
            return None
        return found

    def judged(token):
        letters = secrets.ALPHABETS[encoded(token)]
        q = np.array([sum(pairs[x, ord(c)] for x in range(128)) + 1 for c in letters])
        q /= q.sum()
        log = math.log(q[letters.index(token[0])])
        for a, b in zip(token, token[1:], strict=False):
            row = np.array([pairs[ord(a), ord(c)] for c in letters]) + q
            log += math.log(row[letters.index(b)] / row.sum())
        text = min(1.0, math.exp(log + len(token) * math.log(len(letters))))
        random_p = secrets.randomness_p(np.array([letters.index(c) for c in token]), len(letters))
        return 1.0 if random_p < 0.01 else min(1.0, text / (2 * random_p))

    tests = []
    for i, text in enumerate(texts):
        for a, b in runs(text or "", plain | set(signs)):
            if b - a < 16:
                continue
            for c, d in runs(text, plain | set("+/_-")):
                if not (a <= c and d <= b and d - c >= 16):
                    continue
                if encoded(text[c:d]):
                    tests.append((i, c, b if text[d:b] in ("=", "==") else d, d))
                    continue
                tests += [(i, e, f, f) for e, f in runs(text, plain) if c <= e and f <= d and f - e >= 16 and encoded(text[e:f])]
    kept = []
    for i, text in enumerate(texts):
        at = 0
        for _, a, b, _ in sorted(t for t in tests if t[0] == i):
            kept.append(text[at:a])
            at = b
        kept.append((text or "")[at:])
    raw = "\n".join(kept).encode()
    for a, b in zip(raw, raw[1:], strict=False):
        if a < 128 and b < 128:
            pairs[a, b] += 1
    tests = [(i, a, b, end - a, judged(texts[i][a:end])) for i, a, b, end in tests]
    out = {}
    for band in {secrets.band_of(n) for *_, n, _ in tests}:
        own = sorted((secrets._bin(t[4]), t) for t in tests if secrets.band_of(t[3]) == band)[::-1]
        best = max((k + 1 for k, (at, _) in enumerate(own) if 10 ** (-at / 10) <= 0.01 * (sum(x >= at for x, _ in own)) / len(own)), default=0)
        for _, (i, a, b, _, _) in own[:best]:
            if not any(x < b and a < y for _, x, y in secrets.base_spans(texts[i])):
                out.setdefault(i, []).append((a, b))
    return out


def test_random_spans_equal_the_slow_way(spark):
    rng = random.Random(12)
    prose = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(30))
    draw = lambda name, n: "".join(rng.choice(secrets.ALPHABETS[name]) for _ in range(n))
    texts = [None, "", *(prose() for _ in range(40))]
    for name in secrets.ALPHABETS:
        texts += [f"{prose()} {draw(name, n)} {prose()}" for n in (16, 22, 40)]
    texts += [f"DB_CRED={draw('base62', 40)}", f"x={draw('base36', 40)}==", f"{draw('base64', 43)}= {prose()}", f"see /usr/lib/{prose().replace(' ', '/')}", "getThingNumber2OfTheListOfThings " * 3, "20240113120055123456 " + prose()]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("random")] for r in secrets.find_secrets(df).collect()}
    slow = slow_random_spans(texts)
    assert {i: x for i, x in found.items() if x} == {i: sorted(x) for i, x in slow.items()}
    assert sum(map(len, found.values())) >= 24


# -- languages -------------------------------------------------------------------------------------------------

LETTERS = {"aa": "abcdeaeiab", "bb": "klmnouklmo", "cc": "rstuvyrsty"}


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(9)
    text = lambda lang, n: " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 80)), lang) for i, lang in ((i, rng.choice(list(LETTERS))) for i in range(400))]
    return rows, text


def test_language_accuracy_and_mixtures(spark, spoken):
    rows, text = spoken
    df = spark.createDataFrame(rows, f"{SCHEMA}, lang string")
    found = {r["doc_id"]: r for r in language_id.predict(df).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in set(held)) for i, _, _ in rows)
    assert sum(found[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held)
    model = language_id.fit(df)
    pred, score, shares = language_id.infer(text("aa", 60) + " " + text("bb", 30), model)
    assert pred == "aa" and set(shares) == {"aa", "bb"} and abs(shares["bb"] - 1 / 3) < 0.1 and score == shares["aa"]
    assert set(language_id.infer(text("cc", 100), model)[2]) == {"cc"}


def test_language_edges(spark, spoken):
    rows, _ = spoken
    extra = [(1001, None, "aa"), (1002, "12 34 !", "aa"), (None, "abcde abc", "aa"), (1003, "", None), (1003, "klm" * 20_000, None), (1004, "𝒳𐐀 klmno klo", "bb")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + extra], f"{SCHEMA}, lang string, lang_score double")
    found = [tuple(r) for r in language_id.predict(df).where("doc_id > 1000 OR doc_id IS NULL").orderBy("doc_id").collect()]
    assert {(r[0], r[2]) for r in found} == {(None, "aa"), (1001, "und"), (1002, "und"), (1003, "und"), (1003, "bb"), (1004, "bb")}
    assert all(0 <= r[3] <= 1 for r in found)
    assert language_id.predict(df).count() == len(rows) + len(extra)
    unlabelled = df.withColumn("lang", language_id.F.lit(None).cast("string"))
    assert language_id.predict(unlabelled).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.predict(df.where("false")).count() == 0
    assert language_id.identify(df, language_id.fit(df)).columns[:3] == ["doc_id", "text", "lang"]


def test_shares_equal_a_search_of_the_simplex():
    """EM's shares and the choice of languages, against all mixtures in steps of a hundredth."""
    rng = np.random.default_rng(3)
    loglik = np.log(rng.dirichlet(np.full(language_id.BUCKETS, 0.02), 3).T + 1e-9).astype(np.float32)
    model = language_id.Model(("aa", "bb", "cc"), loglik)
    for text in ("some words of this and that " * 4, "a", "quite another text, with other letters: xyz qrs", "dies und das und jenes " * 9):
        pred, score, shares = language_id.infer(text, model)
        found, counts = np.unique(language_id.trigrams(text), return_counts=True)
        weight, like = counts * language_id.EVIDENCE, np.exp(loglik[found].astype(float))
        height = lambda s: float(weight @ np.log(like @ np.array(s)))
        grid = [(a / 100, b / 100, (100 - a - b) / 100) for a in range(101) for b in range(101 - a)]
        size = lambda s: sum(x > 0 for x in s)
        cost = max(1.0, np.log(weight.sum()))
        best = max(grid, key=lambda s: height(s) - cost * (size(s) - 1))
        own = [shares.get(x, 0.0) for x in model.languages]
        assert pred == model.languages[int(np.argmax(own))] and score == pytest.approx(max(own))
        assert height(own) - cost * (size(own) - 1) >= height(best) - cost * (size(best) - 1) - 0.02
