"""Byte-level ids against the tiktoken library, and back."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bytelevel

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = list("aAzelrvstmd'' '\n\t   109½٣,.;-é́中文字かな🙂‍  \x1c\x00<|>") + [
    "'s", "'re", "'ll", "'ve", " '", "''", "\r\n", "I'll", "we'r", "o'l ", "'L", "’s", "\U0001F468", "ე0"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(texts):
    coder = bytelevel.pieces(PATH)
    sizes = [len(t.encode()) for t in texts]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, ends, ahead = coder.encoded(data, starts)
    return [ids[a:b].tolist() for a, b in zip(ahead, [*ahead[1:], len(ids)])]


def test_ids_of_random_texts_are_the_librarys(library):
    rng = random.Random(12)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(0, 14))) for _ in range(40_000)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(20)) for _ in range(3_000)]
    assert own(texts) == [library.encode_ordinary(t) for t in texts]
    for t in texts[:500]:  # one at a time, too: nothing leaks from text to text
        assert own([t]) == [library.encode_ordinary(t)]


def test_every_character_between_others(library):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert own(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_slices(library):
    rng = random.Random(3)
    texts = ["a" * 50_000, "".join(rng.choices("abcdefgh", k=20_000)), " " * 9_999 + "x", "!?" * 8_000, "中" * 5_000, "\n" * 7_000, "a" * 96, "ab" * 49]
    assert own(texts) == [library.encode_ordinary(t) for t in texts]


def test_columns_encode_decode_and_decode_runs(spark, docs_of, library):
    cases = [(1, "Hello  world, it's ümlaut 中文\n"), (2, None), (3, ""), (None, "null id"), (4, "x y " * 600_000), (4, "x y " * 600_000), (5, "it'l")]
    docs = docs_of(cases, ids=3, row="clash", coded=1.5)
    coded = bytelevel.encoded(docs, PATH)
    got = coded.withColumns({
        "back": bytelevel.decoded(F.col("coded"), PATH),
        "part": bytelevel.decoded(bytelevel.run_of(F.col("coded"), 2, 3), PATH)}).collect()
    assert len(got) == len(cases)
    for r in got:
        row, text = r["row"], r["row"]["text"] or ""
        want = library.encode_ordinary(text)
        assert np.frombuffer(r["coded"]["ids"], "<u4").tolist() == want
        assert bytes(r["back"]) == text.encode() and (row["ids"], row["row"], row["coded"]) == (3, "clash", 1.5)
        assert bytes(r["part"]) == library.decode_bytes(want[128:320])
        starts = np.frombuffer(r["coded"]["starts"], "<u4").tolist()
        assert starts[:50] == [len(library.decode_bytes(want[:n])) for n in range(0, min(len(want), 3_200), 64)]
    assert bytelevel.encoded(docs.limit(0), PATH, keep=["doc_id"]).select("row.*").count() == 0


def test_wrong_places_are_noticed():
    coder = bytelevel.pieces(PATH)
    with pytest.raises(ValueError):
        coder.decoded(np.array([1, 2]), np.array([0, 5]))


def test_query(spark, docs_of, library, tmp_path):
    from ledgerloom.llm.queries import QUERIES

    docs_of([(1, "It's a test."), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op12_bytes"](spark, str(tmp_path)).collect()}
    ids = np.array(library.encode_ordinary("It's a test."), "<u4")
    assert got[1]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and got[1]["n_tokens"] == len(ids)
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"It's a test.").hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
