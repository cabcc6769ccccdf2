import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bpe
from rasterloom.llm.lexicon import Transducer, compile_transducer
from rasterloom.llm.queries import tokenizer_path

TEXTS = [
    None, "", " ", "  \n\t ", "hello world", "it's we'll I'VE", "a" * 5000, "<|endoftext|>", "x<|endoftext|>y <|endoftext|> ",
    "naïve café ßtraße 漢字かな 🙂🙂", "tabs\there nbsp em\x1c\x1d\x85end", "1234567 89.5%", "é‍﻿", "The the  the   the ", "a\n b\n\n c \nd \t e ", " lead", "trail ", "x \u00a0 y",
]


def fuzz(n: int) -> list[str]:
    r = random.Random(7)
    letters = "abcdefghij  \n\t'stveéß漢🙂0123.,<|>\x1f  　"
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 400))) for _ in range(n)]


def test_transducer_round_trip_and_shared_suffixes(tmp_path):
    words = sorted({w.encode() for w in ("", "a", "ab", "tap", "taps", "top", "tops", "xaps", "stops")})
    raw = compile_transducer((w, tuple(range(len(w)))) for w in words)
    path = tmp_path / "t.mast"
    path.write_bytes(raw)
    t = Transducer(str(path))
    assert all(t.lookup(w) == tuple(range(len(w))) for w in words)
    assert all(t.lookup(w) is None for w in (b"t", b"to", b"topss", b"z", b"tapsx"))
    assert t.n_states < sum(map(len, words)) / 2


def test_equals_the_library(spark):
    from tokenizers import Tokenizer

    texts = TEXTS + fuzz(60)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, tokenizer_path(), lexicon_size=50), tokenizer_path()).collect()}
    t = Tokenizer.from_file(tokenizer_path())
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids, repr(text)
        assert got[i].text == t.decode(ids, skip_special_tokens=False) == (text or "")


def test_invalid_bytes_decode_like_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    lists = [[i] for i in range(100, 256)] + [[220, 50256, 128, 5], [163, 223, 256], []]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, tokenizer_path()).collect()}
    assert all(got[i] == t.decode(ids, skip_special_tokens=False) for i, ids in enumerate(lists))


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(1, "ab ab"), (1, "ab ab"), (None, "x")], "doc_id long, text string")
    assert sorted(len(r.ids) for r in bpe.encode(twice, tokenizer_path()).collect()) == [1, 2, 2]


@pytest.mark.parametrize("word", ["a" * 300, "abcabc" * 80, "é" * 200])
def test_long_words_merge_like_short_ones(word):
    vocabulary = bpe._vocabulary(bpe.read_tokenizer(tokenizer_path()))
    raw = word.encode()
    ids = [vocabulary.byte_ids[b] for b in raw]
    while found := [(vocabulary.ranks[p], k) for k in range(len(ids) - 1) if (p := (ids[k], ids[k + 1])) in vocabulary.ranks]:
        rank, k = min(found)
        ids[k : k + 2] = [vocabulary.made[rank]]
    assert vocabulary.merge(raw) == tuple(ids)


def test_query_digests(spark):
    from rasterloom.llm import queries

    row = queries.op9_bpe_roundtrip(spark, "/root/testdata/sf0.001").where(F.col("doc_id") == 0).first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 0").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_takes_one_worker_a_task(spark, tmp_path):
    """Encoding and decoding in two workers each, every one of them came to keep the memos of both."""
    from rasterloom.llm import queries

    docs = spark.createDataFrame(list(enumerate(TEXTS + fuzz(40))), "doc_id long, text string").localCheckpoint()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.op9_bpe_roundtrip(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both = bpe.round_trip(docs, tokenizer_path())
    apart = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert sorted(both.collect()) == sorted(apart.select("doc_id", "ids", "text").collect())


@pytest.mark.parametrize("most", [0, 1, 1 << 16])
def test_ways_into_the_transducer_are_kept_and_change_nothing(tmp_path, monkeypatch, most):
    from rasterloom.llm import lexicon as m

    monkeypatch.setattr(m, "HEADS", most)
    r = random.Random(3)
    word = lambda: bytes(r.choice(b" abc\x00\xff") for _ in range(r.randrange(1, 8)))
    known = {word(): tuple(r.randrange(50_000) for _ in range(r.randrange(1, 4))) for _ in range(400)}
    path = tmp_path / "words.mast"
    path.write_bytes(m.compile_transducer(sorted(known.items())))
    words = m.Transducer(str(path))
    for w in [*known, *(word() for _ in range(2000)), b"", b"a", b"zzzz", *known]:
        assert words.lookup(w) == known.get(w)
    assert len(words._heads) <= most
