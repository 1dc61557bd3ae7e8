"""Byte-level BPE against the tokenizer library, whole texts and awkward ones."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from ledgerlake.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return bpe.codec(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=own.pattern, mergeable_ranks=own.ranks, special_tokens={})


def same(own, library, text):
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:80]
    assert own.decode(ids) == text.encode()


def test_awkward_texts(own, library):
    rng = random.Random(2)
    every = bpe._every()
    texts = ["", " ", "\n\n  x", "a" * 5000, " " * 3000 + "x", "ab" * 4000, "<|endoftext|>", "don't 'S 're"]
    texts += ["\x1c\x1d x\x85 y", "ՠ֋", "\U00011de0 12 ࢏", "éé \U0001f600"]
    texts += ["".join(rng.choice(every) for _ in range(200)) for _ in range(60)]
    texts += ["".join(rng.choice("abcde fg'\n\t  12éß漢ー") for _ in range(400)) for _ in range(60)]
    for text in texts:
        same(own, library, text)


def test_long_texts_and_full_memory(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("etaoiné") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    same(own, library, text + "  " + text)


def test_a_very_long_pre_token(own, library):
    same(own, library, "".join(random.Random(4).choice("etaoinshrdlu") for _ in range(100_000)))


def test_lower_ranks_that_appear_late_come_first():
    """A merge may form a pair of lower rank than what still waits; ties go left to right."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b"de": 300, b"xx": 301}
    queue = bpe.RankQueue(ranks)
    library = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for piece in (b"abcde", b"xxxxx", b"xxabc", b"deabxbc", b"aabbccdd"):
        assert queue.merge(piece) == library.encode_ordinary(piece.decode())
        assert not queue.buckets and not any(queue.leaves)


def test_unknown_ids_are_refused(own):
    assert own.decode(b"") == b""
    with pytest.raises(ValueError, match="no token"):
        own.decode(np.array([len(own.tokens)], "<u4").tobytes())


def test_query_and_defined_cases(spark, library):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, SF).collect()}
    assert len(out) == len(given)
    for row in given:
        text, found = row["text"] or "", out[row["doc_id"]]
        ids = library.encode_ordinary(text)
        assert found["n_tokens"] == len(ids)
        assert found["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    rows = [(1, None, "x"), (1, "a b", "y"), (1, "a b", "y"), (None, "", "z"), (5, "z" * 300_000, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(made)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], len(r["bytes"])) for r in got)[:4] == [
        (0, 0, 0),
        (1, 0, 0),
        (1, 2, 3),
        (1, 2, 3),
    ]
    assert {len(r["bytes"]) for r in got if r["doc_id"] == 5} == {300_000}
    assert bpe.decode(bpe.encode(made.limit(0))).collect() == []
