"""Spelling variants against all pairs of words."""

import random
from collections import Counter
from zlib import crc32

import pytest

from ledgerlake.llm import queries, variants

SF = "/root/testdata/sf0.001"


def plain_counts(rows):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(rows):
    counts = plain_counts(rows)
    near = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for length, words in by_length.items():
        for k, a in enumerate(words):
            for b in words[k + 1 :] + by_length.get(length + 1, []):
                if one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, form[w], root(w), len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def found(df):
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op12_spelling_variants(spark, SF)) == plain(rows)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(variants, "LONG", 9)
    monkeypatch.setattr(variants, "BLOCK", 5)
    monkeypatch.setattr(variants, "COUNTED", 20)


@pytest.mark.parametrize("small_bounds", [False, True])
def test_dense_words_runs_and_ties(spark, small_bounds, request):
    """Few letters, so that words have many neighbours; with small bounds most words are long ones."""
    if small_bounds:
        request.getfixturevalue("small")
    rng = random.Random(7)
    words = ["".join(rng.choice("aabé") for _ in range(rng.randint(6, 12))) for _ in range(220)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "bananas", "banana", "bananass", "Éclairs", "éclairs"]
    rows = []
    for k in range(40):
        text = " ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in rng.choices(words, k=rng.choice((3, 40, 90))))
        rows.append((k, text))
    rows += [(50, "bananas " * 300), (51, "bananass " * 25), (52, "bananasss " * 2), (52, "bananasss " * 2)]
    rows += [(None, "bananas bananas"), (60, None), (61, ""), (62, "12 _ ;"), (63, "bananas"), (63, "bananas")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string")
    assert found(variants.variants(df.repartition(3))) == plain(rows)


def test_very_long_words(spark):
    base = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    long_ones = [base, base + "x", base[:-1], base[:10_000] + "x" + base[10_001:], base[:64], base[:65], base[:63]]
    rows = [(k, f"{w} {w}") for k, w in enumerate(long_ones)] + [(9, f"{base} " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(variants.variants(df)) == plain(rows)


def test_no_words(spark):
    df = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    assert variants.variants(df).collect() == []
    assert variants.variants(df.limit(0)).collect() == []
