"""Byte-pair encoding against the tokenizers library and against plain merging."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, registry

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a" * 3000, "<|endoftext|>a<|startoftext|>", "x<|endoftext|", "ΑΣ ΣΑΣ", "İstanbul", "é ́x", "a\x1cb\x85c\xa0d e", "日本語テキスト", "don't I'LL we've", "½²Ⅷ٣7", "각", "😀👩‍👩‍👧", "a\0b\0", "ﬁ ſ", "￾﻿", "ab cd. " * 20_000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def slow(word, places, suffix):
    """Plain merging: the earliest merge first, the leftmost of equals."""
    parts = [*word[:-1], word[-1] + suffix]
    while True:
        found = min(((places[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in places), default=None)
        if found is None:
            return parts
        k = found[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_random_merges_equal_plain_merging():
    """Small alphabets and random merges make overlapping ties and tokens that never come out whole."""
    rng = random.Random(5)
    for suffix in ("</w>", ""):
        for _ in range(150):
            symbols = "ab" if rng.random() < 0.5 else "abc"
            vocab = dict.fromkeys([*symbols, *(s + suffix for s in symbols)])
            merges = []
            while len(merges) < rng.randint(1, 14):
                left, right = rng.choice([t for t in vocab if not suffix or not t.endswith(suffix)]), rng.choice(list(vocab))
                if left + right in vocab:
                    if rng.random() < 0.2:
                        break
                    continue
                merges.append((left, right))
                vocab[left + right] = None
            vocab = {t: i for i, t in enumerate(vocab)}
            made = bpe.Merges(vocab, merges, suffix)
            places = {m: k for k, m in enumerate(merges)}
            for _ in range(60):
                word = "".join(rng.choices(symbols, k=rng.randint(1, 24)))
                assert made.encode(word) == [vocab[p] for p in slow(word, places, suffix)], (word, merges)


def test_pairs_equal_merging_again(encoder):
    """The table of pairs against merging two tokens' joint symbols from the start."""
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    places = {(m if isinstance(m, tuple) else tuple(m) if isinstance(m, list) else tuple(m.split(" "))): k for k, m in enumerate(model["merges"])}
    plain = [t for t in model["vocab"] if not t.endswith("</w>") and len(t) < 9]
    ends = [t for t in model["vocab"] if t.endswith("</w>") and len(t) < 12]
    rng = random.Random(2)
    for _ in range(4000):
        a, b = rng.choice(plain), rng.choice(ends)
        assert encoder.merges.compatible(model["vocab"][a], model["vocab"][b]) == (slow(a + b[:-4], places, "</w>") == [a, b])


def test_encoder_equals_the_library(encoder, library):
    rng = random.Random(1)
    sets = ["aeiou", "abab", "rstlne", "ßéèñöÄÖ", "абвгд", "0123", "<|endoftext|> ", "'tsrvmdl ", " \n\t\r\x0b", "!?.,#", "😀👍日本"]
    texts = [t for t in ODD if t is not None]
    texts += ["".join(rng.choices("".join(rng.sample(sets, rng.randint(1, 4))), k=rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(1, 30))) for _ in range(1000)]
    tokens = list(encoder.merges.vocab)
    texts += ["".join(rng.choice(tokens).replace("</w>", "") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encoder(t), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_tables_are_emptied_when_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 30_000)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 10)
    with open(PATH, encoding="utf-8") as f:
        one = bpe.Encoder(f.read())
    for k in range(300):
        text = f"word{k} wordy{k * k} again"
        assert np.frombuffer(one(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(one) + len(one.words) < 200 and len(one.merges.pairs) <= 10


def test_encode_and_decode_as_columns(spark, library):
    rows = [(k, t, "mine") for k, t in enumerate([*ODD, "the same", "the same"])] + [(None, "no id", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `decoded` string")
    coded = bpe.encode(docs, PATH, ["doc_id", "decoded"])
    assert coded.columns == ["doc_id", "decoded", "ids"]
    got = {r["doc_id"]: r for r in bpe.decode(coded, PATH).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == want and got[k]["decoded"] == library.decode(want, skip_special_tokens=False)
    empty = bpe.decode(bpe.encode(docs.limit(0), PATH, ["doc_id"]), PATH)
    assert empty.collect() == []


def test_decode_of_odd_ids(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_TOKENS", 3)
    lists = [None, [], [5, None, 7], [-1], [10**9], [320] * 10, [], [49407, 49406]]
    got = [r["decoded"] for r in bpe.decode(spark.createDataFrame([(x,) for x in lists], "ids array<int>").coalesce(1), PATH).collect()]
    assert got == [library.decode([i for i in x or [] if i is not None and 0 <= i < 49408], skip_special_tokens=False) for x in lists]


def test_query(spark, tables, library):
    rows = [(k, t) for k, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in registry.QUERIES["op11_bpe"](spark, tables("documents", rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == want


def test_definitions_that_do_not_suit_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            bpe.Encoder(f.read())


def test_no_cut_off_of_long_words(encoder, library):
    rng = random.Random(3)
    word = "".join(rng.choices("abcdefghij", k=100_000))
    assert np.frombuffer(encoder(word), "<i4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_schema(spark, tables):
    df = registry.QUERIES["op11_bpe"](spark, tables("documents", [], "doc_id long, text string"))
    assert df.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] and df.agg(F.count("*")).first()[0] == 0
