"""Byte-level BPE against the public implementation, and its round trip."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quirefold.llm.tokenize import TOKENIZER_DIR, BytePairEncoder, encoder, token_count, token_ids, token_text

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")), reason="no vocabularies here")
TEXTS = [None, "", " ", "Hello, world's end", "<|endoftext|> a", "日本語の本。\n\n  x", "a" * 3000, " " * 50 + "\t\n", "naïve 🦊👩‍🎨", "ß́​", "1,234.5 6", "don't WE'LL I'm"]


def test_equals_the_public_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    public.encode_special_tokens = True
    own = encoder("byte_bpe_50k", TOKENIZER_DIR)
    rng = random.Random(1)
    pool = "abc XYZ\n\t'.,éüжш漢字🦊‍0123 "
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(pool) for _ in range(rng.randrange(120))) for _ in range(300)]
    assert [own.encode(t) for t in texts] == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert all(own.decode(own.encode(t)) == t for t in texts)


def test_merges_against_brute_force():
    own = encoder("byte_bpe_50k", TOKENIZER_DIR)
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcderinth ") for _ in range(rng.randrange(1, 25)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(own.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert own.merge(piece) == [own.ranks[p] for p in parts]


def test_stale_entries_are_skipped():
    tiny = BytePairEncoder({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5})
    assert tiny.merge(b"abcabc") == [5, 5] and tiny.merge(b"bcb") == [4, 1]


def test_columns(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    own = encoder("byte_bpe_50k", TOKENIZER_DIR)
    rows = df.select("doc_id", token_ids(F.col("text")).alias("i"), token_count(F.col("text")).alias("n")).withColumn("back", token_text(F.col("i"))).orderBy("doc_id").collect()
    for t, r in zip(TEXTS, rows):
        assert r.i == own.encode(t) and r.n == len(r.i) and r.back == (t or "")
    assert df.limit(0).select(token_ids(F.col("text"))).collect() == []
    assert json.dumps(rows[0].i) == "[]"
