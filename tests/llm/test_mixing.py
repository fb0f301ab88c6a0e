"""Mixing: shares, caps, repeats, edges."""

import math
import os
import random

import pytest

from quirefold.llm.mixing import fit_means, mix_sources, poisson_steps
from quirefold.llm.tokenize import TOKENIZER_DIR

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")), reason="no vocabularies here")
DOCS = "doc_id long, text string, source string, digest string, copies int, s string, d long"
TARGETS = "source string, weight double, max_repeat int"


def test_poisson():
    steps = poisson_steps(2.0, 4)
    assert steps[0] == pytest.approx(math.exp(-2)) and steps[3] == pytest.approx(math.exp(-2) * (1 + 2 + 2 + 4 / 3))
    assert poisson_steps(math.inf, 2).tolist() == [0.0, 0.0] and poisson_steps(0.0, 2).tolist() == [1.0, 1.0] and poisson_steps(1.0, 0).tolist() == []
    steps = poisson_steps(5000.0, 10_000)  # the chance of none underflows
    assert steps[4000] < 1e-40 and steps[4999] == pytest.approx(0.5, abs=0.01) and steps[-1] == pytest.approx(1.0)


def size_of(rows, mean, cap):
    steps = poisson_steps(mean, cap)
    return sum(n * int((steps < u).sum()) for _, u, n in rows)


def test_fit_means(spark):
    rng = random.Random(1)
    rows = [(s, rng.random(), rng.randrange(1, 50)) for s in ("a", "b", "c", "d") for _ in range(4000)] + [("e", 0.25, 10), ("e", 0.25, 10)]
    sized = spark.createDataFrame(rows, "source string, u double, n_tokens long")
    own = {s: [r for r in rows if r[0] == s] for s in "abcde"}
    # A rate of one in a hundred thousand, of a third, of 2.9 with a cap of 3, and what the cap doesn't allow.
    all_ = {s: sum(r[2] for r in own[s]) for s in "abcde"}
    wanted = {"a": (all_["a"] * 2e-4, 3), "b": (all_["b"] / 3, 1), "c": (all_["c"] * 2.9, 3), "d": (all_["d"] * 40.0, 40), "e": (15.0, 1)}
    for bins in (64, None):
        means = fit_means(sized, wanted, bins)
        assert means["d"] == math.inf
        for s in "abc":
            # Within one text, here of fewer than 50 tokens.
            assert abs(size_of(own[s], means[s], wanted[s][1]) - wanted[s][0]) < 50
        assert size_of(own["e"], means["e"], 1) in (0, 20)
    assert fit_means(sized, {"a": (0.0, 3), "b": (5.0, 0)}) == {"a": 0.0, "b": 0.0} and fit_means(sized, {}) == {}


def test_a_large_source_with_a_small_share(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('word ', id, ' of a large source') as text", "'big' as source").unionByName(spark.range(30_000, 30_010).selectExpr("id as doc_id", "concat('rare ', id) as text", "'rare' as source"))
    n = {r.source: r for r in mix_sources(docs, spark.createDataFrame([("big", 0.5, 1), ("rare", 0.5, 1)], TARGETS))[1].collect()}
    assert n["big"].n_texts == 30_000 and n["rare"].used_texts == 10 and abs(n["big"].used_tokens - n["rare"].used_tokens) <= 8 and n["big"].used_tokens > 0


def test_shares_and_caps(spark):
    docs = [(k, f"text number {k} " * (1 + k % 5), "big", "", 0, "", 0) for k in range(1500)] + [(9000 + k, f"small one {k} again and again", "small", None, 0, "", 0) for k in range(120)]
    docs += [(5000 + k, "text number 3 text number 3 ", "big", "", 0, "", 0) for k in range(5)]
    docs += [(7001, None, "big", "", 0, "", 0), (7002, "", "big", "", 0, "", 0), (7003, " \n ", "big", "", 0, "", 0), (7004, "no source", None, "", 0, "", 0), (7005, "other", "else", "", 0, "", 0)]
    frame = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big", 0.75, 2), ("small", 0.25, 4), ("gone", 0.1, 3), (None, 0.5, 1), ("zero", 0.0, 9), ("bad", -1.0, None)], TARGETS)
    mixture, report = mix_sources(frame, targets)
    rows = mixture.collect()
    shares = {r.source: r for r in report.collect()}
    assert shares["big"].share == pytest.approx(0.75, abs=0.01) and shares["small"].share == pytest.approx(0.25, abs=0.01)
    assert shares["gone"].used_tokens == 0 and set(shares) == {"big", "small", "gone", "zero", "bad"}
    uses = {}
    for r in rows:
        uses[r.source, r.text] = uses.get((r.source, r.text), 0) + 1
    assert max(n for (s, _), n in uses.items() if s == "big") <= 2 and max(n for (s, _), n in uses.items() if s == "small") <= 4
    assert not {r.doc_id for r in rows} & {7001, 7002, 7003, 7004, 7005}
    assert {s: sum(r.n_tokens for r in rows if r.source == s) for s in ("big", "small")} == {s: shares[s].used_tokens for s in ("big", "small")}
    assert len({r.place for r in rows}) == len(rows)
    assert sorted((r.doc_id, r.copy) for r in rows) == sorted((r.doc_id, r.copy) for r in mix_sources(frame.repartition(7), targets)[0].collect())
    smaller = {r.source: r.used_tokens for r in mix_sources(frame, targets, total=2000)[1].collect()}
    assert smaller["big"] == pytest.approx(1500, abs=20) and smaller["small"] == pytest.approx(500, abs=10)


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    mixture, report = mix_sources(spark.createDataFrame([], DOCS), targets)
    assert mixture.collect() == [] and report.collect()[0].share == 0.0
    mixture, report = mix_sources(spark.createDataFrame([(1, "x", "a", "", 0, "", 0)], DOCS), targets.limit(0))
    assert mixture.collect() == [] and report.collect() == []
