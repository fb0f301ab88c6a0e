"""Mixing sources to target weights by Poisson replication.

Each text draws how often it is used by inverting a Poisson distribution at a uniform number of 53 bits
hashed from it, with a mean set per source, and is exploded by that count; the copies are then put in a
global hash order.  The mean of a source is found from the draw itself, so the shares hold for this draw
and not only on average: sizes are pre-aggregated into bins of the uniform number, the mean is
bracketed on that table, and the bins in which the bracket's steps fall are refined until the steps lie
between single texts.  The driver sees at most ``TABLE`` bins a round, whatever the number of texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.tokenize import TOKENIZER_DIR, token_count
from quirefold.session import cut_lineage

#: Bins of the uniform number that come to the driver in one round, over all target sources, and the most a source gets.
TABLE, BINS = 1 << 19, 1 << 12
#: mix_targets is a fixed table; more targets than this are refused.
MAX_TARGETS = 10_000
#: Refinements; each narrows a bin at least 16-fold, so these exhaust the 53 bits of the number.
ROUNDS = 14
_UNIT = 2.0**-53


def poisson_steps(mean: float, cap: int) -> np.ndarray:
    """Uniform numbers above which a draw counts 1, 2, ... cap: the distribution function at 0 .. cap-1."""
    if math.isinf(mean):
        return np.zeros(cap)
    if mean <= 0:
        return np.ones(cap)
    # Logarithms of the chances, for they underflow where the mean is large.
    logs = np.cumsum(np.concatenate([[-mean], math.log(mean) - np.log(np.arange(1, cap))])) if cap else np.zeros(0)
    return np.minimum(1.0, np.cumsum(np.exp(logs)))


class Draw:
    """Sizes of one source by bins of the uniform number, and what a draw of a given mean weighs."""

    def __init__(self, edges: np.ndarray, sizes: np.ndarray, texts: np.ndarray, cap: int):
        self.edges, self.cap = edges, cap
        self.sizes, self.texts = sizes, texts
        self.above = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0.0]])
        self.total = float(sizes.sum())

    def bounds(self, mean: float) -> tuple[float, float]:
        """Least and greatest size of the draw: a step takes a part of the bin it lies in, unless it is its lower edge."""
        steps = poisson_steps(mean, self.cap)
        steps = steps[steps < 1.0]
        at = np.clip(np.searchsorted(self.edges, steps, side="right") - 1, 0, len(self.sizes) - 1)
        least = np.where(self.edges[at] >= steps, self.above[at], self.above[at + 1]).sum()
        return float(least), float(self.above[at].sum())

    def between(self, low: float, high: float) -> int:
        """How many texts may lie between the steps of two means."""
        many = np.concatenate([[0.0], np.cumsum(self.texts)])
        first = np.searchsorted(self.edges, poisson_steps(high, self.cap), side="right") - 1
        last = np.searchsorted(self.edges, poisson_steps(low, self.cap), side="left")
        return int((many[np.minimum(last, len(self.texts))] - many[np.minimum(first, len(self.texts))]).clip(0).sum())

    def bracket(self, wanted: float) -> tuple[float, float]:
        """Means between which the size of the draw passes the wanted one: surely not above it, surely not below."""

        def search(enough) -> tuple[float, float]:
            low, high = 0.0, 1.0
            while not enough(high) and high < 1e12:
                low, high = high, high * 2
            for _ in range(200):
                middle = (low + high) / 2
                if middle in (low, high):
                    break
                low, high = (low, middle) if enough(middle) else (middle, high)
            return low, high

        return search(lambda m: self.bounds(m)[1] > wanted)[0], search(lambda m: self.bounds(m)[0] >= wanted)[1]

    def finer(self, low: float, high: float, bins: int) -> np.ndarray:
        """Edges that split the stretches in which the steps of the bracket lie."""
        ends = np.stack([poisson_steps(high, self.cap), poisson_steps(low, self.cap)], axis=1)
        ends = np.unique(ends[ends[:, 0] < ends[:, 1]], axis=0)
        if not len(ends):
            return np.array([0.0, 1.0])
        each = max(17, bins // len(ends))
        spread = [np.linspace(a, b, each) for a, b in ends]
        return np.unique(np.concatenate([[0.0, 1.0], *spread]))


def _bins(edges: dict[str, np.ndarray]):
    """Bin of each uniform number of a source."""

    @F.pandas_udf("int")
    def bin_of(source: pd.Series, u: pd.Series) -> pd.Series:
        out = np.zeros(len(u), dtype=np.int32)
        for name, places in source.groupby(source).groups.items():
            at = source.index.get_indexer(places)
            out[at] = np.searchsorted(edges[name], u.to_numpy()[at], side="right") - 1
        return pd.Series(out)

    return bin_of


def fit_means(sized: DataFrame, wanted: dict[str, tuple[float, int]], bins: int | None = None) -> dict[str, float]:
    """The mean of each source whose capped draw from (source, u, n_tokens) comes closest to its wanted size, given as (size, cap).

    The size of the draw differs from the wanted one by less than the text next to it.
    """
    each = bins or max(64, min(BINS, TABLE // max(1, len(wanted))))
    edges = {s: np.linspace(0.0, 1.0, each + 1) for s in wanted}
    means: dict[str, float] = {}
    brackets: dict[str, tuple[float, float]] = {}
    for _ in range(ROUNDS):
        if not edges:
            break
        placed = sized.where(F.col("source").isin(list(edges))).withColumn("bin", _bins(edges)("source", "u"))
        tables = {s: (np.zeros(len(e) - 1), np.zeros(len(e) - 1)) for s, e in edges.items()}
        for r in placed.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("texts")).collect():
            tables[r["source"]][0][r["bin"]], tables[r["source"]][1][r["bin"]] = r["n"], r["texts"]
        finer = {}
        for s, (sizes, texts) in tables.items():
            size, cap = wanted[s]
            draw = Draw(edges[s], sizes, texts, cap)
            if size <= 0 or not draw.total or not cap:
                means[s] = 0.0
                continue
            if size >= cap * draw.total:
                means[s] = math.inf
                continue
            low, high = draw.bracket(size)
            under, over = draw.bounds(low), draw.bounds(high)
            means[s] = low if size - under[0] <= over[1] - size else high
            if draw.between(low, high) > 1 and brackets.get(s) != (low, high):
                brackets[s] = (low, high)
                finer[s] = draw.finer(low, high, each)
        edges = finer
    return means


def uniform(*key: Column, seed: int) -> Column:
    """The hash-seeded uniform number of a key: 53 bits in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") * F.lit(_UNIT)


def mix_sources(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """The mixture (position key, doc_id, source, copy, n_tokens, text) and the report of shares.

    Equal texts of a source posted under several ids count as one text, under the least doc_id, so
    that no text is used more than max_repeat times.  Texts without a character that is not white
    space, of no source or of a source without a target, are not used.  ``total`` is the size wanted,
    in tokens; the default is the size of all usable texts, and either is lowered to what the caps
    allow at the given weights.  A source with a target but no texts gets none, and the weights of
    the others are scaled up; negative and null weights and caps count as 0.
    The report has, by target source: weight, max_repeat, n_texts, n_tokens (once), rate (wanted
    size over n_tokens), used_texts, used_copies, most_copies, used_tokens and share.

    Texts cross the network once, as often as they are drawn, to the partition of their place; each
    partition is sorted by place and is a sample of the whole mixture.
    """
    wanted = targets.groupBy("source").agg(F.max(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0))).alias("max_repeat")).where("source is not null")
    goal = {r["source"]: (r["weight"], r["max_repeat"]) for r in wanted.limit(MAX_TARGETS + 1).collect()}
    if len(goal) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    used = [s for s, (weight, cap) in goal.items() if weight > 0 and cap > 0]
    texts = documents.where(F.col("source").isin(used) & F.col("text").rlike(r"[^\s\p{Z}]")).select("doc_id", "source", "text").withColumn("digest", F.sha2("text", 256))
    counted = texts.select("doc_id", "source", "digest", token_count(F.col("text"), tokenizer, folder).alias("n_tokens"))
    first = counted.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    sized = cut_lineage(first.withColumn("u", uniform(F.col("digest"), F.col("source"), seed=seed)))

    have = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # at most MAX_TARGETS rows
    weights = {s: goal[s][0] for s in have if have[s] > 0}
    scale = sum(weights.values()) or 1.0
    size = float(sum(have.values()) if total is None else total)
    for s, w in weights.items():
        size = min(size, goal[s][1] * have[s] * scale / w)
    means = fit_means(sized, {s: (size * w / scale, goal[s][1]) for s, w in weights.items()})
    rows = []
    for s, w in sorted(weights.items()):
        steps = poisson_steps(means[s], goal[s][1])
        # Steps that every number exceeds, or none, need no list.
        rows.append((s, int((steps < _UNIT / 2).sum()), [float(x) for x in steps[(steps >= _UNIT / 2) & (steps < 1.0)]], size * w / scale / have[s]))
    steps = documents.sparkSession.createDataFrame(rows, "source string, always int, steps array<double>, rate double")

    def drawn(frame: DataFrame) -> DataFrame:
        u = F.col("u")
        with_steps = frame.join(F.broadcast(steps), "source")  # one row a target
        return with_steps.withColumn("copies", F.col("always") + F.size(F.filter("steps", lambda s: s < u))).drop("always", "steps")

    counts = drawn(sized)
    each = counts.where("copies > 0").select("doc_id", "source", "digest", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    place = F.xxhash64(F.lit(seed + 1), "digest", "source", "copy").alias("place")
    chosen = each.select(place, F.col("doc_id").alias("chosen_id"), F.col("source").alias("chosen_source"), "n_tokens", "copy")
    # Every text knows its own draw, so it goes straight to its places; there it meets the id it is used under.
    sent = drawn(texts.withColumn("u", uniform(F.col("digest"), F.col("source"), seed=seed))).where("copies > 0")
    sent = sent.select("doc_id", "source", "text", "digest", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(place, "doc_id", "source", "text", F.col("copy").alias("sent_copy"))
    met = sent.hint("merge").join(chosen.hint("merge"), "place").where((F.col("doc_id") == F.col("chosen_id")) & (F.col("source") == F.col("chosen_source")) & (F.col("copy") == F.col("sent_copy")))
    mixture = met.select("place", "doc_id", "source", "copy", "n_tokens", "text").sortWithinPartitions("place")

    found = counts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.max("rate").alias("rate"),
        F.count_if(F.col("copies") > 0).alias("used_texts"), F.sum("copies").alias("used_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"),
    )
    zero = {c: 0 for c in ("n_texts", "n_tokens", "used_texts", "used_copies", "most_copies", "used_tokens", "rate")}
    report = wanted.join(found, "source", "left").fillna(zero)
    everything = Window.partitionBy()  # over at most MAX_TARGETS rows
    report = report.withColumn("share", F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(everything)), F.lit(0.0)))
    return mixture, report
