"""Linking the spellings of one person or studio.

Spellings are read into forms (titles, nicknames, abbreviations, order of the parts), forms become
vectors of weighted character 4-grams, and a distributed join finds all pairs of forms whose cosine
reaches a threshold: each form is posted under its rarest grams only, as many as it takes that no
such pair can miss each other, and a pair is judged where its first common gram is posted, if the
lengths of the vectors from there on allow the threshold at all.  The nearest names of each are the
first of these; for linking none is left out, for what a top-n cuts off would be lost links.  An
exact check of the parts then refuses pairs that contradict each other (two given names, two
initials, a studio and a person).  The remaining pairs make components, and inside each component
average-linkage clustering decides which forms belong together.  Small components are clustered by
one task each, large ones in distributed rounds that merge mutually nearest clusters; sums of
similarities are whole numbers and ties go by name, so both ways give the same classes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import cut_lineage

#: Slots of the frequencies of grams and of words: tables of this size are sent to the tasks.  Grams themselves keep 31 bits
#: of their hash, so slots that are shared touch weights only.
GRAMS, WORDS, GRAM_BITS = 1 << 20, 1 << 20, (1 << 31) - 1
#: Postings of a gram that one task pairs; more are paired in blocks by several.
BLOCK = 2000
#: Cosine from which two forms are compared, and average similarity from which clusters are merged.
THRESHOLD, LINKAGE = 0.45, 0.42
#: Forms of a component that one task clusters; larger components are clustered by all tasks, with the same result.
COMPONENT = 1500
#: Similarities are whole multiples of 1 / UNIT, so that their sums don't depend on the order.
UNIT = 1 << 30
#: Share of the forms with a word that misspell it, at most, and how unlikely a count may be and still pass for that.
SLIP_RATE, UNLIKELY = 1 / 6, 0.1
#: Words are rare if no more forms have them than have the rarer words of this share.
RARE_SHARE = 0.6

# Words of names.
TITLES = {"dr", "mr", "mrs", "ms", "prof", "sir", "dame", "st", "capt"}
PARTICLES = {"von", "van", "de", "der", "den", "ter", "del", "della", "di", "da", "la", "le", "du", "zu", "af", "av"}
SUFFIXES = {"inc", "ltd", "llc", "gmbh", "group", "the", "sa", "plc"}
STUDIO_WORDS = {
    "press": "press", "presses": "press", "pr": "press",
    "workshop": "workshop", "workshops": "workshop", "wkshp": "workshop", "wksp": "workshop",
    "collective": "collective", "collectives": "collective", "coll": "collective",
    "publishing": "publishing", "publishers": "publishing", "publisher": "publishing", "publ": "publishing", "pub": "publishing", "publications": "publishing",
    "company": "company", "companies": "company", "comp": "company", "co": "company",
    "studio": "studio", "studios": "studio", "std": "studio", "stud": "studio",
    "comics": "comics", "comic": "comics",
    "inkhouse": "inkhouse", "sons": "sons", "bros": "brothers", "brothers": "brothers",
}
ABBREVIATIONS = {
    "geo": "george", "wm": "william", "jos": "joseph", "chas": "charles", "benj": "benjamin", "thos": "thomas", "jas": "james", "robt": "robert",
    "alex": "alexander", "alexr": "alexander", "edw": "edward", "saml": "samuel", "danl": "daniel", "nathl": "nathaniel", "richd": "richard", "fredk": "frederick", "margt": "margaret", "eliz": "elizabeth", "kath": "katherine",
}
NICKNAMES = {
    "abby": "abigail", "al": "alexander", "alec": "alexander", "andy": "andrew", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "beppe": "giuseppe", "bea": "beatrice",
    "bess": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "charlie": "charles", "chris": "christopher",
    "chuck": "charles", "cathy": "catherine", "dan": "daniel", "dave": "david", "dick": "richard", "dima": "dmitri", "dolly": "dolores dorothy", "ed": "edward", "eddie": "edward", "eliza": "elizabeth",
    "ellie": "eleanor", "frank": "francis francisco", "fred": "frederick", "freddie": "frederick", "gabe": "gabriel", "greg": "gregory", "hank": "henry", "hans": "johannes", "harry": "henry", "jack": "john",
    "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "katya": "ekaterina",
    "kit": "christopher katherine", "kitty": "katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lola": "dolores",
    "lou": "louis louise", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "misha": "mikhail", "mike": "michael", "nate": "nathaniel", "nat": "nathaniel", "ned": "edward", "nell": "eleanor",
    "nick": "nicholas", "nora": "eleanor", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pepe": "giuseppe jose", "pete": "peter", "phil": "philip",
    "rick": "richard", "ricky": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sammy": "samuel", "sandy": "alexander sandra", "sasha": "alexander", "steve": "stephen", "sue": "susan", "susie": "susan",
    "ted": "theodore edward", "theo": "theodore", "tina": "christina", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "tricia": "patricia", "trish": "patricia", "vicky": "victoria", "vicki": "victoria", "will": "william", "willy": "william", "zack": "zachary", "jorge": "jorge", "vika": "victoria", "gabi": "gabriel", "drew": "andrew",
}
_FOLDED = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i", "’": "'"})


def fold(text: str) -> str:
    """Small letters without accents."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(_FOLDED))
    return "".join(ch for ch in text if not unicodedata.combining(ch)).translate(_FOLDED)


@lru_cache(maxsize=200_000)
def form_of(spelling: str) -> str:
    """The form of a spelling: ``p`` and the parts of a person, or ``s``, the kind of studio and its own words."""
    text = re.sub(r'["“”][^"“”]*["“”]', " ", fold(spelling)) if re.search(r'\w\s+["“]', spelling) else fold(spelling)
    text = re.sub(r"\bink[\s-]+(?:house|hse)\b\.?", "inkhouse", text)
    text = re.sub(r"(?:&|\+|\band\b)\s*sons\b", "sons", text)
    if "," in text:
        head, _, tail = text.partition(",")
        words = re.findall(r"[^\W_]+", tail)
        text = head if words and all(w in SUFFIXES for w in words) else f"{tail} {head}"
    tokens = [t for t in re.findall(r"[^\W_]+(?:'[^\W_]+)*", text) if t not in TITLES or len(text) < 4]
    kinds = [STUDIO_WORDS[t] for t in tokens if t in STUDIO_WORDS]
    long = [t for t in tokens if len(t) > 1 and t not in SUFFIXES]
    if kinds and len(long) > len(kinds) or (len(long) == 1 and len(tokens) - sum(t in SUFFIXES for t in tokens) == 1):
        core = [t for t in tokens if t not in STUDIO_WORDS and t not in SUFFIXES]
        return f"s {'+'.join(sorted(set(kinds))) or '?'} {' '.join(core)}"
    kept = [ABBREVIATIONS.get(t, t) for t in tokens if t not in PARTICLES or len(tokens) < 3]
    return "p " + " ".join(kept)


def canon_names(token: str) -> tuple[str, ...]:
    """The full names a token may stand for."""
    return tuple(NICKNAMES[token].split()) if token in NICKNAMES else (token,)


def _stable(text: str) -> int:
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 13)) & 0xFFFFFFFF


@lru_cache(maxsize=200_000)
def grams_of(form: str) -> tuple[int, ...]:
    """Hashed 4-grams of the words of a form, whatever their order; initials count as words of one letter."""
    kind, *words = form.split(" ")
    if kind == "s":
        words = [*words[1:], *(f"={w}" for w in words[0].split("+") if w != "?")]
    out: set[int] = set()
    for word in words:
        full = canon_names(word)[0]
        if full.startswith("="):
            out.add(_stable(full) & GRAM_BITS)
            continue
        padded = f"^{full}$"
        out.update(_stable(padded[k : k + 4]) & GRAM_BITS for k in range(max(1, len(padded) - 3)))
    return tuple(sorted(out))


class Weights:
    """Weights of grams and frequencies of words, both in hashed tables of fixed size."""

    def __init__(self, grams: np.ndarray, words: np.ndarray, n: int):
        self.idf = np.log1p(n / np.maximum(1.0, grams)).astype(np.float32)
        self.words = words
        held = words[words > 0]
        self.rare_count = float(np.quantile(held, RARE_SHARE)) if len(held) else 0.0
        self.vectors: dict[str, dict[int, float]] = {}

    def vector(self, form: str) -> dict[int, float]:
        """The unit vector of a form."""
        found = self.vectors.get(form)
        if found is None:
            grams = grams_of(form)
            raw = [float(self.idf[g % GRAMS]) for g in grams]
            norm = math.sqrt(sum(w * w for w in raw)) or 1.0
            if len(self.vectors) > 100_000:
                self.vectors.clear()
            self.vectors[form] = found = {g: w / norm for g, w in zip(grams, raw)}
        return found

    def cosine(self, a: str, b: str) -> float:
        """Cosine of two forms."""
        x, y = self.vector(a), self.vector(b)
        if len(x) > len(y):
            x, y = y, x
        return sum(w * y[g] for g, w in x.items() if g in y)

    def prefix(self, form: str, threshold: float) -> list[tuple[int, float]]:
        """The rarest grams of a form with the length of the vector from each on.

        They go on until what is left is too short to reach the threshold with any unit vector.  Vectors
        share the order (their weights are the same numbers, scaled), so the lengths at the first gram
        that two forms have in common bound their cosine.
        """
        vector = self.vector(form)
        rest, out = 1.0, []
        for gram in sorted(vector, key=lambda g: (-self.idf[g % GRAMS], g)):
            if rest < (threshold - 1e-6) ** 2:
                break
            out.append((gram, math.sqrt(rest)))
            rest -= vector[gram] ** 2
        return out

    def count(self, word: str) -> float:
        """How many forms have a word."""
        return float(self.words[_stable(word) % WORDS])

    def slip(self, a: str, b: str) -> bool:
        """Whether two words differ by one slip of the pen, and are not two words of their own."""
        if a in PARTICLES or b in PARTICLES:
            return False
        for x, y in ((a, b), (b, a)):
            if any(x == p + y for p in PARTICLES):
                return True
        if min(len(a), len(b)) < 4 or edits(a, b, 1) > 1:
            return False
        return self.passes(a, b, SLIP_RATE)

    def passes(self, a: str, b: str, rate: float) -> bool:
        """Whether the rarer of two words is no more frequent than slips of the other would make it.

        A binomial test of its count among the forms with either word; it is the same at every size.
        """
        few, many = sorted((int(self.count(a)), int(self.count(b))))
        return _tail(few, few + many, rate) >= UNLIKELY

    def rare(self, word: str) -> bool:
        """Whether a word is one of the rarer ones of the corpus."""
        return self.count(word) <= self.rare_count


@lru_cache(maxsize=100_000)
def _tail(few: int, n: int, rate: float) -> float:
    """Chance of ``few`` or more among ``n``; by the normal distribution where they are many."""
    if few <= n * rate:
        return 1.0
    if n > 200:
        return 0.5 * math.erfc((few - 0.5 - n * rate) / math.sqrt(2 * n * rate * (1 - rate)))
    return sum(math.comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(few, n + 1))


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; limit + 1 if more.

    Only the band of ``limit`` beside the diagonal is looked at, so long words cost no more than their length.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    far = limit + 1
    before: dict[int, int] = {}
    last = {j: j for j in range(min(len(b), limit) + 1)}
    for i, ca in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            if not j:
                row[0] = i
                continue
            cb = b[j - 1]
            best = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, before.get(j - 2, far) + 1)
            row[j] = best
        if min(row.values()) > limit:
            return far
        before, last = last, row
    return min(last[len(b)], far)


def relation(a: str, b: str, weights: Weights) -> int:
    """1 if two forms can be one name, -1 if they contradict each other, 0 if it can't be told."""
    if a == b:
        return 1
    if a[0] != b[0]:
        return -1
    return _studios(a, b, weights) if a[0] == "s" else _persons(a, b, weights)


def _studios(a: str, b: str, weights: Weights) -> int:
    _, kind_a, *core_a = a.split(" ")
    _, kind_b, *core_b = b.split(" ")
    if "?" not in (kind_a, kind_b) and kind_a != kind_b:
        return -1
    one, two = " ".join(core_a), " ".join(core_b)
    if one == two:
        return 1
    if weights.slip(one, two):
        return 1
    return 0 if edits(one, two, 2) <= 2 else -1


def _persons(a: str, b: str, weights: Weights) -> int:
    parts_a, parts_b = a.split(" ")[1:], b.split(" ")[1:]
    long_a, long_b = [t for t in parts_a if len(t) > 1], [t for t in parts_b if len(t) > 1]
    short_a, short_b = [t for t in parts_a if len(t) == 1], [t for t in parts_b if len(t) == 1]
    same: list[str] = []
    for t in list(long_a):
        twin = next((u for u in long_b if u == t or set(canon_names(t)) & set(canon_names(u))), None)
        if twin is not None:
            same.append(t if weights.count(t) <= weights.count(twin) else twin)
            long_a.remove(t)
            long_b.remove(twin)
    slips, near = 0, 0
    for t in list(long_a):
        twin = next((u for u in long_b if any(weights.slip(x, y) for x in canon_names(t) for y in canon_names(u))), None)
        if twin is not None:
            slips += 1
            same.append(t)
            long_a.remove(t)
            long_b.remove(twin)
    for t in list(long_a):
        twin = next((u for u in long_b if min(len(t), len(u)) >= 4 and edits(t, u, 2) <= 2 and weights.passes(t, u, SLIP_RATE)), None)
        if twin is not None:
            # Two slips of one long rare word, beside an equal given name, are still one name.
            twice = bool(same) and not slips and min(len(t), len(twin)) >= 8 and weights.rare(t) and weights.rare(twin)
            slips, near = slips + twice, near + (not twice)
            long_a.remove(t)
            long_b.remove(twin)
    if long_a and long_b or not (same or near):
        return -1
    doubtful = False
    # What is left of one side must be what the first initial of the other stands for.
    for rest, initials in ((long_a, short_b), (long_b, short_a)):
        if len(rest) > 1:
            return -1
        if rest:
            if not initials or not any(name.startswith(initials[0]) for name in canon_names(rest[0])):
                return -1
            if same and 3 * max(weights.count(t) for t in (rest[0], *canon_names(rest[0]))) < min(weights.count(t) for t in same):
                doubtful = True  # an initial stands for a given name, which families share
            initials.pop(0)
    if short_a and short_b:
        first = short_a[0] == short_b[0]
        if len(parts_a) - len(short_a) == 1 and len(parts_b) - len(short_b) == 1 and not first:
            return -1  # both given names are initials
        if first:
            short_a, short_b = short_a[1:], short_b[1:]
        if short_a and short_b and short_a[0] != short_b[0]:
            return -1
    return 0 if near or doubtful or slips > 1 else 1


def similarity(a: str, b: str, weights: Weights) -> int:
    """Similarity of two forms of a component, in units of 1 / UNIT; none if they contradict each other."""
    told = relation(a, b, weights)
    return 0 if told < 0 else round(weights.cosine(a, b) * (1.0 if told else 0.8) * UNIT)


def linkage(forms: list[str], weights: Weights, least: float = LINKAGE) -> list[int]:
    """Cluster of each form: the two clusters of greatest average similarity are merged while it reaches ``least``.

    Of equally similar pairs the one of the least members goes first.
    """
    n = len(forms)
    sums, sizes = np.zeros((n, n), dtype=np.int64), np.ones(n, dtype=np.int64)
    for i in range(n):
        for j in range(i + 1, n):
            sums[i, j] = sums[j, i] = similarity(forms[i], forms[j], weights)
    cluster = list(range(n))
    average = sums / float(UNIT)
    np.fill_diagonal(average, -1.0)
    while True:
        at = int(np.argmax(average))
        i, j = divmod(at, n)
        if average[i, j] < least:
            return cluster
        i, j = min(i, j), max(i, j)
        sums[i] += sums[j]
        sums[:, i] = sums[i]
        sizes[i] += sizes[j]
        fresh = sums[i] / (float(UNIT) * (sizes[i] * sizes))
        fresh[average[i] < 0] = -1.0
        average[i], average[:, i] = fresh, fresh
        average[j], average[:, j] = -1.0, -1.0
        cluster = [i if c == j else c for c in cluster]


def linkage_by_rounds(pairs: DataFrame, least: float = LINKAGE) -> DataFrame:
    """Average linkage as ``linkage`` does it, of pairs (a, b, total) of forms a < b with their similarity: (node, entity).

    Each round merges all pairs of clusters that are nearest to each other.  A merged cluster is
    never more similar to a third than the nearer of its halves was, so the order of the merges
    doesn't matter.  Clusters that reach ``least`` with no other are finished and leave the pairs.
    Only forms that were merged into another are returned; every round is materialised.
    """
    spark = pairs.sparkSession
    links = pairs.select("a", "b", "total", F.lit(1).cast("long").alias("size_a"), F.lit(1).cast("long").alias("size_b"))
    moved: DataFrame | None = None
    while True:
        links = links.withColumn("average", F.col("total").cast("double") / (F.lit(float(UNIT)) * (F.col("size_a") * F.col("size_b"))))
        # A pair comes before another by its average, then by its names.
        rank = F.struct((-F.col("average")).alias("far"), "a", "b", "size_a", "size_b")
        ends = links.where(F.col("average") >= least).select(F.explode(F.array("a", "b")).alias("node"), rank.alias("rank"))
        nearest = cut_lineage(ends.groupBy("node").agg(F.min("rank").alias("rank")))
        merges = nearest.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("rank.a").alias("into"), F.col("rank.b").alias("from"), (F.col("rank.size_a") + F.col("rank.size_b")).alias("size"))
        merges = cut_lineage(merges)
        if not merges.limit(1).count():
            break
        step = merges.select(F.col("from").alias("node"), F.col("into").alias("entity"))
        if moved is None:
            moved = step
        else:
            earlier = moved.join(step.select(F.col("node").alias("entity"), F.col("entity").alias("next")), "entity", "left").select("node", F.coalesce("next", "entity").alias("entity"))
            moved = earlier.unionByName(step)
        moved = cut_lineage(moved)
        renamed = merges.select(F.explode(F.array("into", "from")).alias("node"), F.col("into").alias("new"), F.col("size").alias("grown"))
        open_ = nearest.select("node").join(renamed, "node", "left")
        one = open_.select(F.col("node").alias("a"), F.coalesce("new", "node").alias("new_a"), F.col("grown").alias("grown_a"))
        two = open_.select(F.col("node").alias("b"), F.coalesce("new", "node").alias("new_b"), F.col("grown").alias("grown_b"))
        kept = links.join(one, "a").join(two, "b").where("new_a <> new_b").select(
            F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"), "total",
            *[F.when((F.col("new_a") < F.col("new_b")) == F.lit(first), F.coalesce("grown_a", "size_a")).otherwise(F.coalesce("grown_b", "size_b")).alias(name) for name, first in (("size_a", True), ("size_b", False))],
        )
        links = cut_lineage(kept.groupBy("a", "b").agg(F.sum("total").alias("total"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b")))
    return moved if moved is not None else spark.createDataFrame([], "node string, entity string")


def _table(rows: DataFrame, size: int) -> np.ndarray:
    """Counts by slot; at most ``size`` rows come to the driver."""
    found = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros(size, dtype=np.float32)
    out[found["slot"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float32)
    return out


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """The least member of each connected component: (node, root).

    Labels spread to the least neighbour and then to that one's own label, so a chain is halved in
    each round; every round is materialised in the shared folder.
    """
    both = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).unionByName(edges.select(F.col(right).alias("x"), F.col(left).alias("y"))).distinct()
    both = cut_lineage(both)
    labels = both.groupBy("x").agg(F.min("y").alias("least")).select(F.col("x").alias("node"), F.least("x", "least").alias("root"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("near"))
        closer = labels.join(near, F.col("node") == F.col("x"), "left").select("node", "root", F.least("root", "near").alias("next"))
        jump = closer.select(F.col("node").alias("n2"), F.col("next").alias("far"))
        new = cut_lineage(closer.join(jump, F.col("next") == F.col("n2"), "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next")))
        moved = new.where(F.col("next") < F.col("root")).limit(1).count()
        labels = new.select("node", F.col("next").alias("root"))
        if not moved:
            return labels


def _met(posted: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of forms that can reach the threshold, each once: where their first common gram is posted.

    Postings of a frequent gram are dealt into blocks, and each pair of blocks is a key of its own.
    """
    often = posted.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = posted.join(often, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("form"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = dealt.select("gram", F.col("own").alias("row"), every.alias("column"), F.col("form").alias("a"), "grams", "length", F.substring("form", 1, 1).alias("kind"))
    two = dealt.select("gram", every.alias("row"), F.col("own").alias("column"), F.col("form").alias("b"), F.col("grams").alias("grams_b"), F.col("length").alias("length_b"), F.substring("form", 1, 1).alias("kind"))
    near = (F.col("a") < F.col("b")) & (F.col("length") * F.col("length_b") >= threshold - 1e-6)
    met = one.join(two, ["gram", "kind", "row", "column"]).where(near)
    return met.where(F.get(F.array_intersect("grams", "grams_b"), F.lit(0)) == F.col("gram")).select("a", "b")


def _grams(form: str) -> Column:
    @F.pandas_udf("array<int>")
    def grams(values: pd.Series) -> pd.Series:
        return values.map(lambda f: list(grams_of(f)))

    return grams(form)


def _joined(spellings: DataFrame, name: str, threshold: float):
    """Spellings with their forms, the links between forms with their cosine, the broadcast weights, and the number of forms."""
    spark = spellings.sparkSession

    @F.pandas_udf("string")
    def formed(values: pd.Series) -> pd.Series:
        return values.map(form_of)

    distinct = spellings.select(F.trim(F.col(name).cast("string")).alias("spelling")).where(F.col("spelling").rlike(r"[^\s\p{Z}]")).distinct()
    named = cut_lineage(distinct.withColumn("form", formed("spelling")))
    forms = cut_lineage(named.select("form").distinct())

    @F.pandas_udf("array<int>")
    def words(values: pd.Series) -> pd.Series:
        return values.map(lambda f: [_stable(w) % WORDS for w in f.split(" ")[1 if f[0] == "p" else 2 :]])

    n = forms.count()
    by_gram = _table(forms.select(F.explode(_grams("form")).alias("gram")).select(F.pmod("gram", F.lit(GRAMS)).alias("slot")), GRAMS)
    by_word = _table(forms.select(F.explode(words("form")).alias("slot")), WORDS)
    shared = spark.sparkContext.broadcast((by_gram, by_word, n))

    @F.pandas_udf("array<struct<gram:int,length:double>>")
    def prefixes(values: pd.Series) -> pd.Series:
        w = _weights(shared)
        return values.map(lambda f: [dict(gram=g, length=n) for g, n in w.prefix(f, threshold)])

    @F.pandas_udf("double")
    def judged(one: pd.Series, two: pd.Series) -> pd.Series:
        w = _weights(shared)
        out = []
        for a, b in zip(one, two):
            c = w.cosine(a, b)
            out.append(c if c >= threshold and relation(a, b, w) > 0 else 0.0)
        return pd.Series(out)

    posted = forms.select("form", prefixes("form").alias("p")).select("form", F.col("p.gram").alias("grams"), F.explode("p").alias("at")).select("form", "grams", "at.gram", "at.length")
    posted = cut_lineage(posted)
    edges = cut_lineage(_met(posted, threshold).withColumn("cosine", judged("a", "b")).where("cosine > 0"))
    return named, edges, shared, n


def nearest_names(spellings: DataFrame, name: str, top: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """The ``top`` forms most similar to the form of each spelling, of those it is linked to: (spelling, place, other, cosine).

    The join is exact, so these are the true nearest; of equally similar ones the least comes first.
    Spellings without a link, null and blank ones give no row.
    """
    named, edges, _, _ = _joined(spellings, name, threshold)
    both = edges.select(F.col("a").alias("form"), F.col("b").alias("other"), "cosine").unionByName(edges.select(F.col("b").alias("form"), F.col("a").alias("other"), "cosine"))
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("form").orderBy(F.col("cosine").desc(), "other"))).where(F.col("place") <= top)
    return named.join(ranked, "form").select("spelling", "place", "other", "cosine")


def link_names(spellings: DataFrame, name: str, threshold: float = THRESHOLD, least: float = LINKAGE) -> DataFrame:
    """Spellings with the class they belong to and how many forms theirs is linked to: (spelling, entity, n_links), one row per distinct spelling.

    Null, empty and blank spellings give no row.  Spellings with the same form are always one class.
    entity is the least form of the class.  A form with no letters or digits is a class of its own.
    """
    spark = spellings.sparkSession
    named, edges, shared, n = _joined(spellings, name, threshold)
    links = edges.select(F.explode(F.array("a", "b")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n_links"))

    labels = cut_lineage(components(edges))
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(labels.join(sizes.where(F.col("n") > COMPONENT).select("root"), "root", "left_semi"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(pdf["node"])
        which = linkage(members, _weights(shared), least)
        return pd.DataFrame({"form": members, "entity": [members[c] for c in which]})

    # Components are small and many: a bucket of them goes to one call, each is clustered by itself.
    bucket = F.pmod(F.xxhash64("root"), F.lit(max(16, n // 2000))).cast("int")

    def clusters(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([cluster(part) for _, part in pdf.groupby("root")])

    small = labels.join(sizes.where(F.col("n") <= COMPONENT).select("root"), "root", "left_semi")
    grouped = small.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(clusters, "form string, entity string")
    if large.limit(1).count():
        # Averages count all pairs of a component, also those below the threshold: whatever has a gram in common.
        @F.pandas_udf("long")
        def similar(one: pd.Series, two: pd.Series) -> pd.Series:
            w = _weights(shared)
            return pd.Series([similarity(a, b, w) for a, b in zip(one, two)], dtype="int64")

        spread = large.select("root", F.col("node").alias("a"), _grams("node").alias("grams")).select("*", F.explode("grams").alias("gram"))
        spread = cut_lineage(spread)
        others = spread.select("root", F.col("a").alias("b"), F.col("grams").alias("grams_b"), "gram")
        common = spread.join(others, ["root", "gram"]).where("a < b").where(F.array_min(F.array_intersect("grams", "grams_b")) == F.col("gram"))
        pairs = cut_lineage(common.select("a", "b").withColumn("total", similar("a", "b")).where("total > 0"))
        grouped = grouped.unionByName(linkage_by_rounds(pairs, least).withColumnRenamed("node", "form"))
    known = named.join(grouped, "form", "left").join(links, "form", "left")
    return known.select("spelling", F.coalesce("entity", "form").alias("entity"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


_WEIGHTS: dict[object, Weights] = {}


def _weights(shared) -> Weights:
    """The weights of a broadcast, built once per worker."""
    key = getattr(shared, "_path", None) or id(shared.value[0])
    if key not in _WEIGHTS:
        _WEIGHTS.clear()
        _WEIGHTS[key] = Weights(*shared.value)
    return _WEIGHTS[key]


def linked_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of different spellings of one class: (name_a, name_b), name_a < name_b."""
    one = linked.select("entity", F.col("spelling").alias("name_a"))
    two = linked.select("entity", F.col("spelling").alias("name_b"))
    return one.join(two, "entity").where("name_a < name_b").select("name_a", "name_b")

