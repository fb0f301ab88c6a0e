"""Linking spellings: exact joins against brute force, relations, clusters, edges."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from quirefold.llm import names as N
from quirefold.llm.names import edits, form_of, link_names, linkage, linked_pairs, nearest_names, relation

PEOPLE = [(g, f) for g, f in itertools.product(["Theodore", "Susan", "Margaret", "Yusuf", "Ekaterina", "Richard", "Dolores", "Jordi"], ["Soshorkladal", "Lethhorkturk", "Nangbongvober", "Zendstindrecot", "Hunghesgilez", "Brarnsostumov"]) if (len(g) + 2 * len(f)) % 3]
STUDIOS = ["Gruthropsilt Ink House", "Peknovsuber Workshop", "Sandsandnez & Sons", "Wanpocsolez Publishing", "Soshorkladal Company"]


def weights(forms):
    grams, words = np.zeros(N.GRAMS, np.float32), np.zeros(N.WORDS, np.float32)
    for f in forms:
        for g in N.grams_of(f):
            grams[g % N.GRAMS] += 1
        for w in f.split(" ")[1 if f[0] == "p" else 2 :]:
            words[N._stable(w) % N.WORDS] += 1
    return N.Weights(grams, words, len(forms))


def test_forms():
    assert form_of("Soshorkladal, Theodore") == form_of("Dr. THEODORE  Soshorkladal") == form_of("Theodore-Soshorkladal") == form_of('Theodore "Ted" Soshorkladal') == "p theodore soshorkladal"
    assert form_of("K.Fultnelgres") == form_of("K Fultnelgres") == form_of("Fultnelgres, K.") == "p k fultnelgres"
    assert form_of("Sandsandnez & Sons") == form_of("Sandsandnez and Sons Ltd.") == "s sons sandsandnez"
    assert form_of("GRUTHROPSILT Ink Hse.") == form_of("Ink House Gruthropsilt") == form_of("Gruthropsilt Inkhouse, Inc.") == "s inkhouse gruthropsilt"
    assert form_of("Gruthropsilt") == "s ? gruthropsilt" and form_of("Łukasz Zoë") == "p lukasz zoe"
    for odd in ("", "?!", "-", "&", "x" * 10000, ", ,", '"'):
        assert isinstance(form_of(odd), str)


def test_edits():
    assert [edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abbc"), ("abc", "axc"), ("abcd", "badc"), ("abc", "xyz"), ("ab", "abcde"))] == [0, 1, 1, 1, 2, 3, 3]
    assert edits("a" * 200, "a" * 199 + "b", 1) == 1 and edits("ab" * 3000, "ab" * 2999 + "ba", 1) == 1 and edits("a" * 5000, "b" * 5000, 2) == 3

    def plain(a, b):
        rows = [list(range(len(b) + 1))]
        for i, ca in enumerate(a, 1):
            rows.append([i] + [0] * len(b))
            for j, cb in enumerate(b, 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (ca != cb))
                if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                    rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
        return rows[-1][-1]

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        for limit in (1, 2, 3):
            assert edits(a, b, limit) == min(plain(a, b), limit + 1), (a, b, limit)


def test_slips_are_told_by_their_share_not_their_number():
    forms = [f"p x{k:05} soshorkladal" for k in range(20000)] + [f"p y{k:05} soshorkladel" for k in range(2500)] + [f"p z{k:05} soshorkledal" for k in range(9000)]
    w = weights(forms)
    assert w.slip("soshorkladal", "soshorkladel") and not w.slip("soshorkladal", "soshorkledal")
    few = weights(["p a soshorkladal", "p b soshorkladal", "p c soshorkladel", "p d brarnsostumov", "p e brarnsostumof"])
    assert few.slip("soshorkladal", "soshorkladel") and few.slip("brarnsostumov", "brarnsostumof")
    long = weights(["p a " + "k" * 81 + "l", "p b " + "k" * 81 + "m"])
    assert relation("p a " + "k" * 81 + "l", "p a " + "k" * 81 + "m", long) == 1


def test_relations():
    spellings = [f"{g} {f}" for g, f in PEOPLE] + STUDIOS + ["Ted Soshorkladal"]
    w = weights([form_of(s) for s in spellings])

    def r(a, b):
        return relation(form_of(a), form_of(b), w)

    same = [("T. Soshorkladal", "Theodore Soshorkladal"), ("Soshorkladal, T. R.", "Theodore R. Soshorkladal"), ("Theodore Soshorkladl", "Theodore Soshorkladal"), ("Ted Soshorkladal", "Theodore Soshorkladal"), ("Wm. Roebuckson", "William Roebuckson"), ("Peknovsuber", "Peknovsuber Workshop"), ("Peknovsuber Workshops", "PEKNOVSUBER Wkshp."), ("Ana Destoshdib", "Ana de Stoshdib")]
    assert [r(*p) for p in same] == [1] * len(same)
    other = [("Susan Lethhorkturk", "Theodore Lethhorkturk"), ("S. Lethhorkturk", "Theodore Lethhorkturk"), ("S. N. Lethhorkturk", "S. M. Lethhorkturk"), ("Soshorkladal Company", "Theodore Soshorkladal"), ("Soshorkladal", "Theodore Soshorkladal"), ("Peknovsuber Workshop", "Peknovsuber Comics"), ("Susan Lethhorkturk", "Susan Nangbongvober")]
    assert [r(*p) for p in other] == [-1] * len(other)


def test_prefixes_lose_no_pair():
    rng = random.Random(5)
    forms = sorted({"p " + " ".join("".join(rng.choice(["stem", "vab", "grun", "dez", "lip", "kos"]) for _ in range(rng.randrange(1, 4))) for _ in range(2)) for _ in range(150)})
    w = weights(forms)
    posted = defaultdict(set)
    for f in forms:
        for g, length in w.prefix(f, 0.45):
            posted[g].add((f, length))
    met = {tuple(sorted((a, b))) for group in posted.values() for (a, x), (b, y) in itertools.combinations(group, 2) if x * y >= 0.45 - 1e-6}
    for a, b in itertools.combinations(forms, 2):
        if w.cosine(a, b) >= 0.45:
            assert (a, b) in met


@pytest.mark.parametrize("block", [2000, 4])
def test_join_in_blocks_is_whole(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(5)
    forms = sorted({"p " + " ".join("".join(rng.choice(["stem", "vab", "grun", "dez"]) for _ in range(rng.randrange(1, 4))) for _ in range(2)) for _ in range(120)})
    w = weights(forms)
    rows = [(f, [g for g, _ in w.prefix(f, 0.45)], g, n) for f in forms for g, n in w.prefix(f, 0.45)]
    met = [(r.a, r.b) for r in N._met(spark.createDataFrame(rows, "form string, grams array<int>, gram int, length double"), 0.45).collect()]
    assert len(met) == len(set(met)) and {(a, b) for a, b in itertools.combinations(forms, 2) if w.cosine(a, b) >= 0.45} <= set(met)


def test_nearest(spark):
    rows = [(v,) for v in ("Theodore Soshorkladal", "Theodore Soshorkladl", "T. Soshorkladal", "Susan Brarnsostumov", None, " ")]
    got = {(r.spelling, r.place): r.other for r in nearest_names(spark.createDataFrame(rows, "val string"), "val", 1).collect()}
    assert got["Theodore Soshorkladl", 1] == "p theodore soshorkladal" and not any(s.startswith("Susan") for s, _ in got) and {p for _, p in got} == {1}
    linked = {r.spelling: r.n_links for r in link_names(spark.createDataFrame(rows, "val string"), "val").collect()}
    assert linked["Susan Brarnsostumov"] == 0 and linked["Theodore Soshorkladl"] >= 1


def test_linkage_keeps_relatives_apart():
    forms = sorted(form_of(s) for s in ("Theodore Soshorkladal", "T. Soshorkladal", "Theodore R. Soshorkladal", "Susan Soshorkladal", "Susan Soshorkladl"))
    w = weights(forms + [form_of(f"{g} {f}") for g, f in PEOPLE])
    which = dict(zip(forms, linkage(forms, w)))
    assert which["p theodore soshorkladal"] == which["p t soshorkladal"] == which["p theodore r soshorkladal"] != which["p susan soshorkladal"] == which["p susan soshorkladl"]


def variants(given, family, rng):
    k = rng.randrange(2, len(family) - 2)
    return [f"{given} {family}", f"{family}, {given}", f"{given[0]}. {family}", f"{given}  {family.upper()}", f"{given} {family[:k]}{family[k + 1 :]}", f"Dr. {given} {family}", f"{given} Q. {family}"]


def test_clusters_in_spark(spark):
    rng = random.Random(6)
    truth = {}
    for g, f in PEOPLE:
        for v in rng.sample(variants(g, f, rng), 4) + [f"{g} {f}"]:
            truth[v] = (g, f)
    for s in STUDIOS:
        for v in (s, s.upper(), f"{s}, Inc.", f"The {s}"):
            truth[v] = s
    rows = [(v, "x") for v in truth] * 2 + [(None, "x"), ("", "x"), (" ", None), ("?!", "x"), ("n" * 3000, "x")]
    linked = link_names(spark.createDataFrame(rows, "val string, form string"), "val")
    out = {r.spelling: r.entity for r in linked.collect()}
    assert set(out) == set(truth) | {"?!", "n" * 3000}
    got = {(r.name_a, r.name_b) for r in linked_pairs(linked).collect()}
    want = {(a, b) for a, b in itertools.permutations(truth, 2) if a < b and truth[a] == truth[b]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want), (list(want - got)[:5], list(got - want)[:5])


def test_components(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_empty(spark):
    df = spark.createDataFrame([], "val string")
    assert link_names(df, "val").collect() == []


def test_linking_does_not_depend_on_the_bound(spark, monkeypatch):
    """A dense family of names chained by slips and initials gets the same classes by one task and by all."""
    rng = random.Random(9)
    rows = [(v,) for g, f in [*PEOPLE[:8], ("Tabea", PEOPLE[0][1]), ("Theodora", PEOPLE[0][1])] for _ in range(3) for v in variants(g, f, rng)]
    df = spark.createDataFrame(rows, "val string")
    out = []
    for bound in (1500, 3):
        monkeypatch.setattr(N, "COMPONENT", bound)
        out.append({r.spelling: r.entity for r in link_names(df, "val").collect()})
    assert len(set(out[0].values())) < len(out[0]) / 3
    assert out[0] == out[1], (len(set(out[0].values())), len(set(out[1].values())))
