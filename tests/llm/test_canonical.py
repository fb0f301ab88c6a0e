"""Canonical forms: equal looks become equal text; other scripts and pictures stay."""

import random
import unicodedata

import pytest

from quirefold.llm.canonical import canonical, canonical_fields

SAME = [
    "Vitamin Ω and the Nurse", "Station Δ 12", "Проект Vega 7", "Последняя лампа", "ブルー・図書館", "最后的天台", "El niño y la llave", "Größe 12: Der Müller", "SÃO João", "🦊👩‍🎨", "❤️",
    "これは？（はい）！", "A—B … ½ n.º № ™", "कक‍ष", "", " ", "A", "Ω",
]
CHANGED = {
    "Ｃｈａｐｔｅｒ　５": "Chapter 5", "Capítulo": "Capítulo", "Die Tür": "Die Tür", "Le héritier": "Le héritier", "B​ee⁠keep﻿erof­": "Beekeeperof", "ab‎cd": "abcd",
    "Сhаptеr 2": "Chapter 2", "А Map of Mаy": "A Map of May", "A Мар of May": "A Map of May", "Cançãο do ferreiro": "Canção do ferreiro", "Νοtes for a Smuggler": "Notes for a Smuggler", "Xpоники севера": "Хроники севера",
    "Lʹété": "L'été", "L’été": "L'été", "chapter‑1": "chapter-1", "ﬁn": "fin", "Key": "Key", "ガラス".replace("ガ", "ガ"): "ガラス", "ｶﾞﾗｽ": "ガラス", "第７話": "第7話", "𝐀bc": "Abc",
}


@pytest.mark.parametrize("text", SAME)
def test_stays(text):
    assert canonical(text) == text


@pytest.mark.parametrize("text", CHANGED)
def test_changes(text):
    assert canonical(text) == CHANGED[text] and canonical(CHANGED[text]) == CHANGED[text]


def test_idempotent_and_composed():
    rng = random.Random(3)
    pool = "abé́Ωжо​ ｆ１第ガ'’-‑🦊 /"
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        once = canonical(text)
        assert canonical(once) == once and unicodedata.normalize("NFC", once) == once, ascii(text)


def test_table(spark):
    rows = [(1, "Ｃｈ", None, "x"), (1, "Ｃｈ", None, "x"), (2, None, "", "y"), (None, "A B", " ", ""), (3, "é" * 40000 + "​", "Ch", "")]
    df = spark.createDataFrame(rows, "info_id long, title string, series string, plain string")
    got = {(r.info_id, r.field_name): (r.original, r.plain, r.changed) for r in canonical_fields(df, "info_id", ["title", "series"]).collect()}
    assert got[1, "title"] == ("Ｃｈ", "Ch", True) and got[2, "series"] == ("", "", False) and got[None, "title"] == ("A B", "A B", True)
    assert (2, "title") not in got and got[3, "title"][1] == "é" * 40000 and len(got) == 6
    assert canonical_fields(df.limit(0), "info_id", ["title"]).collect() == []


def test_jvm_check_misses_nothing(spark):
    """What the JVM's quick check lets pass is stable."""
    rng = random.Random(4)
    pool = "abéx́Ωжоа​ ｆ１第ガ'’-‑🦊𝐀 ﬁK"
    texts = [*SAME, *CHANGED, *("".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(800))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    assert all(r.plain == canonical(r.original) for r in canonical_fields(df, "id", ["t"]).collect())


ASSIGNED = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs", "Cc")]


@pytest.mark.parametrize("one,two", [("\u0915\u093c", "\u0958"), ("\u09a1\u09bc", "\u09dc"), ("\u05e9\u05c1", "\ufb2a"), ("\u0644\u0627", "\ufefb"), ("\u9f8d", "\u2fd3"), ("\u09c7\u09be", "\u09cb"), ("\u30ab\uff9e", "\u30ac"), ("\u05d1\u05b8\u05bc", "\u05d1\u05bc\u05b8")])
def test_other_scripts(one, two):
    assert canonical(one) == canonical(two) == unicodedata.normalize("NFC", canonical(two))


def test_every_character():
    """Equal looks of all assigned characters become equal text, once and for all."""
    for ch in ASSIGNED:
        text = f"x{ch}"
        once = canonical(text)
        assert unicodedata.is_normalized("NFC", once) and canonical(once) == once, ascii(text)
        assert canonical(unicodedata.normalize("NFD", text)) == once == canonical(unicodedata.normalize("NFC", text)), ascii(text)


def test_jvm_check_misses_no_character(spark):
    texts = [f"x{ch}" for ch in ASSIGNED if canonical(f"x{ch}") != f"x{ch}"] + ["".join(ASSIGNED[k : k + 1]) for k in range(0, len(ASSIGNED), 97)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    wrong = [ascii(r.original) for r in canonical_fields(df, "id", ["t"]).collect() if r.plain != canonical(r.original)]
    assert len(texts) > 5000 and not wrong, (len(wrong), wrong[:9])
