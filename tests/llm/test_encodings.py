"""Garbled text: exact round trips through wrong decodings, and nothing else touched."""

import random

import numpy as np
import pytest

from quirefold.llm import encodings as E
from quirefold.llm.encodings import inverse, max_segments, restore_fields

WORDS = {
    "fr": "la clé gelée de l'été près du château où le géomètre léger rêve à la fenêtre brûlée du pêcheur",
    "de": "der grüne Bäcker hütet die schöne Mütze über der großen Brücke für den müden Türmer",
    "ru": "северный берег старый мастер идёт через пустой вокзал какой упрямый сосед последняя книга",
    "es": "el niño cruza la montaña mañana sin mirar atrás con la brújula y el corazón del capitán",
    "ja": "古い時計職人は図書館で鍵を探している 静かな船長の手紙 魔女と地図",
}


def corpus(n=500):
    rng = random.Random(1)
    out = []
    for k in range(n):
        words = WORDS[list(WORDS)[k % 5]].split()
        out.append(" ".join(rng.choice(words) for _ in range(6)).capitalize())
    return out


GARBLINGS = [("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "cp437"), ("utf_8", "mac_roman"), ("cp1251", "latin_1"), ("koi8_r", "cp1251"), ("mac_roman", "latin_1")]


def misread(text, written, read):
    raw = text.encode(written)
    return "".join(bytes([b]).decode(read, "replace") if bytes([b]).decode(read, "replace") != "�" else chr(b) for b in raw)


def test_max_segments():
    assert max_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]
    assert max_segments([-1, -2]) == [] and max_segments([]) == []


def test_inverse():
    assert inverse("clÃ©", "cp1252", "utf_8") == "clé" and inverse("clé", "cp1252", "utf_8") is None and inverse("ж", "cp1252", "utf_8") is None


@pytest.fixture(scope="module")
def result(spark):
    clean = corpus()
    rows = [(k, t, None, "") for k, t in enumerate(clean)]
    damaged = {}
    for j, (written, read) in enumerate(GARBLINGS):
        n = 0
        for t in clean[j::3]:
            try:
                bad = misread(t, written, read)
            except UnicodeEncodeError:
                continue
            if bad != t and n < 6:
                n += 1
                damaged[1000 + len(damaged)] = (t, bad)
    rows += [(k, bad, None, "") for k, (_, bad) in damaged.items()]
    rows += [(2000, "La cl� gel�e", "x", ""), (2001, "Plain ASCII text", None, ""), (2001, "Plain ASCII text", None, ""), (2002, None, None, None), (None, "la clÃ© gelÃ©e", None, ""), (2003, "Сhаpter of the brіdge", None, ""), (2004, "é" * 50000, None, "")]
    df = spark.createDataFrame(rows, "info_id long, title string, series string, restored string")
    return clean, damaged, {(r.info_id, r.field_name): r for r in restore_fields(df, "info_id", ["title", "series"]).collect()}


def test_damage_is_found_and_undone(result):
    _, damaged, got = result
    found = [k for k in damaged if (k, "title") in got]
    assert len(found) >= 0.95 * len(damaged)
    right = sum(got[k, "title"].restored == damaged[k][0] for k in found)
    assert right >= 0.9 * len(damaged), [(damaged[k], got[k, "title"].restored) for k in found if got[k, "title"].restored != damaged[k][0]][:5]


def test_the_rest_is_left_alone(result):
    clean, damaged, got = result
    assert not [k for k in range(len(clean)) if (k, "title") in got]
    lost = got[2000, "title"]
    assert lost.restored == lost.original and not lost.changed
    assert (None, "title") in got and not any((k, "title") in got for k in (2001, 2002, 2003, 2004)) and not any(f == "series" for _, f in got)


def test_empty(spark):
    assert restore_fields(spark.createDataFrame([], "info_id long, title string"), "info_id", ["title"]).collect() == []


@pytest.fixture(scope="module")
def model():
    pairs, singles = np.zeros(E.PAIRS, np.float32), np.zeros(E.SINGLES, np.float32)
    for t in [*corpus(), *(t.replace(" ", "") for t in corpus())]:
        padded = f" {t} "
        for a, b in set(zip(padded, padded[1:])):
            pairs[E._hash(a + b) % E.PAIRS] += 1
            singles[E._hash(a) % E.SINGLES] += 1
    return E.PairModel(pairs, singles)


def unspaced(n):
    """About n characters of Japanese UTF-8, when it was misread."""
    rng = random.Random(n)
    out = ""
    while 3 * len(out) < n:
        out += rng.choice(WORDS["ja"].split())
    return out


@pytest.mark.parametrize("read", ["mac_roman", "cp437"])
@pytest.mark.parametrize("n", [1500, 3000, 50000])
def test_long_values_without_blanks(model, n, read):
    text = unspaced(n)
    bad = misread(text, "utf_8", read)
    assert " " not in bad and E.restore(bad, model) == (text, True)


@pytest.mark.parametrize("read", ["mac_roman", "cp437"])
def test_a_lost_byte_costs_one_block(model, read):
    """What can't be restored as a whole is restored in blocks that cut no sequence."""
    text = unspaced(20000)
    bad = misread(text, "utf_8", read)
    got, garbled = E.restore(bad[:9000] + bad[9001:], model)
    assert garbled and got[:2000] == text[:2000] and sum(ch in set(text) for ch in got) >= 0.6 * len(text)


@pytest.mark.parametrize("written,read", [("utf_8", "mac_roman"), ("utf_8", "cp437"), ("euc_jp", "mac_roman"), ("cp932", "cp437"), ("utf_8", "gbk")])
def test_blocks_cut_no_sequence(written, read):
    raw = unspaced(30000).encode(written)
    bad = raw.decode(read, "ignore") if read == "gbk" else misread(unspaced(30000), written, read)
    blocks = E._blocks(bad, read, written)
    assert "".join(blocks) == bad and len(blocks) > 3 and max(map(len, blocks)) <= E.LONGEST_RUN
    if read != "gbk":
        assert "".join(inverse(b, read, written) for b in blocks) == unspaced(30000)
