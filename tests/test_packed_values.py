"""Packed fields: splits, quoting, positions and the edges."""

from quirefold.operators.packed_values import clean_value, explode_packed, lattice, pieces


def split(spark, rows, fields=("writers",)):
    df = spark.createDataFrame(rows, "info_id long, " + ", ".join(f"{f} string" for f in fields) + ", val string, raw string, pos int") if rows else spark.createDataFrame([], "info_id long, writers string")
    out = {}
    for r in explode_packed(df, ["info_id"], fields).orderBy("info_id", "field_name", "pos").collect():
        out.setdefault((r.info_id, r.field_name), []).append((r.pos, r.val))
    return out


KNOWN = [f"{a} {b}" for a in ("Ann", "Bo", "Cy") for b in ("Roe", "Poe", "Doe")]


def corpus():
    """Single names, quoted reversed names and a firm with a comma teach the frequencies."""
    rows = [(100 + k, n) for k, n in enumerate(KNOWN * 3)]
    rows += [(200 + k, f'"{b}, {a}"') for k, (a, b) in enumerate([("Ann", "Roe"), ("Bo", "Poe"), ("Cy", "Doe"), ("Di", "Fay")] * 3)]
    rows += [(300 + k, '"Ink & Sons"') for k in range(3)] + [(310, '"Quill Comics, Inc."')]
    return rows


def test_delimiters_and_quotes(spark):
    rows = corpus() + [
        (1, "Ann Roe, Bo Poe & Cy Doe"), (2, 'Ann Roe; "Poe, Bo"; Cy Doe'), (3, "Poe, Bo; Ann Roe"), (4, "Ann Roe;Bo Poe, Cy Doe"), (5, '["Ann Roe", "Dmitri \\"Dima\\" Doe"]'),
        (6, 'Ann Roe, "Samuel ""Sam"" Doe"'), (7, "Ann Roe, , Bo Poe,"), (8, "Ann Roe and Bo Poe"), (9, "Ann Roe\nBo Poe\nAnn Roe"), (10, '"Ink & Sons", Bo Poe'), (11, "  Ann Roe / Bo  Poe "), (12, "Ann Roe、Bo Poe"),
    ]
    got = split(spark, [(i, v, "x", "y", 7) for i, v in rows])
    want = {
        1: ["Ann Roe", "Bo Poe", "Cy Doe"], 2: ["Ann Roe", "Poe, Bo", "Cy Doe"], 3: ["Poe, Bo", "Ann Roe"], 4: ["Ann Roe", "Bo Poe", "Cy Doe"], 5: ["Ann Roe", 'Dmitri "Dima" Doe'],
        6: ["Ann Roe", 'Samuel "Sam" Doe'], 7: ["Ann Roe", "Bo Poe"], 8: ["Ann Roe", "Bo Poe"], 9: ["Ann Roe", "Bo Poe", "Ann Roe"], 10: ["Ink & Sons", "Bo Poe"], 11: ["Ann Roe", "Bo  Poe"], 12: ["Ann Roe", "Bo Poe"],
    }
    for i, vals in want.items():
        assert got[i, "writers"] == list(enumerate(vals, 1)), i


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \u00a0"), (4, ","), (5, '"'), (6, 'a "b'), (7, '""'), (None, "X Y, Z W"), (8, "A B"), (8, "A B"), (9, ", ".join(f"N{k} M{k}" for k in range(3000)))]
    got = split(spark, [(i, v, None, None, None) for i, v in corpus() + rows])
    assert not any((i, "writers") in got for i in (1, 2, 3, 4, 7))
    assert got[5, "writers"] == [(1, '"')] and got[6, "writers"] == [(1, 'a "b')]
    assert got[8, "writers"] == [(1, "A B")] and len(got[9, "writers"]) == 3000
    assert [v for _, v in got[None, "writers"]] == ["X Y", "Z W"]
    assert split(spark, []) == {}


def test_lattice_is_linear():
    raw = ", ".join("ab" for _ in range(2000))
    assert len(pieces(raw)) == 2000 and len(lattice(raw)) <= 3 * 2000
    assert clean_value(' "a ""b"" c" ') == 'a "b" c'


def test_long_names_seen_elsewhere_stay_whole(spark):
    """A name with three inner delimiters or more is a value where it occurs elsewhere in the column."""
    firm, longer = "Hart, Vance & Sons, Inc.", "Low, Hill, Marsh, Wood & Field, Ltd."
    rows = corpus() + [(1, f'"{firm}"'), (2, firm), (3, f"Ann Roe; {firm}"), (4, f"{firm}; Bo Poe"), (5, f'"{longer}"'), (6, f"Bo Poe; {longer}; Cy Doe"), (7, "Ann Roe, Bo Poe, Cy Doe, Ann Poe")]
    got = split(spark, [(i, v, None, None, None) for i, v in rows])
    want = {1: [firm], 2: [firm], 3: ["Ann Roe", firm], 4: [firm, "Bo Poe"], 5: [longer], 6: ["Bo Poe", longer, "Cy Doe"], 7: ["Ann Roe", "Bo Poe", "Cy Doe", "Ann Poe"]}
    assert {i: [v for _, v in got[i, "writers"]] for i in want} == want
