"""Splitting fields that hold several values behind inconsistent delimiters.

The delimiters are ambiguous: a comma separates two names or stands inside one (``Roe, Ann``,
``Inkwell, Inc.``), an ampersand joins two people or belongs to a firm.  The splits are therefore
chosen by a unigram segmentation model whose value frequencies are learned from the whole column
by expectation-maximisation; a Viterbi search over the lattice of candidate delimiters then picks
the likeliest split of each field.  Quoted spans are atomic, and a bracketed list of quoted strings
is read as such.

Values without a candidate delimiter never enter the lattice.  The work runs on distinct raw
values, each counted once, so a value that fills a third of the table costs one lattice and its own
repetition is no evidence for how it splits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import cut_lineage

#: Candidate delimiters outside quotation marks.
DELIMITER = r"[,;/|&+、，；／｜＆\n\r\t]|(?<=\s)(?:and|AND)(?=\s)"
_DELIMITER = re.compile(DELIMITER)
_LIST = re.compile(r'^\s*\[\s*(".*")\s*\]\s*$', re.S)
_QUOTED = re.compile(r'"(?:[^"\\]|""|\\.)*"', re.S)
#: A value that is seen nowhere else in the column may contain at most this many delimiters itself.
MAX_INNER = 2
#: Rounds of expectation-maximisation end when the shares of the shapes change less than this in all; the number is a safeguard.
SETTLED, ROUNDS = 0.002, 25
#: The shapes of values are counted in so many hashed classes: the table sent to the tasks has this size.
SHAPES = 4096
#: Prior count of a shape without and with a delimiter inside; the latter have the odd slots.
_PLAIN, _INNER = 0.001, 1e-12
#: Chance of one more letter or digit in an unseen value.
_PER_CHAR = math.log(1 / 20)
_ARC = "array<struct<start:int,stop:int,val:string,shape:int>>"


def clean_value(piece: str) -> str:
    """A value without outer blanks and enclosing quotation marks; doubled or escaped marks count as one."""
    piece = piece.strip()
    if len(piece) >= 2 and piece[0] == '"' and _QUOTED.fullmatch(piece):
        piece = re.sub(r'""|\\(.)', lambda m: m.group(1) or '"', piece[1:-1], flags=re.S).strip()
    return piece


def _shape_text(piece: str) -> str:
    """Word classes of a value: initial, abbreviation, hyphened, dotted, word, with its inner delimiters kept."""
    out = []
    for token in re.findall(rf"{DELIMITER}|[^\s,;/|&+、，；／｜＆]+", piece.strip().strip('"')):
        if _DELIMITER.fullmatch(token) or token in ("and", "AND"):
            out.append("&" if token in ("and", "AND") else token)
        elif re.fullmatch(r"\w\.?", token):
            out.append("i")
        elif token.endswith("."):
            out.append("a")
        elif "-" in token:
            out.append("h")
        elif "." in token:
            out.append("d")
        elif not out or out[-1] != "W":
            out.append("W" if out and out[-1] == "w" else "w")
    return "".join(out[:12])


def shape_of(piece: str) -> int:
    """The hashed shape class of a value, stable across processes; odd if it has a delimiter inside."""
    h, text = 2166136261, _shape_text(piece)
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h % (SHAPES // 2) * 2 + any(ch not in "iahdwW" for ch in text)


def pieces(raw: str) -> list[tuple[int, int]]:
    """Spans between the candidate delimiters of a raw field; quoted spans hold none."""
    body = _LIST.match(raw)
    start, stop = (body.start(1), body.end(1)) if body else (0, len(raw))
    masked = list(raw)
    at = start
    while (m := _QUOTED.search(raw, at, stop)) is not None:
        before = raw[start : m.start()].rstrip(" ")
        opens = not before or bool(_DELIMITER.match(before[-1])) or raw[m.start() - 1].isspace()
        if opens:
            masked[m.start() : m.end()] = "\x00" * (m.end() - m.start())
            at = m.end()
        else:
            at = m.start() + 1
    text = "".join(masked)
    out, left = [], start
    for m in _DELIMITER.finditer(text, start, stop):
        out.append((left, m.start()))
        left = m.end()
    return [*out, (left, stop)]


def lattice(raw: str, max_inner: int = MAX_INNER) -> list[tuple[int, int, str, int]]:
    """Arcs (start, stop, value, shape) between the candidate delimiters ``start..stop`` of a field."""
    spans = pieces(raw)
    arcs = []
    for i in range(len(spans)):
        for j in range(i + 1, min(len(spans), i + 1 + max_inner) + 1):
            text = raw[spans[i][0] : spans[j - 1][1]]
            if j > i + 1 and any(not raw[a:b].strip() for a, b in spans[i:j]):
                break  # an empty place is always a split
            quoted = [raw[a:b].strip().startswith('"') for a, b in spans[i:j]]
            if j > i + 1 and any(quoted):
                break  # a quoted span is a value of its own
            value = clean_value(text)
            arcs.append((i, j, value, shape_of(value)))
    return arcs


def _spans(raw: str) -> list[dict]:
    """Where each piece of a field stands, its text, and how many pieces from it on could be of one value."""
    found, reach, out = pieces(raw), 0, []
    for a, b in reversed(found):
        text = raw[a:b].strip()
        reach = 0 if not text or text.startswith('"') else reach + 1
        out.append(dict(start=a, stop=b, text=text, reach=reach))
    return out[::-1]


def _long_arcs(marked: DataFrame, is_sure, max_inner: int) -> DataFrame:
    """Arcs of more than ``max_inner`` delimiters whose value occurs in another field too: raw, n, start, stop, val, shape.

    A value is looked for wherever its first piece stands, so no field is cut into all its spans.
    """

    @F.pandas_udf("array<struct<start:int,stop:int,text:string,reach:int>>")
    def spans_of(raws: pd.Series) -> pd.Series:
        return raws.map(_spans)

    @F.pandas_udf("int")
    def shapes_of(values: pd.Series) -> pd.Series:
        return values.map(shape_of)

    # Values of their own: whole fields, and what stands in quotation marks in fields without a choice.
    whole = marked.where(~is_sure).select("raw", F.trim("raw").alias("val"))
    quoted = marked.where(is_sure).select("raw", F.explode("arcs.val").alias("val"))
    sources = whole.unionByName(quoted).distinct()
    spans = sources.select("val").distinct().withColumn("spans", spans_of("val"))
    known = spans.where((F.size("spans") > max_inner + 1) & (F.col("spans")[0]["reach"] == F.size("spans")))
    known = cut_lineage(known.select("val", F.size("spans").alias("k"), F.col("spans")[0]["text"].alias("text")))
    fields = marked.where(~is_sure).select("raw", "n", spans_of("raw").alias("spans")).select("raw", "n", F.posexplode("spans").alias("start", "s")).where(F.col("s.reach") > max_inner + 1)
    met = fields.select("raw", "n", "start", F.col("s.start").alias("at"), "s.reach", "s.text").join(known, "text").where(F.col("k") <= F.col("reach"))
    # Only blanks may stand before the first piece; the value follows as it is, and ends where its last piece does.
    body = F.regexp_replace(F.substring(F.col("raw"), F.col("at") + 1, F.length("raw")), r"^[\s\p{Z}]+", "")
    after = F.substring(body, F.length("val") + 1, F.length(body))
    ends = (F.regexp_replace(after, r"[\s\p{Z}]+", "") == "") | after.rlike(r"(?s)^[ \u00a0]*[,;/|&+、，；／｜＆\n\r\t]|^\s+(?:and|AND)\s")
    met = cut_lineage(met.where(body.startswith(F.col("val")) & ends).select("raw", "n", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("k")).cast("int").alias("stop"), "val"))
    seen = met.select("raw", "val").unionByName(sources.join(known.select("val"), "val", "left_semi").select("raw", "val"))
    often = seen.distinct().groupBy("val").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("val")
    return met.join(often, "val", "left_semi").select("raw", "n", "start", "stop", "val", shapes_of("val").alias("shape"))


def _log_probability(value: str, shape: int, count: float, total: float, shapes: np.ndarray) -> float:
    """Interpolates the learned frequency of a value with that of its shape."""
    if not value:
        return 0.0
    unseen = shapes[shape] * math.exp(max(-600.0, _PER_CHAR * sum(map(str.isalnum, value))))
    return math.log((count + unseen) / (total + 1.0) + 1e-300)


def _forward(n: int, arcs: Sequence, weight: Sequence[float], best: bool):
    """Log scores of reaching each place, and the best incoming arc."""
    score, back = [-math.inf] * (n + 1), [-1] * (n + 1)
    score[0] = 0.0
    for k in sorted(range(len(arcs)), key=lambda k: (arcs[k]["start"], arcs[k]["stop"])):
        i, j = arcs[k]["start"], arcs[k]["stop"]
        s = score[i] + weight[k]
        if best:
            if s > score[j]:
                score[j], back[j] = s, k
        elif s > -math.inf:
            hi, lo = max(score[j], s), min(score[j], s)
            score[j] = hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))
    return score, back


def posterior(arcs: Sequence, total: float, shapes: np.ndarray) -> list[float]:
    """Chance of each arc over all segmentations of its field."""
    n = max(a["stop"] for a in arcs)
    weight = [_log_probability(a["val"], a["shape"], a["count"] or 0.0, total, shapes) for a in arcs]
    ahead, _ = _forward(n, arcs, weight, best=False)
    flipped = [{"start": n - a["stop"], "stop": n - a["start"]} for a in arcs]
    behind, _ = _forward(n, flipped, weight, best=False)
    return [math.exp(min(0.0, ahead[a["start"]] + w + behind[n - a["stop"]] - ahead[n])) for a, w in zip(arcs, weight)]


def viterbi(arcs: Sequence, total: float, shapes: np.ndarray) -> list[str]:
    """The non-empty values of the likeliest segmentation, in order."""
    n = max(a["stop"] for a in arcs)
    weight = [_log_probability(a["val"], a["shape"], a["count"] or 0.0, total, shapes) for a in arcs]
    _, back = _forward(n, arcs, weight, best=True)
    out, at = [], n
    while at > 0:
        arc = arcs[back[at]]
        out.append(arc["val"])
        at = arc["start"]
    return [v for v in reversed(out) if v]


def _shape_counts(values: DataFrame) -> np.ndarray:
    """Smoothed count of each shape class; the collected table has at most ``SHAPES`` rows."""
    counts = np.full(SHAPES, _PLAIN)
    counts[1::2] = _INNER
    for row in values.groupBy("shape").agg(F.sum("n").alias("n")).collect():
        counts[row["shape"]] += row["n"]
    return counts


def split_packed(values: DataFrame, raw: str, rounds: int = ROUNDS, max_inner: int = MAX_INNER) -> DataFrame:
    """Distinct raw values with the array ``vals`` of their parts, by EM and Viterbi.

    ``values`` has the raw field in column ``raw``, one row per occurrence.  Null, empty and blank
    fields have no parts and give no row.  Repeated parts stay; order is that of the field.  A part
    that is quoted is atomic; an unbalanced quotation mark is an ordinary character.
    Returns (raw, vals), one row per distinct raw value.
    """
    blank = F.col("raw").isNull() | (F.regexp_replace("raw", r"[\s\p{Z}]+", "") == "")
    distinct = values.select(F.col(raw).cast("string").alias("raw")).where(~blank).distinct().withColumn("n", F.lit(1.0))

    @F.pandas_udf(_ARC)
    def arcs_of(raws: pd.Series) -> pd.Series:
        return raws.map(lambda r: [dict(start=a, stop=b, val=v, shape=s) for a, b, v, s in lattice(r, max_inner)])

    marked = cut_lineage(distinct.withColumn("arcs", arcs_of("raw")))
    is_sure = F.size("arcs") == F.aggregate("arcs", F.lit(0), lambda acc, a: F.greatest(acc, a["stop"]))
    sure = marked.where(is_sure)
    lattices = marked.where(~is_sure)
    known = sure.select("n", F.explode("arcs").alias("a")).select("n", F.col("a.val").alias("val"), F.col("a.shape").alias("shape")).where("val <> ''")
    arcs = lattices.select("raw", "n", F.explode("arcs").alias("a")).select("raw", "n", "a.*")
    arcs = cut_lineage(arcs.unionByName(_long_arcs(marked, is_sure, max_inner)))

    first_shapes = _shape_counts(known)
    learned = known.groupBy("val").agg(F.sum("n").alias("count"))
    total = float(first_shapes.sum())
    shapes = first_shapes
    for _ in range(rounds):
        before = shapes / total
        expected = cut_lineage(_expectation(arcs, learned, total, shapes))
        shapes = _shape_counts(known.select("shape", "n").unionByName(expected.select("shape", F.col("m").alias("n"))))
        total = float(shapes.sum())
        # What one field alone suggests is no evidence for it: one count of each value is taken back.
        others = expected.groupBy("val").agg(F.sum("n").alias("n")).select("val", (F.col("n") - 1.0).alias("n")).where("n > 0")
        learned = known.select("val", "n").unionByName(others).groupBy("val").agg(F.sum("n").alias("count"))
        if float(np.abs(shapes / total - before).sum()) < SETTLED:
            break

    best = _segment(arcs, learned, total, shapes)
    plain = sure.select("raw", F.filter(F.transform("arcs", lambda a: a["val"]), lambda v: v != "").alias("vals"))
    return plain.unionByName(best)


def _weighed(arcs: DataFrame, learned: DataFrame) -> DataFrame:
    joined = arcs.join(learned, "val", "left")
    arc = F.struct("start", "stop", "val", "shape", F.coalesce("count", F.lit(0.0)).alias("count"))
    return joined.groupBy("raw").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(arc)).alias("arcs"))


def _expectation(arcs: DataFrame, learned: DataFrame, total: float, shapes: np.ndarray) -> DataFrame:
    """Expected counts under the present model, summed over all fields: of values (n) and of shapes (m).

    A field is evidence for a shape once, by its most certain value of that shape.
    """

    @F.pandas_udf("array<struct<n:double,m:double>>")
    def chances(lattices: pd.Series) -> pd.Series:
        def both(lattice) -> list[dict]:
            n = posterior(lattice, total, shapes)
            best: dict[int, int] = {}
            for k, arc in enumerate(lattice):
                if n[k] > n[best.setdefault(arc["shape"], k)]:
                    best[arc["shape"]] = k
            return [{"n": x, "m": x if best[arc["shape"]] == k else 0.0} for k, (x, arc) in enumerate(zip(n, lattice))]

        return lattices.map(both)

    zipped = F.explode(F.arrays_zip(F.col("arcs"), chances("arcs").alias("chance"))).alias("z")
    flat = _weighed(arcs, learned).select(zipped).select("z.chance.n", "z.chance.m", F.col("z.arcs.val").alias("val"), F.col("z.arcs.shape").alias("shape"))
    return flat.where("val <> '' and n > 1e-9").groupBy("val", "shape").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _segment(arcs: DataFrame, learned: DataFrame, total: float, shapes: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<string>")
    def best(lattices: pd.Series) -> pd.Series:
        return lattices.map(lambda a: viterbi(a, total, shapes))

    return _weighed(arcs, learned).select("raw", best("arcs").alias("vals"))


def explode_packed(df: DataFrame, keys: Sequence[str], fields: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """One row per value of the packed ``fields``: keys, field_name, pos (from 1), n_vals, val.

    Rows delivered twice (equal keys) count once: of differing copies the smallest raw value is
    taken.  Null keys are one key.  Null, empty and blank fields give no rows.  Columns of ``df``
    other than keys and fields are ignored, whatever their names.
    """
    stacked = df.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)],
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("raw")) for f in fields])).alias("c"),
    )
    names = [f"key_{i}" for i in range(len(keys))]
    cells = stacked.select(*names, "c.field_name", "c.raw").groupBy(*names, "field_name").agg(F.min("raw").alias("raw"))
    parts = split_packed(cells, "raw", rounds)
    rows = cells.join(parts, "raw").select(*names, "field_name", F.size("vals").alias("n_vals"), F.posexplode("vals").alias("p", "val"))
    return rows.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "field_name", (F.col("p") + 1).alias("pos"), "n_vals", "val")

