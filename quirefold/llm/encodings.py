"""Finding and restoring text that was decoded with the wrong character encoding.

A model of adjacent characters is counted over the whole corpus.  Pairs are scored by their mutual
information; maximum-scoring segments of improbable pairs, widened to whole words, are the runs in
which inverse mappings (encode as it was wrongly read, decode as it was meant) are tried.  A mapping
is taken where the model finds the restored text likelier in its surroundings than what stands
there.  What holds replacement or control characters is garbled even if nothing restores it.

Values that structurally look misread are left out of the counts, so that frequent garbling does
not teach the model that it is text.  Counts are kept in tables of fixed size, by hash.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import cut_lineage

#: Sizes of the hashed tables of character pairs and single characters: what is sent to the tasks never exceeds them.
PAIRS, SINGLES = 1 << 19, 1 << 16
# Codecs text was read as, and codecs it may have been written in.
READ_AS = ("cp1252", "latin_1", "cp1251", "cp437", "mac_roman", "cp1250", "cp850", "koi8_r", "cp866", "iso8859_2", "mac_cyrillic", "iso8859_5", "cp1253", "cp1254", "cp932", "gbk", "iso8859_15")
WRITTEN_IN = ("utf_8", "cp1252", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850", "cp932", "gbk", "cp1250", "iso8859_2", "cp866", "euc_jp", "big5", "euc_kr", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7")
# Letters of other scripts that stand in for Latin ones, and invisible characters; they are no misreading.
LOOK_ALIKES = set("аеорсухіѕјԁɡҺһԛԝАВЕКМНОРСТХУІЅЈοανιρυτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ\u200b\u200c\u200d\u200e\u2060\ufeff\xad\xa0\u2002\u2007\u2009\u202f\u3000ʹ’‘ʼ‐‑K")
#: How much likelier (natural logarithm) a restored run must be, per changed character and in all.
MARGIN_EACH, MARGIN = 0.3, 1.5
#: Runs longer than this that no mapping restores as a whole are looked at in blocks, and nothing about them is kept.
LONGEST_RUN = 2000
#: Pairs that the prior of a character's successor counts for.
PRIOR = 25.0
#: Share of the restored characters and pairs that the corpus must have.
KNOWN = 0.6
#: Weight of the prior in the expected count of a pair, as a share of all pairs.
RARE = 1e-5
#: Mutual information below which a pair is improbable, and that for the rest of a value that is known to be garbled.
STRICT, SUSPECT = -1.0, 1.5
#: How much less likely (natural logarithm) cleaner counts must make a run for it to be looked at again.
FELL = 0.25
_LOST = re.compile(r"[�\x80-\x84\x86-\x9f]|[^\W\d_]\?[^\W\d_]")
_GONE = re.compile(r"[�\x80-\x84\x86-\x9f]")
_ODD = re.compile(r"[^\x00-\x7f]|[^\W\d_]\?[^\W\d_]")
_WIDE = re.compile(r"[^\x00-\x7f]+")
NOT_ASCII_JVM = r"[^\x00-\x7f]|\p{L}\?\p{L}"


_MULTIBYTE = ("cp932", "gbk")
_WIDE_CODECS = frozenset(("utf_8", "euc_jp", "big5", "euc_kr", *_MULTIBYTE))


@lru_cache(maxsize=64)
def _table_of(codec: str) -> str:
    """The characters of a single-byte codec; bytes it leaves undefined stand for control characters, as readers take them."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=64)
def _made_by(codec: str) -> frozenset[str]:
    return frozenset(_table_of(codec))


@lru_cache(maxsize=64)
def _encoder(codec: str):
    return codecs.charmap_build(_table_of(codec))


def misread(text: str, read_as: str) -> bytes | None:
    """The bytes of a text that was read with a codec; None if it can't have been."""
    try:
        return text.encode(read_as) if read_as in _MULTIBYTE else codecs.charmap_encode(text, "strict", _encoder(read_as))[0]
    except UnicodeEncodeError:
        return None


def inverse(text: str, read_as: str, written_in: str) -> str | None:
    """The text that was written in one codec and read as another; None if it can't be or doesn't differ."""
    raw = misread(text, read_as)
    if raw is None:
        return None
    try:
        out = raw.decode(written_in)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


def looks_misread(text: str) -> bool:
    """Whether most stretches beyond ASCII are, byte for byte, UTF-8 read as a single-byte codec, or characters were lost."""
    if _LOST.search(text):
        return True
    wide = _WIDE.findall(text)
    if not wide:
        return False
    return any(3 * sum(len(w) > 1 and inverse(w, codec, "utf_8") is not None for w in wide) >= 2 * len(wide) for codec in READ_AS[:7])


def _hash(text: str) -> int:
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) & 0xFFFFFFFF


class PairModel:
    """Hashed counts of adjacent characters with the scores made of them."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        self.pairs, self.singles = pairs, singles
        self.total = float(max(1.0, singles.sum()))
        self.cache: dict[tuple[str, str], tuple[float, float, bool]] = {}
        self.seen: dict[str, bool] = {}
        self.bytes: dict[str, bytes] = {}
        self.words: dict[tuple[str, str, str], dict] = {}

    def score(self, a: str, b: str) -> tuple[float, float, bool]:
        """Mutual information of a pair, shrunk where counts are small, the log probability of b after a, and whether the corpus has the pair."""
        found = self.cache.get((a, b))
        if found is None:
            both = float(self.pairs[_hash(a + b) % PAIRS])
            left, right = float(self.singles[_hash(a) % SINGLES]), float(self.singles[_hash(b) % SINGLES])
            expected = left * right / self.total
            # The text at hand is itself one of those counted, and no evidence for what it holds.
            information = math.log((max(0.0, both - 1.0) + 0.01) / (expected + RARE * self.total + 0.5))
            alone = (right + 0.02) / (self.total + 2000.0)
            likely = math.log((max(0.0, both - 0.5) + PRIOR * alone) / (left + PRIOR))
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[a, b] = found = (information, likely, both > 0)
        return found

    def has(self, ch: str) -> bool:
        """Whether the corpus has a character."""
        found = self.seen.get(ch)
        if found is None:
            self.seen[ch] = found = bool(self.singles[_hash(ch) % SINGLES] > 0)
        return found

    def known(self, text: str, before: str, after: str) -> float:
        """Share of the characters beyond ASCII, and of the pairs with one, that the corpus has; the lesser of the two."""
        own = [c for c in text if c >= "\x80"]
        singles = sum(map(self.has, own)) / len(own) if own else 1.0
        if singles < KNOWN:
            return singles
        whole = before + text + after
        met = [self.score(a, b)[2] for a, b in zip(whole, whole[1:]) if a >= "\x80" or b >= "\x80"]
        return min(singles, sum(met) / max(1, len(met)))

    def kinds(self, codec: str) -> bytes:
        """For each byte of a single-byte codec: 0 ASCII, 1 a character the corpus lacks, 2 one it has, 3 no legible character."""
        found = self.bytes.get(codec)
        if found is None:
            out = bytearray()
            for b in range(256):
                try:
                    ch = bytes([b]).decode(codec)
                except UnicodeDecodeError:
                    out.append(3)
                    continue
                out.append(3 if not _legible(ch) else 0 if ch < "\x80" else 2 if self.has(ch) else 1)
            self.bytes[codec] = found = bytes(out)
        return found

    def refuses(self, raw: bytes, written_in: str) -> bool:
        """Whether some bytes, written in a single-byte codec, hold what isn't legible or too much that the corpus lacks."""
        if written_in in _WIDE_CODECS:
            return False
        kinds = raw.translate(self.kinds(written_in))
        wide, own = len(kinds) - kinds.count(0), kinds.count(2)
        return kinds.count(3) > 0 or own < KNOWN * wide

    def suspect(self, text: str) -> bool:
        """Whether a text has a pair beyond ASCII that is not clearly at home in the corpus."""
        return any(self.score(a, b)[0] < SUSPECT for a, b in zip(text, text[1:]) if a >= "\x80" or b >= "\x80")

    def likelihood(self, text: str, before: str, after: str) -> float:
        """Log probability of a text between two characters."""
        whole = before + text + after
        return sum(self.score(a, b)[1] for a, b in zip(whole, whole[1:]))


def max_segments(scores: Sequence[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (start, stop), by the linear-time method of candidate lists."""
    kept: list[list[float]] = []  # start, stop, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b)) for a, b, _, _ in kept]


def improbable_runs(text: str, model: PairModel, least: float = STRICT) -> list[tuple[int, int]]:
    """Stretches of words that hold a maximum-scoring segment of improbable pairs: those whose mutual information is below ``least``."""
    if not _ODD.search(text):
        return []
    padded = " " + text + " "
    scores = []
    for a, b in zip(padded, padded[1:]):
        plain = a < "\x80" and b < "\x80"
        scores.append(-0.3 if plain else max(-2.0, min(2.0, least - model.score(a, b)[0])))
    runs: list[list[int]] = []
    for start, stop in max_segments(scores):
        a, b = max(0, start - 1), min(len(text), stop)
        # What the run before has looked at isn't looked at again.
        last = runs[-1][1] if runs else 0
        b = max(b, last)
        while a > last and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if a < len(text) and text[a].isspace():
            a += 1
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs if a < b]


def _legible(text: str) -> bool:
    """No control or replacement characters."""
    return not any((c < " " and c not in "\t\n\r") or "\x7f" <= c <= "\x9f" or c == "�" for c in text)


def _gain(part: str, out: str, before: str, after: str, model: PairModel) -> float:
    """How much likelier a restored part is than the part itself, beyond the margin; negative if it isn't to be taken."""
    if not _legible(out) or model.known(out, before, after) < KNOWN:
        return -1.0
    changed = max(1, sum(c >= "\x80" for c in out))
    return model.likelihood(out, before, after) - model.likelihood(part, before, after) - MARGIN_EACH * changed - MARGIN


def _readings(part: str) -> list[tuple[bytes, list[str]]]:
    """The bytes that a part may have been, each with the codecs that read them so; codecs mostly agree."""
    odd = {c for c in part if c >= "\x80"}
    if not odd or odd <= LOOK_ALIKES:
        return []
    found: dict[bytes, list[str]] = {}
    for read_as in READ_AS:
        raw = misread(part, read_as)
        if raw is not None:
            found.setdefault(raw, []).append(read_as)
    return list(found.items())


def _outcomes(part: str, before: str, after: str, model: PairModel) -> dict[tuple[str, str], tuple[float, str]]:
    """The mappings that gain on a part, with what they make of it.

    Each distinct result is judged once, however many mappings lead to it; UTF-8 that was misread more
    than once is unwound.  Words repeat, so what was found for them is kept.
    """
    key = (part, before, after)
    kept = model.words.get(key)
    if kept is not None:
        return kept
    if not model.suspect(before + part + after):
        model.words[key] = {}
        return {}
    gains: dict[str, float] = {}

    def gain_of(out: str) -> float:
        if out not in gains:
            gains[out] = _gain(part, out, before, after, model)
        return gains[out]

    best: dict[tuple[str, str], tuple[float, str]] = {}
    for raw, codecs_ in _readings(part):
        for written_in in WRITTEN_IN:
            if model.refuses(raw, written_in):
                continue
            try:
                out = raw.decode(written_in)
            except UnicodeDecodeError:
                continue
            if out == part:
                continue
            for read_as in codecs_:
                if read_as == written_in:
                    continue
                top = (gain_of(out), out)
                again = inverse(out, read_as, written_in) if written_in == "utf_8" else None
                while again is not None:
                    top = max(top, (gain_of(again), again))
                    again = inverse(again, read_as, written_in)
                if top[0] > 0:
                    best[read_as, written_in] = top
    if len(part) <= LONGEST_RUN:
        if len(model.words) > 200_000:
            model.words.clear()
        model.words[key] = best
    return best


def _parts(run: str, read_as: str) -> list[str]:
    """The words of a run with the blanks between them, or the stretches that the codec can and can't have made."""
    if " " in run:
        return re.split(r"(\s+)", run)
    made, parts, at = _made_by(read_as), [], 0
    while at < len(run):
        stop = at
        while stop < len(run) and (run[stop] in made) == (run[at] in made):
            stop += 1
        parts.append(run[at:stop])
        at = stop
    return parts


def _block_end(run: str, at: int, read_as: str, written_in: str) -> int:
    """Where a block of a long run ends: after its last blank, else where the last sequence of the codec is complete."""
    stop = at + LONGEST_RUN
    if stop >= len(run):
        return len(run)
    blank = run.rfind(" ", at, stop)
    if blank > at:
        return blank + 1
    if misread(run[at:stop], read_as) is None:
        # A character that the codec can't have made ends a sequence anyway.
        at = next(k for k in range(stop, at, -1) if misread(run[k - 1], read_as) is None)
    for end in range(stop, max(at, stop - 8), -1):
        decoder = codecs.getincrementaldecoder(written_in)("replace")
        decoder.decode(misread(run[at:end], read_as) or b"")
        if not decoder.getstate()[0]:
            return end
    return stop


def _blocks(run: str, read_as: str, written_in: str) -> list[str]:
    """A long run in blocks of at most LONGEST_RUN characters that cut no sequence of the codec it may be written in."""
    out, at = [], 0
    while at < len(run):
        end = _block_end(run, at, read_as, written_in)
        out.append(run[at:end])
        at = end
    return out


def _pieces(run: str, read_as: str, written_in: str) -> list[str]:
    """What a mapping is tried on if the run as a whole gives nothing: blocks of a long run, else words or stretches."""
    return _blocks(run, read_as, written_in) if len(run) > LONGEST_RUN else _parts(run, read_as)


def _placed(run: str, parts: list[str], before: str, after: str) -> list[tuple[str, str, str]]:
    """Parts with the characters beside them."""
    out, left = [], 0
    for part in parts:
        right = left + len(part)
        out.append((part, run[left - 1] if left else before, run[right] if right < len(run) else after))
        left = right
    return out


def _options(run: str, before: str, after: str, model: PairModel, only: set[tuple[str, str]] | None = None) -> dict[tuple[str, str], float]:
    """The mappings (of those in ``only``) that gain on a run, as a whole or else on its parts, and how much."""
    if only is not None:
        gains = {}
        for mapping in only:
            whole = _outcomes(run, before, after, model).get(mapping)
            parts = [] if whole else _placed(run, _pieces(run, *mapping), before, after)
            inner = [_outcomes(p, x, y, model).get(mapping, (0.0,))[0] for p, x, y in parts if len(parts) > 1 and not p.isascii()]
            gain = whole[0] if whole else sum(inner)
            # A word that the mapping makes likelier counts here even if it misses the margin.
            if gain > 0 or any(_eased(p, mapping, model) != p for p, _, _ in parts):
                gains[mapping] = gain
        return gains
    found = {mapping: gain for mapping, (gain, _) in _outcomes(run, before, after, model).items()}
    split: dict[tuple[str, ...], dict[tuple[str, str], float]] = {}
    long = len(run) > LONGEST_RUN
    for read_as in READ_AS:
        if not _readable(run, read_as):
            continue
        for written_in in WRITTEN_IN if long else (None,):
            parts = tuple(_pieces(run, read_as, written_in or ""))
            if len(parts) < 2:
                continue
            totals = split.get(parts)
            if totals is None:
                totals = split[parts] = {}
                for part, left, right in _placed(run, list(parts), before, after):
                    if part.isascii():
                        continue
                    inner = _options(part, left, right, model) if long else {m: g for m, (g, _) in _outcomes(part, left, right, model).items()}
                    for mapping, gain in inner.items():
                        totals[mapping] = totals.get(mapping, 0.0) + gain
            for mapping, gain in totals.items():
                if mapping[0] == read_as and mapping[1] == (written_in or mapping[1]):
                    found.setdefault(mapping, gain)
    return found


def _rewritten(run: str, mapping: tuple[str, str], before: str, after: str, model: PairModel) -> str:
    """A run restored by a mapping: as a whole, else part by part; inside a run it also gets what it makes no less likely."""
    whole = _outcomes(run, before, after, model).get(mapping)
    if whole is not None:
        return whole[1]
    parts = _pieces(run, *mapping)
    if len(parts) < 2:
        return _eased(run, mapping, model)
    out = []
    for part, left, right in _placed(run, parts, before, after):
        if part.isascii():
            out.append(part)
        elif len(run) > LONGEST_RUN:
            out.append(_rewritten(part, mapping, left, right, model))
        else:
            known = _outcomes(part, left, right, model).get(mapping)
            out.append(known[1] if known else _eased(part, mapping, model))
    return "".join(out)


def _eased(word: str, mapping: tuple[str, str], model: PairModel) -> str:
    """A word of a run that the chosen mapping of its value makes likelier, though not by the margin; else the word."""
    if not _WIDE.search(word) or {c for c in word if c >= "\x80"} <= LOOK_ALIKES:
        return word
    new = inverse(word, *mapping)
    return new if new and _legible(new) and model.likelihood(new, " ", " ") > model.likelihood(word, " ", " ") else word


def restore(text: str, model: PairModel) -> tuple[str, bool]:
    """The restored text, and whether the text was garbled, restorable or not.

    In each round the mapping with the greatest total gain over all improbable runs is applied to them,
    until none gains.  Then the mappings that were applied are tried on the runs that are improbable by
    the lower standard for a value known to be garbled.  What lies outside the runs is never touched.
    """
    first, seen = text, {text}
    used: set[tuple[str, str]] = set()
    least = STRICT
    while True:
        runs = [(text[a:b], text[a - 1] if a else " ", text[b] if b < len(text) else " ", a, b) for a, b in improbable_runs(text, model, least)]
        totals: dict[tuple[str, str], float] = {}
        for run, before, after, _, _ in runs:
            for mapping, gain in _options(run, before, after, model, used if least == SUSPECT else None).items():
                totals[mapping] = totals.get(mapping, 0.0) + gain
        mapping = max(totals, key=lambda m: (totals[m], m)) if totals else None
        if mapping is None and (least == SUSPECT or not used):
            break
        if mapping is None:
            least = SUSPECT
            continue
        used.add(mapping)
        out, at = [], 0
        for run, before, after, a, b in runs:
            out += [text[at:a], _rewritten(run, mapping, before, after, model)]
            at = b
        text = "".join([*out, text[at:]])
        if text in seen:
            break
        seen.add(text)
    return text, text != first or bool(_GONE.search(first))


def restore_again(text: str, model: PairModel, earlier: PairModel) -> tuple[str, bool]:
    """``restore`` of a text in which an earlier model found nothing, if a run has become less likely since."""
    for a, b in improbable_runs(text, model):
        beside = text[a - 1] if a else " ", text[b] if b < len(text) else " "
        if model.likelihood(text[a:b], *beside) < earlier.likelihood(text[a:b], *beside) - FELL:
            return restore(text, model)
    return text, False


def _readable(run: str, read_as: str) -> bool:
    """Whether a codec can have made some character beyond ASCII of a run."""
    if read_as in _MULTIBYTE:
        return True
    made = _made_by(read_as)
    return any(c >= "\x80" and c in made and c not in LOOK_ALIKES for c in run)


def train(values: DataFrame, text: str) -> PairModel:
    """Counts over all values that don't look misread; the collected tables have at most PAIRS and SINGLES rows."""

    @F.pandas_udf("array<struct<kind:int,slot:int,n:double>>")
    def counts(texts: pd.Series) -> pd.Series:
        # One batch makes one table; it stands in the row of its first text.
        pairs: dict[int, float] = {}
        singles: dict[int, float] = {}
        by_pair: dict[str, float] = {}
        for t in texts:
            if t is None or looks_misread(t):
                continue
            padded = " " + t + " "
            # A text is evidence for a pair once, however often it repeats it.
            for pair in {padded[k : k + 2] for k in range(len(padded) - 1)}:
                by_pair[pair] = by_pair.get(pair, 0.0) + 1.0
        for pair, n in by_pair.items():
            s = _hash(pair) % PAIRS
            pairs[s] = pairs.get(s, 0.0) + n
            s = _hash(pair[0]) % SINGLES
            singles[s] = singles.get(s, 0.0) + n
        table = [dict(kind=0, slot=s, n=n) for s, n in pairs.items()] + [dict(kind=1, slot=s, n=n) for s, n in singles.items()]
        return pd.Series([table if k == 0 else [] for k in range(len(texts))], dtype=object)

    flat = values.select(F.explode(counts(F.col(text))).alias("c")).select("c.*")
    pairs, singles = np.zeros(PAIRS, dtype=np.float32), np.zeros(SINGLES, dtype=np.float32)
    for row in flat.groupBy("kind", "slot").agg(F.sum("n").alias("n")).collect():
        (pairs if row["kind"] == 0 else singles)[row["slot"]] = row["n"]
    return PairModel(pairs, singles)


def restore_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Garbled values: key, field_name, original, restored, changed; one row per garbled value.

    The model is counted over all values of all fields together, each distinct value once; a first
    model restores the values that a second one is counted over, and what the cleaner counts make less
    likely is looked at again.  Rows delivered twice
    count once.  Null, empty and pure ASCII values are never garbled.  Where nothing can be restored
    (bytes were lost) restored equals original and changed is false.
    """
    stacked = df.select(F.col(key).alias("row_key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("original")) for f in fields])).alias("c"))
    cells = stacked.select("row_key", "c.*").where("original <> ''").distinct()
    distinct = cut_lineage(cells.select("original").distinct())
    is_odd = F.col("original").rlike(NOT_ASCII_JVM)
    first = train(distinct, "original")
    mended = cut_lineage(distinct.where(is_odd).select("original", _mender(first)("original").alias("m")).select("original", "m.restored", "m.garbled"))
    second = train(distinct.where(~is_odd).select(F.col("original").alias("restored")).unionByName(mended.select("restored")), "restored")
    late = mended.where("not garbled").select("original", _mender(second, first)("original").alias("m")).where("m.garbled").select("original", "m.restored")
    garbled = mended.where("garbled").select("original", "restored").unionByName(late)
    rows = cells.join(garbled, "original").select("row_key", "field_name", "original", "restored")
    return rows.select(F.col("row_key").alias(key), "field_name", "original", "restored", (F.col("restored") != F.col("original")).alias("changed"))


def _mender(model: PairModel, earlier: PairModel | None = None):
    """The restoring function of a model, which is broadcast: tables of fixed size."""
    shared = SparkSession.active().sparkContext.broadcast([(m.pairs, m.singles) for m in (model, earlier) if m])

    @F.pandas_udf("struct<restored:string,garbled:boolean>")
    def mend(texts: pd.Series) -> pd.DataFrame:
        model, *earlier = _shared_models(shared)
        mended = [restore_again(t, model, *earlier) if earlier else restore(t, model) for t in texts]
        return pd.DataFrame(mended, columns=["restored", "garbled"])

    # Not to be evaluated a second time for a filter on its result.
    return mend.asNondeterministic()


_MODELS: dict[int, list[PairModel]] = {}


def _shared_models(shared) -> list[PairModel]:
    """The models of a broadcast, built once per worker."""
    key = getattr(shared, "_jbroadcast_id", None) or id(shared.value[0][0])
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = [PairModel(*tables) for tables in shared.value]
    return _MODELS[key]
