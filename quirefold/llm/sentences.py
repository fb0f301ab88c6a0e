"""Sentence boundaries by cascading tables of break and no-break rules.

A text is cut into segments at line ends (where its lines are those of a scanned page only at blank
lines, for there a line end is a blank), spans inside quotation marks and brackets are closed to cuts,
and every place after a possible terminator is put to ordered rule tables: first those common to all
texts, then that of the language or script, then the general one.  A rule is a pair of regular
expressions for what stands before and after the place; the first rule that matches decides.  Rules
that need letter case have counterparts for texts typed all in capitals or all in small letters.

What the rules know of a language is data: ``LANGUAGES`` names its titles, the abbreviations that stand
before numbers, inside or at the end of a sentence, and so on.  Which language a text is in is seen from
its script and its most frequent words, never from a label; where that can't be told, the data of all
languages of the script are used.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quotation marks and brackets, and what closes them.
CLOSES = {"“": "”", "„": "“”\"", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", '"': '"', "〈": "〉", "《": "》"}
_BRACKETS = "([（【"
_CLOSERS = "”“»\")]」』）】〉》’'"
_STRONG = "!?。！？।॥։።፧፨؟۔‽။།༎។៕꘎᙮"
_MARK = regex.compile(rf"[.{_STRONG}…;\u037e]+")
_CANDIDATE = regex.compile(rf"[.{_STRONG}…;;]+(?:\s?[»]|[{regex.escape(_CLOSERS)}])*")
#: Scripts that set a blank between sentences, not a mark; there every blank is a place too.
_BLANK_ENDS = {"Thai", "Lao"}
_CANDIDATE_OR_BLANK = regex.compile(rf"{_CANDIDATE.pattern}|\s+")

# What the rules know of each language.  title: before a name.  number: before a number.
# inside: never at the end.  last: at the end or inside.  open: words that begin a sentence.
# on: words that go on with one.  says: verbs after a quotation.  quote: particles after one.  of: between a number and its total.  words: frequent words by which it is known.
LANGUAGES = {
    "en": {
        "title": "dr mr mrs ms messrs mx prof capt st rev hon gen lt col maj sgt cpl pvt cmdr adm gov sen rep pres supt insp fr sr",
        "number": "vol vols no nos nr p pp fig figs chap ch sec sect art par pt bk ed eq ser",
        "inside": r"i\.e e\.g approx esp vs cf viz al ibid op\.? ?cit incl resp",
        "last": "etc inc ltd co corp jr bros assn dept univ est",
        "open": "he she it they we i you the this that these those there a an but and or so if when while in on at my his her our their what why who how where no yes not",
        "on": "and well but or then so in nor yet",
        "says": "shouted asked said cried whispered wrote replied called answered says asks muttered yelled",
        "months": "jan feb mar apr jun jul aug sep sept oct nov dec",
        "words": "the and of to is was in that it for with his her not are",
    },
    "de": {
        "title": "dr hr hrn fr prof em dipl ing st frl mag",
        "number": "nr bd bde s abb kap art abs ziff anm jh bl aufl",
        "inside": r"z\. ?b d\. ?h u\. ?a bzw ca vgl sog evtl ggf o\. ?ä i\. ?d\. ?r u\. ?u zzgl inkl mind",
        "last": "usw usf etc dgl",
        "on": "und oder aber denn sondern",
        "says": "ruft fragt sagt schreit antwortet flüstert schreibt rief fragte sagte",
        "months": "januar jänner februar märz april mai juni juli august september oktober november dezember",
        "words": "der die das und ist nicht ein eine mit den von zu für dem sich auf",
    },
    "fr": {
        "title": "m mm mme mmes mlle dr pr me st ste mgr",
        "number": "p pp chap vol fig art n no t éd",
        "inside": r"cf env ex c\.-à-d p\. ?ex",
        "last": "etc",
        "on": "et ou mais donc car ni",
        "says": "crie demande répond dit écrit murmure lance cria demanda répondit",
        "words": "le la les et des est un une que qui dans pour pas du au ce",
    },
    "es": {
        "title": "sr sra srta dr dra d dña prof ing lic",
        "number": "núm pág págs n vol cap art fig t",
        "inside": r"por ej|p\. ?ej|ee\. ?uu|a\. ?c|d\. ?c",
        "last": r"aprox etc u\.p\.c",
        "on": "y o pero ni que",
        "says": "gritó preguntó dijo respondió susurró escribió contestó",
        "words": "el la los las y de que en un una por con no es se del",
    },
    "pt": {
        "title": "sr sra srta dr dra prof profa d eng",
        "number": "n pág págs p pp vol cap art fig t",
        "inside": r"por ex|p\. ?ex",
        "last": "aprox etc ltda",
        "on": "e ou mas nem",
        "says": "perguntou gritou disse respondeu sussurrou escreveu",
        "words": "o a os as e de que em um uma não para com do da se",
    },
    "it": {
        "title": "sig sigg dott dr prof avv ing on",
        "number": "n pag pagg p pp vol cap art fig t",
        "inside": r"p\. ?es cfr",
        "last": "ecc etc",
        "on": "e o ma né",
        "says": "disse chiese gridò rispose sussurrò scrisse",
        "words": "il lo la i gli le e di che un una non per con del è",
    },
    "pl": {
        "title": "dr prof mgr inż hab ks pani p św gen płk ul al pl",
        "number": "nr s str t tom rozdz godz pkt art ust rys r",
        "inside": "tj tzn tzw np m\\.in ok por",
        "last": "itd itp",
        "on": "i lub a ale oraz czy",
        "says": "krzyknął krzyknęła zapytał zapytała powiedział powiedziała szepnął szepnęła odparł",
        "words": "i w na z się nie to jest do że o jak po co za",
    },
    "ru": {
        "title": "д-р г гг г-н г-жа проф акад св им ул гр тов",
        "number": "с стр т гл рис п ст ч № табл",
        "inside": r"т\. ?е|т\. ?к|т\. ?н|и т\. ?д|и т|руб|ч|коп|напр|ср|см",
        "last": r"т\. ?д т\. ?п др пр",
        "on": "и но а или да",
        "says": "крикнул крикнула спросил спросила сказал сказала ответил ответила прошептал",
        "words": "и в не на я что он с как это по но из у за от",
    },
    "el": {
        "title": "κ κα κκ δρ σ καθ αγ",
        "number": "τ σελ αρ κεφ εικ τόμ",
        "inside": r"π\.χ δηλ βλ πρβλ",
        "last": "κλπ κ\\.ά κ\\.λπ",
        "on": "και ή αλλά",
        "says": "φώναξε ρώτησε είπε απάντησε ψιθύρισε",
        "words": "και το η ο να του της με για που στο δεν είναι τα",
    },
    "he": {"title": "ד״ר ד\"ר גב׳ פרופ׳ מר", "number": "עמ׳ מס׳ עמ' מס'", "last": "וכו וכו׳", "inside": "למשל"},
    "hi": {"title": "डॉ श्री श्रीमती प्रो कु", "number": "पृ सं"},
    "bn": {"title": "ডা ড মি মো", "number": "পৃ নং"},
    "ar": {"title": "د أ م", "number": "رقم ص", "inside": "إلخ"},
    "ko": {"title": "dr mr ms prof", "number": "제"},
    "ja": {"title": "dr mr ms", "quote": "と って という とは"},
    "zh": {"title": "dr mr ms", "says": "问道 问 说道 说 喊道 喊 道 答道 答 叫道"},
    "th": {"title": "ดร นาย น\\.ส ศ", "number": "ข้อ", "of": "เต็ม จาก"},
}
_OF_SCRIPT = {"Cased": ("en", "de", "fr", "es", "pt", "it", "pl", "ru", "el"), "Hebrew": ("he",), "Indic": ("hi", "bn"), "Arabic": ("ar",), "Hangul": ("ko",), "Han": ("ja", "zh"), "Thai": ("th",)}


@dataclass(frozen=True)
class Rule:
    """Whether to cut where ``before`` ends at a place and ``after`` starts there, in texts of the given case.

    ``{title}`` and the like stand for the words of the language; a rule that names words of which the
    language has none is left out.
    """

    cut: bool
    before: str = ""
    after: str = ""
    case: str = "normal caps small"
    start: bool = False  # ``before`` must cover the sentence so far
    inside: bool = False  # the place must lie inside an address, however long


_WORD_START = r"(?<![\p{L}\p{N}])"
_COMMON = [
    Rule(False, r"\s*\d{1,3}[.]", r"\s", start=True),  # a list mark opens its sentence
    Rule(False, r"\s*\p{L}[.]", r"\s", start=True),
    Rule(False, "", r"\s*[,،、，;:]"),
    Rule(True, "", r"\s+[—–]\p{Lu}"),  # a dash may open a speech
    Rule(False, "", r"\s*[—–-]\s"),
    Rule(False, r"\p{N}[.]", r"\p{N}"),
    Rule(False, r"[.]", r"[ºª]"),
    Rule(False, inside=True),
    Rule(True, r"\p{Ll}{2}[.]", r"\p{Lu}\p{Ll}|\p{Lu}[.]\s?\p{Lu}|[“\"«(]\p{Lu}", case="normal"),  # the blank is missing
    Rule(True, r"(?<!\p{L}[.])\p{L}{3}[.]", r"\p{L}{2}|\p{L}[.]\s?\p{L}", case="caps small"),
    Rule(True, r"[!?…]+[”»\")]*", r"\p{Lu}|\p{Lo}|[“\"«(„]", case="normal caps"),
    Rule(True, r"[!?]+[”»\")]*", r"\p{L}|[“\"«(„]", case="small"),
    Rule(True, r"\p{Ll}{3}[.][”»\")]*", r"[“\"«(„](?=\p{L})", case="small"),
    Rule(True, r"\p{Lu}{3}[.][”»\")]*", r"[“\"«(„](?=\p{L})", case="caps"),
    Rule(False, r"(?<!\b[ap]\.m)[.…]", r"[^\s\p{Lo}“\"«„(]"),
    Rule(False, r"[.]", r"[\"“«(]"),
]

_CASED = [
    Rule(False, r"\s*[\"“(]?(?:\w+\s+){1,2}[ap]\.m\.", "", start=True),  # too little for a sentence
    Rule(False, r"\b[ap]\.m\.", r"\s+\p{Ll}", case="normal"),
    Rule(True, r"\b[ap]\.m\.", r"\s|\p{Lu}"),
    Rule(False, rf"{_WORD_START}(?:{{title}})\.", r"\s+\p{L}"),
    Rule(False, rf"{_WORD_START}(?:{{number}})\.[ºª]?", r"\s*\p{N}"),
    Rule(False, r"\b\d{1,2}\.", r"\s+(?:{months})\b"),
    Rule(False, rf"{_WORD_START}(?:{{months}})\.", r"\s+\p{N}"),
    Rule(False, rf"{_WORD_START}(?:{{last}})\.", r"\s+\(?[\p{Ll}\p{N}]", case="normal"),
    Rule(False, rf"{_WORD_START}(?:{{last}})\.", r"\s+(?:{on})(?!\p{L})", case="caps small"),
    Rule(False, rf"{_WORD_START}(?:{{inside}})\.", ""),
    Rule(True, rf"{_WORD_START}(?:{{last}})\.", ""),
    Rule(True, r"(?<!\p{L})\p{L}\.(?:\p{L}\.)+", r"\s+(?=\p{Lu})(?i:{open})(?![\p{L}.])", case="normal"),  # a country, not initials
    Rule(False, r"(?<!\p{L})\p{L}\.", r"\s+[\p{L}\p{N}]"),  # initials
    Rule(False, r"(?:\.{2,}|…)[”»\")]*", r"\s+\p{Ll}", case="normal"),
    Rule(False, r"(?:\.{2,}|…)[”»\")]*", r"\s+(?:{on})(?!\p{L})", case="caps small"),
    Rule(False, r"[!?]\s?[”“»\"]", r"\s+(?:[^\s.!?]+\s+){0,6}(?:{says})(?!\p{L})", case="caps small"),
    Rule(False, "", r"\s+\p{Ll}", case="normal"),
    Rule(True),
]

_ARMENIAN = [Rule(False, r"[.]", r"\s*«"), Rule(True, r"[։!?][^\s։!?]*", ""), Rule(False)]
_ETHIOPIC = [Rule(True)]
_INDIC = [
    Rule(False, r"[!?]\s?[”“»\"]", r"\s+\S"),  # a quotation stays with the words that attribute it
    Rule(True, r"[।॥!?][^\s।॥!?]*", ""),
    Rule(False, rf"{_WORD_START}(?:{{title}})\.", r"\s+\p{L}"),
    Rule(False, rf"{_WORD_START}(?:{{number}})\.", r"\s*\p{N}"),
    Rule(True),
]
_ARABIC = [
    Rule(False, r"[!?؟.][”“»\"]", r"\s+(?![“«\"])\S"),
    Rule(False, r"(?<!\p{L})(?:{title}|{inside})\.", r"\s+\p{L}"),
    Rule(False, r"(?<!\p{L})(?:{number})\.", r"\s*\p{N}"),
    Rule(True),
]
_HEBREW = [
    Rule(False, rf"{_WORD_START}(?:{{title}})\.?", r"\s+\p{L}"),
    Rule(False, rf"{_WORD_START}(?:{{number}})\.?", r"\s*\p{N}"),
    Rule(False, rf"{_WORD_START}(?:{{inside}})\.", r"\s+\p{L}"),
    Rule(True),
]
_HAN = [
    Rule(False, r"\p{N}[.]", r"\p{N}"),
    Rule(False, r"[.]", r"[^\s\p{Lo}“\"«„(「（]"),
    Rule(False, r"[」』]", r"(?:{quote})"),
    Rule(False, r"[？！?!][”」』\"]", r"[^。！？，]{0,12}?(?:{says})(?=[。！，：])"),
    Rule(False, r"…+", r"\S"),
    Rule(True),
]
_HANGUL = [
    Rule(False, r"[.!?][”’\"]", r"\S"),
    # After a quotation that asks or calls, who says it: a word or two with a verb in the past.
    Rule(False, r"[!?][”\"]", r"\s+(?:\S+\s+){1,2}\p{Hangul}*[았었했였렀갔졌]다(?!\p{L})"),
    Rule(False, rf"{_WORD_START}(?:{{title}})\.", r"\s+\p{L}"),
    Rule(True),
]
_BLANKS = [
    Rule(True, r"[!?]", r"\s+\S"),
    Rule(False, rf"{_WORD_START}(?:{{title}})\.?", r"\s+\p{L}"),
    Rule(False, rf"{_WORD_START}(?:{{number}})\.?", r"\s*\p{N}"),
    Rule(True, r"[\p{Thai}\p{Lao}”\"»]", r"\s+\p{L}"),
    Rule(True, r"\p{N}\s+(?:{of})\s+\p{N}+(?:[.]\p{N}+)?", r"\s+\p{L}"),  # so many out of so many
    Rule(False),
]
_MARKED = [Rule(True)]
# The table of a segment's script follows the common one.
_TABLES = {"Armenian": _ARMENIAN, "Ethiopic": _ETHIOPIC, "Indic": _INDIC, "Arabic": _ARABIC, "Hebrew": _HEBREW, "Han": _HAN, "Hangul": _HANGUL, "Cased": _CASED, "Thai": _BLANKS, "Lao": _BLANKS, "Myanmar": _MARKED, "Khmer": _MARKED, "Tibetan": _MARKED}
_NOT_COMMON = {"Han", "Ethiopic", "Thai", "Lao", "Myanmar", "Khmer", "Tibetan"}
_SCRIPTS = [
    ("Thai", r"\p{Thai}"),
    ("Lao", r"\p{Lao}"),
    ("Myanmar", r"\p{Myanmar}"),
    ("Khmer", r"\p{Khmer}"),
    ("Tibetan", r"\p{Tibetan}"),
    ("Hangul", r"\p{Hangul}"),
    ("Armenian", r"\p{Armenian}"),
    ("Ethiopic", r"\p{Ethiopic}"),
    ("Indic", r"[\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}]"),
    ("Arabic", r"\p{Arabic}"),
    ("Hebrew", r"\p{Hebrew}"),
    ("Han", r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
    ("Cased", r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Georgian}]"),
]


@lru_cache(maxsize=64)
def _words(script: str, language: str) -> dict[str, str]:
    """The words of a language by kind, or of all languages of a script, as alternatives, the longest first."""
    found: dict[str, set[str]] = {}
    for name in (language,) if language else _OF_SCRIPT.get(script, ()):
        for kind, words in LANGUAGES[name].items():
            found.setdefault(kind, set()).update(words.split("|") if "|" in words else regex.split(r" (?!\?)", words))
    return {kind: "|".join(sorted(words, key=lambda w: (-len(w), w))) for kind, words in found.items()}


def language_of(text: str, script: str) -> str:
    """The language of a script whose frequent words a text has most of; empty if two are close or there is none."""
    names = _OF_SCRIPT.get(script, ())
    if script != "Cased":
        return names[0] if len(names) == 1 else ""
    counts = dict.fromkeys(names, 0)
    for word in _WORDS.findall(text.lower()):
        for name in _FREQUENT.get(word, ()):
            counts[name] += 1
    first, second = sorted(counts.values(), reverse=True)[:2]
    return max(counts, key=counts.get) if first >= 3 and first >= 2 * second else ""


_WORDS = regex.compile(r"\p{L}+")
_FREQUENT: dict[str, list[str]] = {}
for _name in _OF_SCRIPT["Cased"]:
    for _w in LANGUAGES[_name]["words"].split():
        _FREQUENT.setdefault(_w, []).append(_name)


@lru_cache(maxsize=64)
def _kept_words(language: str) -> frozenset[str]:
    """Words of four letters and more that a full stop behind need not end the sentence after."""
    found = _words("Cased", language)
    return frozenset(w.replace("\\", "") for kind in ("title", "inside", "number", "last", "months") for w in found.get(kind, "").split("|"))


@lru_cache(maxsize=256)
def _compiled(script: str, case: str, language: str):
    """The cascade for a script, letter case and language: (cut, pattern, kind) in order.

    Neighbouring rules that decide alike are one pattern, matched at the place: what stands before is
    looked back at from there.
    """
    words = _words(script, language)
    plain: list[tuple[bool, str, str]] = []
    for rule in [*(_COMMON if script not in _NOT_COMMON else []), *_TABLES[script]]:
        if case not in rule.case.split():
            continue
        named = set(regex.findall(r"\{([a-z]+)\}", rule.before + rule.after))
        if named - set(words):
            continue
        before, after = (regex.sub(r"\{([a-z]+)\}", lambda m: words[m.group(1)], side) for side in (rule.before, rule.after))
        # Word lists are spelt small but may stand in any case; only rules about case itself mind it.
        minds = {side: case == "normal" and bool(regex.search(r"\\p\{L[ul]", side)) for side in (before, after)}
        flagged = {side: f"(?{'-' if minds[side] else ''}i:{side})" for side in (before, after)}
        if rule.start:
            plain.append((rule.cut, flagged[before] + (f"(?={flagged[after]})" if after else ""), "start"))
        else:
            plain.append((rule.cut, (f"(?<={flagged[before]})" if before else "") + (f"(?={flagged[after]})" if after else ""), "inside" if rule.inside else "at"))
    out = []
    for (cut, kind), group in groupby(plain, key=lambda r: (r[0], r[2])):
        pattern = "|".join(f"(?:{body})" for _, body, _ in group)
        out.append((cut, regex.compile(pattern) if kind != "inside" else None, kind))
    return out


_SCRIPT_COUNTS = [(name, regex.compile(pattern)) for name, pattern in _SCRIPTS]
_GREEK_END = regex.compile(r"\p{Greek}[»”]?$")
_NEXT_CAPITAL = regex.compile(r"(?<=[.!?])\s+\p{Lu}")
_FULL_WORD = regex.compile(r"(?<=\s)\p{L}{4,}", regex.REVERSE)
_SOLID = regex.compile(r"\S|$")
#: A speaker or another label that opens a sentence.
_LABEL = regex.compile(r"^\s*[^.:!?。！？]{1,40}[:：]\s*$")
_ENDS = regex.compile(rf"(?:[.{_STRONG}…;:])[{regex.escape(_CLOSERS)}\s]*$")


@lru_cache(maxsize=1 << 17)
def _letter(ch: str) -> tuple[int, bool, bool]:
    """Number of a character's script or -1, and whether it is a capital or a small letter."""
    return next((k for k, (_, pattern) in enumerate(_SCRIPT_COUNTS) if pattern.match(ch)), -1), ch.isupper(), ch.islower()


def look_of(text: str) -> tuple[str, str]:
    """The script most letters of a text have, and its case: normal, caps (hardly a small letter), small (no capital), or empty."""
    cased = len(_SCRIPTS) - 1
    if text.isascii():
        return _SCRIPTS[cased][0], _case(len(text) - len(text.translate(_NO_CAPITALS)), len(text) - len(text.translate(_NO_SMALL)))
    counts, upper, lower = [0] * len(_SCRIPTS), 0, 0
    for ch, n in Counter(text).items():
        script, is_upper, is_lower = _letter(ch)
        if script >= 0:
            counts[script] += n
        upper += n * is_upper
        lower += n * is_lower
    most = max(counts)
    best = counts.index(most) if most else cased
    if best == cased:
        # Names in Latin letters don't make a text of another script a Latin one.
        others = max(counts[:-1])
        best = counts.index(others) if others and others * 3 >= most else cased
    return _SCRIPTS[best][0], _case(upper, lower)


def _case(upper: int, lower: int) -> str:
    return "" if upper + lower < 12 else "caps" if upper >= 9 * lower else "small" if upper == 0 else "normal"


_NO_CAPITALS, _NO_SMALL = (dict.fromkeys(range(ord(a), ord(a) + 26)) for a in "Aa")


def is_wrapped(text: str) -> bool:
    """Whether single line ends are those of a page: some line goes on in the middle of a sentence."""
    if "\n" not in text and "\r" not in text:
        return False
    case, lines = look_of(text)[1], [x.strip() for x in text.splitlines()]
    for a, b in zip(lines, lines[1:]):
        if a and b and not _ENDS.search(a) and not a.startswith("=="):
            if b[0].islower() if case == "normal" else b[0].isalpha() and len(a) > 24:
                return True
    return False


_MARKS = regex.compile("[" + regex.escape("".join({*CLOSES, *"".join(CLOSES.values())})) + "]")


# What each closing mark can close.
_OPENS = {ch: [o for o, closes in CLOSES.items() if ch in closes] for ch in "".join(CLOSES.values())}
_WEB, _MAIL = regex.compile(r"(?:https?://|www\.)(?P<rest>\S*)", regex.IGNORECASE), regex.compile(r"@\S(?P<rest>\S*)")


def _addresses(text: str) -> list[tuple[list[int], list[int]]]:
    """First and last place inside each web address, and each mail address from its @ on."""
    found = [list(pattern.finditer(text)) for pattern in (_WEB, _MAIL)]
    return [([m.start("rest") for m in f], [m.end() - 1 for m in f]) for f in found]


def _closed(text: str) -> tuple[list[int], list[int], dict[int, int]]:
    """Places where the nesting depth changes and the depth from there on, and the opening place of each closing mark.

    Unpaired marks count as none.
    """
    stack: list[tuple[str, int]] = []
    heights: dict[str, list[int]] = {ch: [] for ch in CLOSES}  # where in the stack the open marks of a kind are
    pairs: dict[int, int] = {}

    def pair(i: int, height: int) -> None:
        pairs[i] = stack[height][1]
        while len(stack) > height:
            heights[stack.pop()[0]].pop()

    for m in _MARKS.finditer(text):
        ch, i = m.group(), m.start()
        if stack and ch in CLOSES[stack[-1][0]]:
            pair(i, len(stack) - 1)
            continue
        deeper = max((heights[o][-1] for o in _OPENS.get(ch, "") if heights[o]), default=None) if ch in _CLOSERS else None
        if deeper is not None and ch != '"':
            pair(i, deeper)
        elif ch in CLOSES and not (ch == '"' and i and text[i - 1].isalnum()):
            heights[ch].append(len(stack))
            stack.append((ch, i))
    places, depths, level = [], [], 0
    for i, step in sorted([(o, 1) for o in pairs.values()] + [(c, -1) for c in pairs]):
        level += step
        places.append(i)
        depths.append(level)
    return places, depths, pairs


def _cuts(text: str, script: str, case: str, language: str) -> Iterator[int]:
    """Places inside a segment where a sentence ends."""
    places, depths, pairs = _closed(text)

    def depth(i: int) -> int:
        k = bisect_right(places, i) - 1
        return depths[k] if k >= 0 else 0

    rules = _compiled(script, case, language)
    # A full word that is no abbreviation, a mark, a blank and a capital: of all rules only the last one can match.
    kept = _kept_words(language) if script == "Cased" and case == "normal" else None
    addresses = _addresses(text)

    def in_address(i: int) -> bool:
        return any((k := bisect_right(firsts, i) - 1) >= 0 and i <= lasts[k] for firsts, lasts in addresses)

    start, last = 0, len(text.rstrip()) - 1
    candidates = _CANDIDATE_OR_BLANK if script in _BLANK_ENDS else _CANDIDATE
    for m in candidates.finditer(text):
        mark = _MARK.match(text, m.start())
        if mark is None:
            end = m.start()  # a blank
        else:
            end = m.end()
            while end > m.start() and text[end - 1] in "’'" and not (end < len(text) and text[end : end + 1].isspace()):
                end -= 1
            # Closers that open something (a straight mark, a German one) belong to what follows.
            while end > mark.end() and (end - 1) not in pairs and text[end - 1] in "”“»\")]」』）】〉》":
                end -= 1
        if end <= start or end >= len(text) or depth(end - 1) > 0:
            continue
        if mark is not None:
            if set(mark.group()) <= {";", ";"} and not _GREEK_END.search(text, max(0, m.start() - 2), m.start()):
                continue
            closer = end - 1
            if closer in pairs and text[pairs[closer]] in _BRACKETS and pairs[closer] < m.start() and mark.group()[0] in ".!?。！？":
                first = _SOLID.search(text, start).start()
                if first < pairs[closer] and not _LABEL.match(text, first, pairs[closer]):
                    continue  # a bracket inside a sentence
        if end > last:
            return
        if kept is not None and mark is not None and end == mark.end() and _NEXT_CAPITAL.match(text, end):
            word = _FULL_WORD.match(text, start, m.start())
            if word is not None and word.group().lower() not in kept:
                yield end
                start = end
                continue
        for cut, pattern, kind in rules:
            if kind == "inside":
                if not in_address(end):
                    continue
            elif kind == "start":
                found = pattern.match(text, start)
                if found is None or found.end() != end:
                    continue
            elif pattern.match(text, end) is None:
                continue
            if cut:
                yield end
                start = end
            break


_BLANK_LINE, _LINE_END = regex.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*"), regex.compile(r"[\r\n\u2028\u2029]+")


def sentence_ends(text: str | None) -> list[int]:
    """Code points up to and including the last character, not white space, of each sentence; none for null and blank texts."""
    if text is None or not text.strip():
        return []
    wrapped = is_wrapped(text)
    border = _BLANK_LINE if wrapped else _LINE_END
    document_case, languages = look_of(text)[1] or "normal", {}
    ends: list[int] = []
    at = 0
    for m in [*border.finditer(text), None]:
        stop = m.start() if m else len(text)
        segment = text[at:stop]
        if segment.strip():
            script, case = look_of(segment)
            case = case or document_case
            if script not in languages:
                languages[script] = language_of(text, script)
            for place in [*_cuts(segment, script, case, languages[script]), len(segment)]:
                end = at + len(segment[:place].rstrip())
                if end > at and (not ends or end > ends[-1]) and text[at:end].strip():
                    ends.append(end)
        at = m.end() if m else len(text)
    return ends


def sentence_ends_column(text: Column) -> Column:
    """The ends of each text's sentences as an array."""

    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        return pd.Series([sentence_ends(t) for t in texts], dtype=object)

    # Not to be evaluated a second time for a filter on the array's size.
    return ends.asNondeterministic()(text)


def split_sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence: doc_id, sentence (from 1), start_pos, end_pos, sentence_text.

    Null, empty and blank texts give no rows.  Positions count code points from 1; end_pos is that of
    the last character that is not white space.  A row that stands twice gives its sentences twice: ids
    are unique, and no text is shuffled to make sure.  Other columns are ignored, whatever their names.
    """
    marked = documents.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("ends", sentence_ends_column(F.col("text")))
    rows = marked.select("doc_id", "text", F.posexplode("ends").alias("k", "end_pos"), F.col("ends"))
    begun = rows.withColumn("prior", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.element_at("ends", F.col("k"))))
    piece = F.col("text").substr(F.col("prior") + 1, F.col("end_pos") - F.col("prior"))
    clean = F.regexp_replace(piece, r"^[\s\p{Z}]+", "")
    return begun.select("doc_id", (F.col("k") + 1).alias("sentence"), (F.col("end_pos") - F.length(clean) + 1).alias("start_pos"), "end_pos", clean.alias("sentence_text"))
