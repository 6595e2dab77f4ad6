"""Names, phones, dates, addresses and identifiers as column expressions; name comparison as a pandas function."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

#: Words dropped before and after a name.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "madam", "rev", "hon")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq")
#: Spellings of one sound.
SOUND_FOLD = {
    "aa": "a", "ā": "a", "a": "a", "ii": "i", "ī": "i", "i": "i", "uu": "u", "ū": "u", "u": "u", "ee": "e", "ē": "e", "e": "e", "oo": "o", "ō": "o", "o": "o",
    "ai": "ei", "ei": "ei", "au": "ou", "ou": "ou", "sh": "s", "ś": "s", "ṣ": "s", "ṡ": "s", "th": "t", "ṭ": "t", "t": "t", "dh": "d", "ḍ": "d", "d": "d",
    "ph": "f", "f": "f", "bh": "b", "b": "b", "gh": "g", "g": "g", "kh": "k", "k": "k", "ch": "c", "c": "c", "jh": "j", "j": "j", "zh": "l", "ḻ": "l", "l": "l",
    "ṅ": "n", "ñ": "n", "ṇ": "n", "n": "n", "ṃ": "m", "m": "m", "ṛ": "r", "r": "r", "y": "y", "v": "v", "w": "v", "x": "k", "q": "k",
}
#: Latin letters for Tamil and for Devanagari.
TAMIL = {
    "அ": "a", "ஆ": "aa", "இ": "i", "ஈ": "ii", "உ": "u", "ஊ": "uu", "எ": "e", "ஏ": "ee", "ஐ": "ai", "ஒ": "o", "ஓ": "oo", "ஔ": "au", "க": "k", "ங": "ng", "ச": "s", "ஞ": "ny", "ட": "t", "ண": "n",
    "த": "th", "ந": "n", "ப": "p", "ம": "m", "ய": "y", "ர": "r", "ல": "l", "வ": "v", "ழ": "zh", "ள": "l", "ற": "r", "ஃ": "", "்": "", "ா": "a", "ி": "i", "ீ": "ii", "ு": "u", "ூ": "uu",
    "ெ": "e", "ே": "ee", "ை": "ai", "ொ": "o", "ோ": "oo", "ௌ": "au",
}
DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh",
    "ष": "sh", "स": "s", "ह": "h", "ळ": "l", "ा": "a", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ं": "m", "ः": "h", "्": "",
}
#: Words of an address that tell nothing.
ADDRESS_WORDS = ("street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "nagar", "colony", "block", "bhk", "floor")
#: Cities with their regions.
CITIES = {
    "riverport": ("Coastal Province", "USA"), "newham": ("Eastern Province", "USA"), "eastgate": ("Eastern Province", "USA"), "westfield": ("Western Province", "USA"), "lakeview": ("Northern Province", "USA"),
    "fort dale": ("Southern Province", "USA"), "milbrook": ("Central Province", "USA"), "grantville": ("Central Province", "USA"), "cedar falls": ("Northern Province", "USA"),
}
#: The formats a date of birth may have, in order.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy")

_ACCENTED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}


def strip_accents(c: Column) -> Column:
    """Letters without their marks, by the decompositions of U+00C0 to U+024F; combining marks go."""
    return F.regexp_replace(F.translate(c, "".join(_ACCENTED), "".join(_ACCENTED.values())), "[\\u0300-\\u036f]", "")


def normal_name(c: Column) -> Column:
    """Lower case without accents, punctuation, titles before and suffixes behind; "" for null."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", " "), r"\s+", " "))
    front = F.trim(F.regexp_replace(F.concat(flat, F.lit(" ")), f"^(?:(?:{'|'.join(HONORIFICS)}) )+", ""))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), front), f"(?: (?:{'|'.join(SUFFIXES)}))+$", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _rewrite(c: Column, table: dict[str, str], pattern: str) -> Column:
    """Each match of the pattern, left to right, replaced by its entry."""
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), lambda k: F.coalesce(F.try_element_at(lookup, k), k)), "")


def latin(c: Column) -> Column:
    """Tamil and Devanagari letter by letter in Latin ones, lower case."""
    return F.lower(_rewrite(F.coalesce(c, F.lit("")), TAMIL | DEVANAGARI, r"(?s)."))


def sound_fold(c: Column) -> Column:
    """A name in Latin letters with spellings of one sound made equal, longest first; no accents, single spaces."""
    keys = "|".join(sorted(SOUND_FOLD, key=lambda k: (-len(k), k)))
    return F.trim(F.regexp_replace(strip_accents(_rewrite(latin(c), SOUND_FOLD, rf"(?s){keys}|.")), r"\s+", " "))


def initials_key(c: Column) -> Column:
    """First initial and last name; a single word as it is."""
    w = words(normal_name(c))
    return F.when(F.size(w) > 1, F.concat_ws(" ", F.substring(F.get(w, F.lit(0)), 1, 1), F.get(w, F.size(w) - 1))).otherwise(F.coalesce(F.get(w, F.lit(0)), F.lit("")))


def soundex_key(c: Column) -> Column:
    """The Soundex codes of all words, joined."""
    return F.array_join(F.transform(words(normal_name(c)), F.soundex), "")


def vehicle(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def email(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def address_key(c: Column) -> Column:
    """The distinct telling words of an address, sorted."""
    w = F.filter(F.split(F.regexp_replace(F.lower(c), "[,.;:#]", " "), r"\s+"), lambda x: (x != "") & ~x.isin(*ADDRESS_WORDS) & ~x.rlike("^[0-9]+$"))
    return F.array_join(F.sort_array(F.array_distinct(w)), " ")


def address(c: Column) -> Column:
    """A struct of street, city, region, country and a normal form, from "street, city"."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    city = F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    region, country = F.lit("UNKNOWN"), F.lit("UNKNOWN")
    for name, (r, k) in CITIES.items():
        region, country = F.when(F.lower(city) == name, r).otherwise(region), F.when(F.lower(city) == name, k).otherwise(country)
    shown = F.initcap(city)
    return F.struct(F.get(parts, F.lit(0)).alias("street"), shown.alias("city"), region.alias("region"), country.alias("country"), F.when(city.isNull(), "UNKNOWN").otherwise(F.concat_ws(", ", shown, region, country)).alias("normalized"))


def phone_e164(c: Column, country: str = "1") -> Column:
    """A struct of e164, country_code and is_valid: the last ten digits, behind a code of their own if the number begins with "+"."""
    d = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    own = F.trim(F.coalesce(c, F.lit(""))).startswith("+") & (F.length(d) > 10)
    code = F.when(own, F.substring(d, F.lit(1), F.length(d) - 10)).otherwise(country)
    tail = F.when(F.length(d) >= 10, F.substring(d, F.length(d) - 9, F.lit(10))).otherwise(d)
    ok = F.length(tail) == 10
    return F.struct(F.when(ok, F.concat(F.lit("+"), code, tail)).alias("e164"), F.when(ok, code).alias("country_code"), ok.alias("is_valid"))


def date_of(c: Column) -> Column:
    """A date in one of the known formats, as yyyy-MM-dd; null for anything else."""
    return F.coalesce(*(F.date_format(F.try_to_timestamp(F.trim(c), F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS))


def ngram_overlap(a: Column, b: Column) -> Column:
    """Mean of the multiset Jaccard of character pairs and of triples of two names."""

    def grams(c: Column, n: int) -> Column:
        t = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]", "")
        cut = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, cut).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    def jaccard(n: int) -> Column:
        x, y = grams(a, n), grams(b, n)
        both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, k: s + F.least(F.size(F.filter(x, lambda g: g == k)), F.size(F.filter(y, lambda g: g == k))))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))

    return 0.5 * jaccard(2) + 0.5 * jaccard(3)


def ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's similarity."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _soundex(word: str) -> str:
    codes = {c: d for d, group in (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r")) for c in group}
    letters = [c for c in word.lower() if "a" <= c <= "z"]
    if not letters:
        return ""
    out, last = letters[0].upper(), codes.get(letters[0], "")
    for c in letters[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "hw":
            last = code
    return (out + "000")[:4]


def _distance(a: str, b: str) -> float:
    """1 - edit distance over the longer length."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def align(a: list[str], b: list[str], initials: float = 1.0) -> tuple[float, bool, list[tuple[str, str]]]:
    """Best order-keeping pairing of words: score over the longer list, whether an initial met a word, the pairs.

    Words pair by edit similarity, a single letter with any word it begins (score `initials`); gaps score 0.
    """
    n, m = len(a), len(b)
    best: list[list[tuple[float, bool, list]]] = [[(0.0, False, [])] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            x, y = a[i], b[j]
            short = x != y and initials > 0 and 1 in (len(x), len(y))
            worth = 1.0 if x == y else (initials if x[0] == y[0] else 0.0) if short else _distance(x, y)
            after = best[i + 1][j + 1]
            paired = (worth + after[0], (short and worth > 0) or after[1], [(x, y), *after[2]])
            best[i][j] = max(paired, best[i + 1][j], best[i][j + 1], key=lambda t: (t[0], t[1]))
    score, used, pairs = best[0][0]
    return (score / max(n, m) if n and m else 0.0), used, pairs


#: Weights of the parts of a name's similarity, and the least score of a match.
NAME_WEIGHTS = {"levenshtein": 0.30, "fuzzy": 0.10, "token": 0.25, "soundex": 0.20, "ngram": 0.15}
NAME_THRESHOLD = 0.70


def _grams(name: str, n: int) -> dict[str, int]:
    t = "".join(c for c in name if c.isalnum())
    out: dict[str, int] = {}
    for i in range(max(1, len(t) - n + 1) if t else 0):
        out[t[i : i + n]] = out.get(t[i : i + n], 0) + 1
    return out


def compare(a: str, b: str) -> tuple[float, bool, str]:
    """(score, match, reason) of two normal names: a weighted score, and one strong piece of evidence besides."""
    if not a or not b:
        return 0.0, False, "empty"
    if a == b:
        return 1.0, True, "exact"
    x, y = a.split(), b.split()
    if not {w[0] for w in x} & {w[0] for w in y}:
        return 0.0, False, "no_shared_initial"
    if sorted(x) == sorted(y):
        return 1.0, True, "same_words"
    lev = _distance(a, b)
    token, initial, pairs = align(x, y)
    sounds = [1.0 if (_soundex(p) and _soundex(p) == _soundex(q)) or (1 in (len(p), len(q)) and p[0] == q[0]) else 0.0 for p, q in pairs]
    overlap = 0.0
    for n in (2, 3):
        g, h = _grams(a, n), _grams(b, n)
        both = sum(min(c, h.get(k, 0)) for k, c in g.items())
        overlap += 0.5 * both / max(1, sum(g.values()) + sum(h.values()) - both)
    parts = {"levenshtein": lev, "fuzzy": ratio(a, b), "token": token, "soundex": sum(sounds) / max(len(x), len(y)), "ngram": overlap}
    score = min(1.0, sum(NAME_WEIGHTS[k] * v for k, v in parts.items()))
    if score < NAME_THRESHOLD:
        return score, False, "below_threshold"
    if lev >= 0.92:
        return score, True, "levenshtein"
    if initial and lev >= 0.55:
        return score, True, "initials"
    if sounds and min(sounds) >= 0.999 and lev >= 0.75:
        return score, True, "soundex"
    if token >= 0.999 and lev >= 0.50:
        return score, True, "words"
    return score, False, "no_strong_evidence"


@F.pandas_udf(StructType().add("score", DoubleType()).add("matched", BooleanType()).add("reason", StringType()))
def compare_names(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """compare() of two columns of normal names."""
    return pd.DataFrame([compare(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["score", "matched", "reason"])


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two folded names: the better ratio of the names as they are and with their words sorted."""
    by_word = lambda t: " ".join(sorted(t.split()))
    return pd.Series([1.0 if x == y else max(ratio(x, y), ratio(by_word(x), by_word(y))) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])
