"""Business names and addresses in normal form, as column expressions.

Only Unicode decomposition and transliteration leave the JVM, in Arrow batches
and for non-ASCII strings alone.  Null inputs count as empty; outputs are never
null, as '' = '' must hold downstream.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from quillon.functions import rules

INDIC = r"[\x{0900}-\x{0D7F}]"
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{FEFF}]"
TOKEN = r"[^\s,.()\-]+"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


@F.pandas_udf(StringType())
def _decompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def fold(c: Column) -> Column:
    """Lower case without accents; ASCII strings stay in the JVM."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(_decompose(F.when(low.rlike(r"[^\x00-\x7F]"), low)), low)


#: ITRANS-like letters of the common Brahmic layout: the offset in a block of 0x80 code points.
_INDEPENDENT = dict(zip(range(0x05, 0x15), ("a", "aa", "i", "ii", "u", "uu", "r", "l", "e", "e", "e", "ai", "o", "o", "o", "au")))
_SIGNS = dict(zip(range(0x3E, 0x4D), ("aa", "i", "ii", "u", "uu", "r", "r", "e", "e", "e", "ai", "o", "o", "o", "au")))
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split()))


def transliterate(token: str) -> str:
    """Letters of one token by its script's layout, with the inherent vowel; anything but a-z0-9 goes."""
    out, open_vowel = [], False
    for c in token:
        code = ord(c)
        if not 0x0900 <= code <= 0x0D7F:
            out.append(("a" if open_vowel else "") + c.lower())
            open_vowel = False
            continue
        at = (code - 0x0900) % 0x80
        if at in _CONSONANTS:
            out.append(("a" if open_vowel else "") + _CONSONANTS[at])
            open_vowel = True
        elif at in _SIGNS:
            out.append(_SIGNS[at])
            open_vowel = False
        elif at == 0x4D:
            open_vowel = False
        else:
            out.append("a" if open_vowel else "")
            open_vowel = False
            out.append(_INDEPENDENT.get(at, "m" if at in (0x01, 0x02) else "h" if at == 0x03 else str(at - 0x66) if 0x66 <= at <= 0x6F else ""))
    text = "".join(out) + ("a" if open_vowel else "")
    return "".join(x for x in text if x.isascii() and x.isalnum())


@F.pandas_udf(StringType())
def _spell(s: pd.Series) -> pd.Series:
    """Every Indic token of a string by its script's layout."""
    letters = re.compile("[\u0900-\u0d7f]")
    token = re.compile(TOKEN)
    spelled = lambda m: transliterate(m.group()) if letters.search(m.group()) else m.group()
    return s.map(lambda x: token.sub(spelled, x), na_action="ignore")


def _spelled(c: Column) -> Column:
    return F.coalesce(_spell(F.when(c.rlike(INDIC), c)), c)


def translate_name(c: Column, words: Column | None = None) -> Column:
    """Indic tokens by the dictionary (a map column), the rest by the script's layout; other strings stay."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), ZERO_WIDTH, "")
    if words is None:
        return _spelled(plain)
    tokens = F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))
    known = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(INDIC), F.coalesce(F.try_element_at(words, t), t)).otherwise(t)), " ")
    return _spelled(F.when(plain.rlike(INDIC), known).otherwise(plain))


def translate_address(c: Column, segments: Column, words: Column | None = None) -> Column:
    """Indic comma segments by the segment dictionary, the rest token by token."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p))
    known = F.transform(parts, lambda p: F.when(p.rlike(INDIC), F.coalesce(F.try_element_at(segments, p), p)).otherwise(p))
    return translate_name(F.array_join(known, ", "), words)


def _once_in_a_row(tokens: Column) -> Column:
    return _let(tokens, lambda a: F.filter(a, lambda t, i: (i == 0) | (t != F.get(a, i - 1))))


def with_name(df: DataFrame, column: str, words: Column | None = None) -> DataFrame:
    """Adds nm, core, legal, cc (strings) and script, web (0 or 1) for a raw name."""
    raw = F.coalesce(F.col(column), F.lit(""))
    web = r"\bwww\.|\.(?:" + "|".join(rules.WEB_TLDS) + r")\b"
    out = df.withColumn("script", raw.rlike(INDIC).cast("tinyint")).withColumn("__s", fold(translate_name(raw, words)))
    s = F.regexp_replace(F.regexp_replace(F.col("__s"), rules.AFTER_BAR, " "), rules.BRACKETED, " ")
    out = out.withColumn("__s", s).withColumn("web", F.col("__s").rlike(web).cast("tinyint"))
    s = F.regexp_replace(F.regexp_replace(F.col("__s"), web, " "), rules.MESSRS, " ")
    for pattern, glued in rules.LEGAL_PATTERNS:
        s = F.regexp_replace(s, pattern, glued)
    words_ = F.filter(F.split(F.regexp_replace(F.regexp_replace(s, "&", " and "), "[^a-z0-9]+", " "), " "), lambda t: (t != "") & ~t.rlike(rules.LONG_NUMBER))
    letters = F.transform(words_, lambda t: F.when(t.rlike(rules.LEET_WORD) & ~t.rlike(rules.ORDINAL), F.translate(t, *rules.LEET)).otherwise(t))
    out = out.withColumn("__t", _once_in_a_row(letters))
    legal, noise = _map(rules.LEGAL), F.array(*[F.lit(x) for x in rules.NAME_NOISE])
    forms = F.array_sort(F.array_distinct(F.filter(F.transform("__t", lambda t: F.try_element_at(legal, t)), lambda t: t.isNotNull())))
    quiet = F.filter("__t", lambda t: ~F.array_contains(noise, t))
    core = _let(F.filter(quiet, lambda t: F.try_element_at(legal, t).isNull()), lambda a: F.when(F.size(a) > 0, a).when(F.size(quiet) > 0, quiet).otherwise(F.col("__t")))
    out = out.withColumn("__c", core)
    out = out.withColumn("nm", F.array_join("__t", " ")).withColumn("core", F.array_join("__c", " ")).withColumn("legal", F.array_join(forms, " "))
    return out.withColumn("cc", F.array_join("__c", "")).drop("__s", "__t", "__c")


def with_address(df: DataFrame, column: str, segments: Column | None = None, words: Column | None = None) -> DataFrame:
    """Adds ad (words), adf (words and numbers), nums, hn (first number's groups), hmain (its first longest group)."""
    raw = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), ZERO_WIDTH, "")
    s = fold(translate_address(raw, segments, words) if segments is not None else translate_name(raw, words))
    s = F.regexp_replace(s, rules.NUMBER_SIGN, " ")
    for phrase in sorted((k for k in rules.STATES if " " in k), key=len, reverse=True):
        s = F.regexp_replace(s, rf"\b{phrase}\b", rules.STATES[phrase])
    out = df.withColumn("__a", F.regexp_extract_all(s, F.lit(r"[a-z0-9]+(?:[/-][a-z0-9]+)*"), F.lit(0)))
    short, state = _map(rules.ADDR_ABBR), _map({k: v for k, v in rules.STATES.items() if " " not in k})
    drop = F.array(*[F.lit(x) for x in rules.ADDR_DROP])
    word = lambda t: _let(F.coalesce(F.try_element_at(short, t), t), lambda x: F.coalesce(F.try_element_at(state, x), x))
    spelled = F.transform("__a", lambda t: F.when(t.rlike("[0-9]"), t).otherwise(word(t)))
    out = out.withColumn("__a", F.filter(spelled, lambda t: t.rlike("[0-9]") | ~F.array_contains(drop, t)))
    groups = lambda t: F.transform(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), number)
    numbered = F.filter("__a", lambda t: t.rlike("[0-9]"))
    out = out.withColumn("__n", F.transform(numbered, groups))
    first = F.coalesce(F.get("__n", F.lit(0)), F.array().cast("array<string>"))
    longest = F.aggregate(first, F.lit(""), lambda best, d: F.when(F.length(d) > F.length(best), d).otherwise(best))
    out = out.withColumn("ad", F.array_join(F.filter("__a", lambda t: ~t.rlike("[0-9]")), " ")).withColumn("adf", F.array_join("__a", " "))
    out = out.withColumn("nums", F.array_join(F.flatten("__n"), " ")).withColumn("hn", F.array_join(first, "-")).withColumn("hmain", longest)
    return out.drop("__a", "__n")


def number(d: Column) -> Column:
    """A digit run without leading zeros; one of 18 digits or more stays."""
    return F.when(F.length(d) < 18, F.regexp_replace(d, "^0+(?=[0-9])", "")).otherwise(d)


def with_units(df: DataFrame, column: str) -> DataFrame:
    """Adds units (distinct unit numbers, as an array) and hsuf (the house number's suffix letter or '').

    A unit number stands after a unit word, which ``no`` may follow, or is letters and a
    number joined by a dash.  The house number is the first number; its suffix is a letter on it or the next word.
    """
    rows = df.withColumn("__w", F.regexp_extract_all(fold(F.col(column)), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0)))
    heads, suffixes = F.array(*[F.lit(x) for x in rules.UNIT_WORDS]), _map(rules.SUFFIXES)
    before = lambda i: F.when((i > 1) & (F.get("__w", i - 1) == "no"), F.get("__w", i - 2)).when(i > 0, F.get("__w", i - 1)).otherwise("")
    is_unit = lambda t, i: (t.rlike(rules.UNIT_NUMBER) & F.array_contains(heads, before(i))) | t.rlike(rules.DASHED_NUMBER)
    bare = lambda t: F.regexp_replace(F.replace(t, F.lit("-"), F.lit("")), "^([a-z]*)0+([0-9])", "$1$2")
    house = F.array_position(F.transform("__w", lambda t: t.rlike("^[0-9]+[a-z]?$")), F.lit(True))
    after = F.get("__w", house.cast("int"))
    letter = F.when(house > 0, F.regexp_extract(F.get("__w", house.cast("int") - 1), "[a-z]?$", 0))
    word = F.when((house > 0) & after.rlike("^[a-d]$"), after).when(house > 0, F.try_element_at(suffixes, after))
    found = F.coalesce(F.nullif(letter, F.lit("")), word, F.lit(""))
    units = F.array_distinct(F.transform(F.filter("__w", is_unit), bare))
    return rows.withColumn("units", units).withColumn("hsuf", found).drop("__w")
