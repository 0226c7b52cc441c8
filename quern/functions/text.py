"""Text columns: syllables, folding, snippets, language, fingerprints."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition; Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fold(text: str) -> str:
    """Without diacritics: đ to d, then decomposed and stripped of marks."""
    text = text.replace("đ", "d").replace("Đ", "D")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))


@F.pandas_udf(StringType())
def strip_diacritics(texts: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return texts.map(lambda t: None if t is None else known.get(t) or known.setdefault(t, fold(t)))


def composed(text: Column) -> Column:
    """NFC. Only texts that hold a combining mark go through Python; of all others a null does."""
    return F.coalesce(nfc(F.when(text.rlike(r"\p{M}"), text)), text)


def cleaned(text: Column) -> Column:
    """NFC, lower case, everything but letters, digits and white space a space, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(composed(text), F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def syllables(text: Column) -> Column:
    """array<string>; empty for a null or blank text."""
    flat = cleaned(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-cased, space-collapsed text; null if it is blank."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def normal_query(text: Column, limit: int = 120) -> Column:
    return F.substring(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), 1, limit)


def cache_key(*parts: Column) -> Column:
    """v1 and the parts, trimmed and in lower case, a dash for an empty one."""
    clean = [F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts]
    return F.concat_ws(":", F.lit("v1"), *(F.when(p == "", F.lit("-")).otherwise(p) for p in clean))


def shortened(text: Column, limit: int, mark: str) -> Column:
    """Collapsed white space, cut to limit characters with a mark if it was longer."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(mark))).otherwise(flat)


def language_tag(tag: Column) -> Column:
    """The primary part of a tag: trimmed, lower case, cut at - or _."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(tag, F.lit("")))), r"^([^-_]*)", 1)


def title_ratio(title: Column, query_words: list[str]) -> Column:
    """Share of the query's words that the title has, 1 at most; title words count with multiplicity. A word without accents matches an accented one."""
    if not query_words:
        return F.lit(0.0)
    exact = F.array(*(F.lit(w) for w in query_words))
    loose = F.array(*(F.lit(w) for w in query_words if fold(w) == w)).cast("array<string>")
    words = syllables(title)
    folded = F.split(strip_diacritics(F.array_join(words, " ")), " ")
    pairs = F.arrays_zip(words.alias("w"), folded.alias("f"))
    hits = F.size(F.filter(pairs, lambda p: F.array_contains(exact, p["w"]) | F.array_contains(loose, p["f"])))
    return F.least(F.lit(1.0), hits / F.lit(float(len(set(query_words)))))


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def snippet_of(text: str | None, words: Iterable[str], width: int = 25) -> str:
    """The earliest window of `width` words with the most query words, marked and escaped."""
    exact = {w.lower() for w in words}
    tokens = (text or "").split()
    hit = [re.sub(r"[^\w]", "", t.lower()) in exact for t in tokens]
    best, at, now = -1, 0, sum(hit[:width])
    for k in range(max(1, len(tokens) - width + 1)):
        if now > best:
            best, at = now, k
        now += (hit[k + width] if k + width < len(tokens) else 0) - (hit[k] if k < len(hit) else 0)
    shown = [f"<mark>{escape(t)}</mark>" if h else escape(t) for t, h in zip(tokens[at : at + width], hit[at : at + width], strict=True)]
    return ("... " if at else "") + " ".join(shown) + (" ..." if at + width < len(tokens) else "")


def snippet(words: list[str], width: int = 25):
    """A column function for the few rows that are shown."""

    @F.pandas_udf(StringType())
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t, words, width))

    return shown


# Letters that only Vietnamese has beside U+1EA0 to U+1EF9, languages of scripts, frequent words of Vietnamese and English, thresholds.
VIETNAMESE = "ơưăđƠƯĂĐ"
SCRIPTS = {"Han": "zh", "Hiragana": "ja", "Katakana": "ja", "Hangul": "ko", "Cyrillic": "ru", "Arabic": "ar", "Thai": "th", "Devanagari": "hi", "Hebrew": "he", "Greek": "el"}
#: Scripts that are called by their own name.
OTHER_SCRIPTS = "Armenian Bengali Cherokee Ethiopic Georgian Gujarati Gurmukhi Kannada Khmer Lao Malayalam Mongolian Myanmar Oriya Sinhala Syriac Tamil Telugu Thaana Tibetan Bopomofo".split()
VI_WORDS = tuple("của và là được trong người những các có không cho với để này đã khi một đến về như từ cũng thì sẽ tại theo đó nhiều năm trên ở vào nhưng hơn phải làm việc".split())
EN_WORDS = tuple(
    "the of and to in is that for it with was on are be this have from has not but they which said will would about more been were their its than when who what "
    "into also after over only other these such there his her our you he she we at by".split()
)
FOREIGN_SHARE, MARK_SHARE, VI_SHARE, EN_SHARE, EN_SHARE_HINTED, LEAST_WORDS = 0.10, 0.005, 0.05, 0.12, 0.05, 40


def share_of(words: tuple[str, ...], text: Column, n: Column) -> Column:
    """Share of the n runs of letters that are one of words; one pass, no list of words is built."""
    return F.regexp_count(text, F.lit(r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})")) / n


def detect_language(hint: Column, text: Column, limit: int | None = None) -> Column:
    """vi, en, another script's language, other (long, in Latin letters) or und, of the text or its first `limit` characters.

    Scripts decide, then marks, then frequent words; a text with too few words is what the hint says, if that is vi or en.
    """
    sample = F.coalesce(text, F.lit(""))
    sample = sample if limit is None else F.substring(sample, 1, limit)
    small = F.lower(sample)
    tag = language_tag(hint)
    hinted = F.when(tag.isin("vi", "en"), tag).otherwise("und")
    letters = F.regexp_count(sample, F.lit(r"\p{L}"))
    marks = F.regexp_count(sample, F.lit(rf"[\u1EA0-\u1EF9{VIETNAMESE}]"))
    foreign = F.regexp_count(sample, F.lit(r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]"))
    by_script: dict[str, Column] = {}
    for script, lang in [*SCRIPTS.items(), *((x, x.lower()) for x in OTHER_SCRIPTS)]:
        n = F.regexp_count(sample, F.lit(rf"[\p{{L}}&&\p{{Is{script}}}]"))
        by_script[lang] = by_script[lang] + n if lang in by_script else n
    # counted only where the branch is taken
    most = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, n) in enumerate(by_script.items()))))
    script = F.when(most["n"] > 0, most["lang"]).otherwise("other")
    n = F.regexp_count(small, F.lit(r"\p{L}+"))
    english = share_of(EN_WORDS, small, n)
    return (
        F.when(letters == 0, hinted)
        .when(foreign > FOREIGN_SHARE * letters, script)
        .when(marks >= MARK_SHARE * letters, F.lit("vi"))
        .when(n < LEAST_WORDS, hinted)
        .when(share_of(VI_WORDS, small, n) >= VI_SHARE, F.lit("vi"))
        .when((english >= EN_SHARE) | (tag == "en") & (english >= EN_SHARE_HINTED), F.lit("en"))
        .otherwise("other")
    )


def language_accepted(detected: Column) -> Column:
    """Vietnamese, English and what is too short to tell are kept."""
    return detected.isin("vi", "en", "und")


def looks_vietnamese(text: Column) -> Column:
    """Blank: no. Under 15 characters: yes. Else, whether folding changes it."""
    flat = F.trim(F.coalesce(text, F.lit("")))
    return F.when(flat == "", False).when(F.length(flat) < 15, True).otherwise(strip_diacritics(flat) != flat)
