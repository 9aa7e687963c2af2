"""Text expressions: stripping, phrases, n-grams, hashes and norms, all built-in functions.

N-grams come from a zero-width look-ahead, so a text costs time in proportion to its length, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates phrases, and the shortest phrase that is kept.
PHRASE_SPLIT = r"(?U)[,ๆ]?\s{1,}|,"
MIN_PHRASE_CHARS = 6
#: No match begins inside a pair of surrogates.
WHOLE = r"(?![\x{DC00}-\x{DFFF}])"
#: Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at the ends, all of Unicode's; null is empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def split_phrases(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), PHRASE_SPLIT), strip)
    return F.filter(parts, lambda p: F.char_length(p) >= MIN_PHRASE_CHARS)


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), strip(c), F.lit(" "))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """All n-grams of the stripped text between two spaces, in order; a shorter text is one gram."""
    t = padded(c)
    grams = F.regexp_extract_all(t, F.lit(f"(?s){WHOLE}(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.char_length(t) < n, F.array(t)).otherwise(grams)


def ngram_count(c: Column, n: int = 3) -> Column:
    """How many ``char_ngrams`` gives, without making them."""
    return F.greatest(F.char_length(padded(c)) - (n - 1), F.lit(1))


def char_wb_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """The lower-cased n-grams inside words, each word between two spaces. A mark between words keeps grams from crossing."""
    words = F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " \u0000 ")
    marked = F.concat(F.lit(" "), words, F.lit(" "))
    grams = [F.regexp_extract_all(marked, F.lit(f"(?s){WHOLE}(?=([^\\x00]{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)]
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.concat(*grams))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def blank_to_space(c: Column) -> Column:
    return F.when(is_blank(c), F.lit(" ")).otherwise(c)


def l2_normalize(v: Column) -> Column:
    """A unit vector in double precision; a zero vector stays zero."""
    as_double = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(as_double, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def search_text(cause: Column, symptoms: Column) -> Column:
    """Symptom list and disease name as they are stored, stripped at the outer ends only."""
    return strip(F.concat(F.coalesce(cause, F.lit("")), F.lit(" "), F.coalesce(symptoms, F.lit(""))))
