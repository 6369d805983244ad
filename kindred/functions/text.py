"""Text rules as column expressions: they stay in the JVM. What Spark has no expression for is in ``kindred.functions.udfs``.

Word characters are letters and numbers by Unicode category, not ``\\w``, so that combining marks separate words.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.lexicon import GENERIC_ADDRESS_TOKENS, LEGAL_SUFFIXES, LIGHT_SUFFIXES, MISSING_STRINGS, SEPARATOR, US_STATES

_WORD = r"\p{L}\p{N}"
_NOT_WORD = f"[^{_WORD}]+"
#: Python's white space: what Java's Unicode mode has, and four control characters.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_BEFORE, _AFTER = rf"(?<![{_WORD}_])", rf"(?![{_WORD}_])"


def safe_text(c: Column) -> Column:
    """A string, empty for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """``safe_text`` without white space at the ends."""
    return F.regexp_replace(safe_text(c), rf"^{SPACE}|{SPACE}$", "")


def drop_missing(c: Column) -> Column:
    """Empty where a reader with default missing-value parsing sees a missing value."""
    return F.when(c.isin(MISSING_STRINGS), "").otherwise(safe_text(c))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tokenize(nfkc: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(F.regexp_replace(nfkc, _NOT_WORD, " "), " "), lambda t: t != "")


def tokens_to_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def split_nonempty(c: Column, pattern: str) -> Column:
    """Non-empty parts, such as ``split_tokens`` (a space) and ``split_pipe`` give."""
    return F.filter(F.split(safe_text(c), pattern), lambda t: t != "")


def split_tokens(c: Column) -> Column:
    return split_nonempty(c, " ")


def split_pipe(c: Column) -> Column:
    return split_nonempty(c, r"\|")


def compact(nfkc: Column) -> Column:
    """A normalised text without separators."""
    return F.regexp_replace(nfkc, _NOT_WORD, "")


def sorted_unique(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


@cache
def _suffix_words() -> tuple[tuple[str, ...], ...]:
    """The legal forms as words, longest first."""
    words = [tuple(w for w in re.split(r"[^\w]+|_", s) if w) for s in LEGAL_SUFFIXES]
    return tuple(sorted(dict.fromkeys(words), key=len, reverse=True))


def _alternatives(backwards: bool = False) -> str:
    return "|".join(" ".join(reversed(s) if backwards else s) for s in _suffix_words())


def core_pattern() -> str:
    """Matches all legal forms at the end of a text of words."""
    return f"(?:(?:^| )(?:{_alternatives()}))+$"


def core_text(token_text: Column) -> Column:
    """A text of words without the legal forms at its end; empty if it has nothing else."""
    return F.regexp_replace(token_text, core_pattern(), "")


def legal_suffixes(tokens: Column) -> Column:
    """The legal forms at the end, in the order they stand, joined by bars."""
    turned = F.array_join(F.reverse(tokens), " ")
    found = F.regexp_extract_all(turned, F.lit(rf"\G(?:^| )({_alternatives(backwards=True)})(?= |$)"), F.lit(1))
    return F.array_join(F.reverse(F.transform(found, lambda s: F.array_join(F.reverse(F.split(s, " ")), " "))), "|")


def char_ngrams(value: Column, low: int = 3, high: int = 4) -> Column:
    """Different n-grams of ``^value$``, in order; none for an empty value."""
    framed = F.concat(F.lit("^"), value, F.lit("$"))

    def grams(n: int) -> Column:
        size = F.length(framed)
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(framed, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.when(value != "", F.array_sort(F.array_distinct(F.flatten(F.array(*(grams(n) for n in range(low, high + 1))))))).otherwise(F.array().cast("array<string>"))


def informative(tokens: Column) -> Column:
    """Address words but the generic ones; order and repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(GENERIC_ADDRESS_TOKENS))


def _framed(pattern: str) -> str:
    return f"{_BEFORE}{pattern}{_AFTER}"


def postal_candidates(nfkc: Column, tokens: Column, country_key: Column) -> Column:
    """Numbers of a postal code's form that stand where their country has it; in order. Only the first place of a number is
    looked at, and a nine-digit US code never is a single word, so it is never found."""
    size = F.size(tokens)

    def found(pattern: str, fits) -> Column:
        numbers = F.regexp_extract_all(nfkc, F.lit(_framed(pattern)), F.lit(0))
        return F.filter(numbers, lambda c: (F.array_position(tokens, c) > 0) & fits(F.array_position(tokens, c) - 1))

    us = found(r"\p{Nd}{5}(?:-\p{Nd}{4})?", lambda at: F.coalesce(F.get(tokens, (at - 1).cast("int")).isin(US_STATES), F.lit(False)) | (at >= size - 2))
    india = found(r"[1-9]\p{Nd}{5}", lambda at: at >= size - 3)
    france = found(r"\p{Nd}{5}", lambda at: (at >= 1) & (at >= size - 3))
    other = found(r"\p{Nd}{5,10}", lambda at: at >= size - 2)
    return sorted_unique(F.when(country_key == "us", us).when(country_key == "india", india).when(country_key == "france", france).otherwise(other))


def address_numbers(nfkc: Column, postals: Column) -> Column:
    """House and building numbers, those of postal codes left out; in order."""
    pattern = _framed(r"\p{Nd}+[a-z]?(?:[-/]\p{Nd}+[a-z]?)?")
    return F.array_sort(F.array_except(F.regexp_extract_all(nfkc, F.lit(pattern), F.lit(0)), postals))


def lookup_key(country_key: Column, value: Column) -> Column:
    """Country and value joined; empty if either is."""
    return F.when((country_key != "") & (value != ""), F.concat_ws(SEPARATOR, country_key, value)).otherwise("")


def parse_match_ids(c: Column) -> Column:
    """The ids of a ground-truth list."""
    return split_nonempty(c, r"(?U)[|,;\s\x1c-\x1f]+")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def light_compact(nfkc: Column) -> Column:
    """The lighter key profile's compact form; underscores stay."""
    return F.regexp_replace(nfkc, f"[^{_WORD}_]+", "")


def light_core(nfkc: Column) -> Column:
    """The lighter key profile's core: words joined, without single-word legal forms at the end."""
    text = F.trim(F.regexp_replace(nfkc, f"[^{_WORD}_]+", " "))
    return F.regexp_replace(F.regexp_replace(text, f"(?:(?:^| )(?:{'|'.join(LIGHT_SUFFIXES)}))+$", ""), " ", "")


def md5_bucket(c: Column, buckets: int) -> Column:
    """A bucket by the first 32 bits of the MD5; other engines can compute the same."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(buckets))
