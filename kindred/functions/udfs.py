"""What Spark has no expression for, over Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from unidecode import unidecode
except ImportError:  # optional: without it transliteration leaves texts as they are
    unidecode = None
try:
    from metaphone import doublemetaphone
except ImportError:  # optional: without it phonetic keys are empty
    doublemetaphone = None


def nfkc_casefold_text(x: str | None) -> str:
    """NFKC, case folded, white space collapsed."""
    if not x:
        return ""
    if not x.isascii():
        x = unicodedata.normalize("NFKC", x)
    return " ".join(re.sub(r"\s+", " ", x.casefold()).split(" ")).strip()


def accent_free_text(nfkc: str) -> str:
    """Without combining characters (those of a combining class)."""
    if nfkc.isascii():
        return nfkc
    kept = "".join(c for c in unicodedata.normalize("NFKD", nfkc) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", kept)


def transliterate_text(nfkc: str) -> str:
    if nfkc.isascii() or unidecode is None:
        return nfkc
    return nfkc_casefold_text(unidecode(nfkc))


def phonetic_text(nfkc: str) -> str:
    """Both codes of Double Metaphone, joined by a bar."""
    if doublemetaphone is None or not nfkc:
        return ""
    codes = doublemetaphone(transliterate_text(nfkc))
    return "|".join(c for c in codes if c)


# The UDFs are made where they are used: a worker that imports this module for its plain functions has no session.


def _mapped(f: Callable[[str], str], c: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    return F.pandas_udf(run, "string")(c)


def nfkc_casefold(c: Column | str) -> Column:
    return _mapped(nfkc_casefold_text, c)


def accent_free(c: Column | str) -> Column:
    """Of a text in NFKC."""
    return _mapped(accent_free_text, c)


def transliterate(c: Column | str) -> Column:
    """Of a text in NFKC."""
    return _mapped(transliterate_text, c)


def phonetic_key(c: Column | str) -> Column:
    """Of a text in NFKC."""
    return _mapped(phonetic_text, c)


_VIEWS = "name_nfkc string, name_accent_free string, name_latin_aux string, address_nfkc string, address_latin_aux string, country_key string"


def _views(name: pd.Series, address: pd.Series, country: pd.Series) -> pd.DataFrame:
    n, a = name.map(nfkc_casefold_text, na_action=None), address.map(nfkc_casefold_text, na_action=None)
    key = country.map(lambda x: unicodedata.normalize("NFKC", x).casefold().strip() if x else "", na_action=None)
    return pd.DataFrame({"name_nfkc": n, "name_accent_free": n.map(accent_free_text), "name_latin_aux": n.map(transliterate_text), "address_nfkc": a, "address_latin_aux": a.map(transliterate_text), "country_key": key})


def unicode_views(name: Column | str, address: Column | str, country: Column | str) -> Column:
    """All views that need Unicode tables, in one crossing for a record."""
    return F.pandas_udf(_views, _VIEWS)(name, address, country)


def ratio(x: str | None, y: str | None) -> float:
    """Ratcliff-Obershelp ratio, four decimals; zero if either is empty."""
    if not x or not y:
        return 0.0
    if x == y and len(y) < 200:  # longer ones may have characters that are passed over as too frequent
        return 1.0
    return round(SequenceMatcher(None, x, y).ratio(), 4)


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def sequence_similarity(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio, four decimals; zero if either is empty."""
    return F.pandas_udf(_similarity, "double")(a, b)


def _hash_bucket(s: pd.Series) -> pd.Series:
    return pd.Series(pd.util.hash_pandas_object(s, index=False) % 10).astype("int64")


def pandas_hash_bucket(c: Column | str) -> Column:
    """Bucket of ten by pandas' string hash."""
    return F.pandas_udf(_hash_bucket, "long")(c)
