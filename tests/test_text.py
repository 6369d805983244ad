"""Column expressions against the same rules in plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kindred.functions import text, udfs
from kindred.functions.lexicon import GENERIC_ADDRESS_TOKENS, LIGHT_SUFFIXES, US_STATES
from kindred.operators import normalize


def _column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    ("ABC Pvt. Ltd.", "126-B Main Street, Delhi 110001", "India", {"name_core": "abc", "name_legal_suffixes": "pvt ltd", "postal_candidates": "110001", "address_numbers": "126"}),
    ("ABC Private Limited", "126 B Main St, Delhi 110001", "India", {"name_core_compact": "abc", "name_legal_suffixes": "private limited", "address_informative_tokens": "126 b main delhi 110001"}),
    ("Ptit Àmicale", "175 Boulevard du Président Franklin Roosevelt 33000 Bordeaux", "France", {"name_nfkc": "ptit àmicale", "name_accent_free": "ptit amicale", "postal_candidates": "33000", "address_numbers": "175"}),
    ("नागपुर मार्केटिंग", "123 मुख्य मार्ग नागपुर 440001", "India", {"postal_candidates": "440001"}),
    ("Prime Money", "17560 Ellis Road, Tahlequah, OK", "US", {"postal_candidates": "", "address_numbers": "17560"}),
    ("Custom Wealth Services LLC", "OH, Columbus, 5559 Orville Avenue", "US", {"name_core": "custom wealth services", "postal_candidates": ""}),
    ("Private Limited", "", "India", {"name_core": "", "name_core_compact": "", "name_tokens": "private limited"}),
    ("Straße", "Main Road, Austin TX 78701-1234", "US", {"name_nfkc": "strasse", "postal_candidates": ""}),
    ("a_b", "Main Road, Austin TX 78701", "us", {"name_tokens": "a b", "name_compact": "ab", "postal_candidates": "78701"}),
    ("x\x1fy", "１２３ High Street", "", {"name_nfkc": "x y", "address_numbers": "123"}),
    (None, None, None, {"name_nfkc": "", "name_tokens": "", "country_key": "", "postal_candidates": ""}),
    ("q", "560001 then 560001 again and again", "Elsewhere", {"postal_candidates": ""}),
]


@pytest.mark.parametrize(("name", "address", "country", "want"), CASES)
def test_views(spark, name, address, country, want):
    got = normalize.normalize(spark.createDataFrame([(name, address, country)], "business_name string, business_address string, country string")).first().asDict()
    assert {k: got[k] for k in want} == want


def test_folded_equals_unicode_where_it_may(spark):
    rows = [("Groß & Co. KG", "12 Road", " DE "), ("ABC  pvt ltd", "x", "India"), ("", None, None)]
    df = spark.createDataFrame(rows, "business_name string, business_address string, country string")
    a, b = normalize.normalize(df), normalize.normalize_folded(df)
    skip = {"name_accent_free"}
    columns = [c for c in a.columns if c not in skip]
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def _python_core(tokens):
    suffixes, found = text._suffix_words(), []
    while True:
        for s in suffixes:
            if tuple(tokens[-len(s) :]) == s:
                found.insert(0, " ".join(s))
                tokens = tokens[: -len(s)]
                break
        else:
            return " ".join(tokens), "|".join(found)


def test_core_and_suffixes_like_the_loop(spark):
    pick = random.Random(3)
    words = ["abc", "private", "limited", "pvt", "ltd", "co", "liability", "company", "s", "a", "pte", "x"]
    lists = [[pick.choice(words) for _ in range(pick.randint(1, 7))] for _ in range(600)]
    joined = [" ".join(x) for x in lists]
    core = _column(spark, joined, text.core_text)
    suffix = _column(spark, joined, lambda c: text.legal_suffixes(F.split(c, " ")))
    assert list(zip(core, suffix, strict=True)) == [_python_core(x) for x in lists]


def test_ngrams(spark):
    def plain(v):
        f = f"^{v}$"
        return sorted({f[i : i + n] for n in (3, 4) for i in range(len(f) - n + 1)}) if v else []

    values = ["", "a", "ab", "abc", "straße", "aaaa", "नाग"]
    assert _column(spark, values, text.char_ngrams) == [plain(v) for v in values]


def _python_postals(value, country):
    tokens = [t for t in re.split(r"[\W_]+", value) if t]
    pattern = {"us": r"\b\d{5}(?:-\d{4})?\b", "india": r"\b[1-9]\d{5}\b", "france": r"\b\d{5}\b"}.get(country, r"\b\d{5,10}\b")
    out = set()
    for c in re.findall(pattern, value):
        if c in tokens:
            at, n = tokens.index(c), len(tokens)
            if {"us": (at > 0 and tokens[at - 1] in US_STATES) or at >= n - 2, "india": at >= n - 3, "france": at >= 1 and at >= n - 3}.get(country, at >= n - 2):
                out.add(c)
    return "|".join(sorted(out))


def test_postals_and_numbers_like_python(spark):
    pick = random.Random(5)
    words = ["12345", "560001", "75001", "main", "tx", "12-b", "7/9", "126", "ok", "paris", "12345-6789", "0123456"]
    rows = [(" ".join(pick.choice(words) for _ in range(pick.randint(0, 6))), pick.choice(["us", "india", "france", "chile"])) for _ in range(500)]
    df = spark.createDataFrame([("n", a, c) for a, c in rows], "business_name string, business_address string, country string")
    got = normalize.normalize_folded(df).select("business_address", "country", "postal_candidates", "address_numbers").collect()
    for r in got:
        postals = _python_postals(r["business_address"], r["country"])
        numbers = set(re.findall(r"\b\d+[a-z]?(?:[-/]\d+[a-z]?)?\b", r["business_address"])) - set(postals.split("|"))
        assert (r["postal_candidates"], r["address_numbers"]) == (postals, "|".join(sorted(numbers)))


def test_casefold_is_idempotent():
    for c in map(chr, range(1, 0x3000)):
        once = udfs.nfkc_casefold_text(c)
        assert udfs.nfkc_casefold_text(once) == once


def test_accent_free_keeps_marks_of_class_zero():
    assert udfs.accent_free_text("é") == "e"
    assert udfs.accent_free_text("ना") == unicodedata.normalize("NFKC", "ना")


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(udfs.sequence_similarity("a", "b")).collect()] == [0.75, 0.0, 1.0]


def test_small_functions(spark):
    assert _column(spark, ["a|b, c;d  e", "", None], text.parse_match_ids) == [["a", "b", "c", "d", "e"], [], []]
    assert _column(spark, ["acme_x pvt ltd", "ltd"], text.light_core) == ["acme_x", ""]
    assert _column(spark, ["a_b c"], text.light_compact) == ["a_bc"]
    assert _column(spark, ["NA", "none", "None", None], text.drop_missing) == ["", "none", "", ""]
    assert "ltd" in LIGHT_SUFFIXES and "street" in GENERIC_ADDRESS_TOKENS
