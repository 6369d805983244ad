"""Missed pairs judged in blocks are those of the pairs joined one by one, and texts of other records are not read for a report."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.operators import misses, near, normalize
from kindred.plans import catalog

FIRST = "element_at(split(name_tokens, ' '), 1)"
COLUMNS = "source string, entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def views(spark):
    draw = random.Random(3)
    word = lambda n: f"w{int(draw.random() ** 2 * n)}"
    address = lambda i: [*(["main"] if i % 4 else []), *(word(300) for _ in range(i % 7)), "tx", str(10000 + i % 40)][: i * 7 % 11]
    rows = [(f"S{i % 3 + 1}", f"S{i % 3 + 1}-{i}", " ".join(word(6) for _ in range(i % 4)), " ".join(address(i)), ["US", "India", ""][i % 8 % 3]) for i in range(900)]
    rows += [("S2", "S2-1", "w1 w2", "w3 tx 10001", "US"), *rows[:6], ("S1", "S1-3", "w1 w0", "w2 w9", "")]  # ids that come up again
    return normalize.normalize_folded(spark.createDataFrame(rows, COLUMNS)).cache()


@pytest.fixture(params=[False, True])
def small(request, monkeypatch):
    """Several blocks, batches and weak targets, or one of each."""
    for name, n in (("ASKED_ROWS", 20), ("HELD_ROWS", 30), ("MOST_KEYS", 150), ("BATCH", 50), ("WEAK", 3)) if request.param else ():
        monkeypatch.setattr(near, name, n)


@pytest.mark.parametrize("cap", [0, 20, 1000])
def test_missed_pairs(views, small, cap):
    joined = misses.near_misses(views, F.expr(FIRST), cap).cache()
    want = Counter(map(tuple, joined.select("source1_entity_id", "true_entity_id", "reason").collect()))
    assert len({r for _, _, r in want}) == 2
    assert Counter(map(tuple, near.missed(views, F.expr(FIRST), cap).collect())) == want
    counts = Counter()
    for r in near.counted(views, F.expr(FIRST), cap).collect():
        counts[r["reason"]] += r["n"]
    named = views.withColumn("word", F.expr(FIRST)).filter("word <> ''").select("source", "country_key", "word")
    every = named.filter("source = 'S1'").join(named.filter("source <> 'S1'"), ["country_key", "word"]).count()
    assert counts == Counter({None: every}) + Counter(r for *_, r in want.elements())
    assert misses.near_examples(views, F.expr(FIRST), cap, 40).count() == 40
    rows = lambda found: list(map(tuple, misses.miss_examples(found, 40).collect()))
    assert rows(misses.near_examples(views, F.expr(FIRST), cap, 40)) == rows(joined)


def test_examples_do_not_compare_all_names(spark, tmp_path, monkeypatch):
    """Names that have too few characters in common with the other are not compared, nor texts of pairs outside the report joined."""
    rows = [(i, f"one {chr(97 + i % 26) * 9} {chr(97 + i % 25) * 9} q{i % 40} five w{i % 7}", "en", "s", 9) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    chosen = misses.near_examples
    monkeypatch.setattr(misses, "near_examples", lambda *a: seen.append(chosen(*a)) or seen[-1])
    assert catalog.QUERIES["miss_examples"](spark, str(tmp_path)).count() == 1000
    assert seen[0].count() == 1000  # of 180 000 pairs


@pytest.mark.parametrize("cap", [0, 20, 1000])
def test_report(views, small, cap, monkeypatch):
    """A report of all has the texts of pairs joined one by one, and a target's once for many queries until it is returned."""
    if near.BATCH == 50:
        for name, n in (("REPORT_PAIRS", 200), ("REPORT_ROWS", 40), ("REPORT_WORDS", 60), ("REPORT_BYTES", 900)):
            monkeypatch.setattr(near, name, n)
    made, met = [], near._met
    monkeypatch.setattr(near, "_met", lambda *a: made.append(met(*a)) or made[-1])
    columns = [c for c in catalog._MISS_COLUMNS if c not in ("exact_name", "indexed_name_tokens")]
    found = Counter(map(tuple, near.report(views, F.expr(FIRST), cap).select(columns).collect()))
    joined = misses.miss_examples(misses.near_misses(views, F.expr(FIRST), cap), 0)
    assert found == Counter(map(tuple, joined.select(columns).collect()))
    assert joined.filter("exact_name OR indexed_name_tokens <> ''").isEmpty()
    sizes = [r["n"] for r in made[0].selectExpr("size(pairs) AS n").collect()]
    assert sum(sizes) == found.total()
    assert len(sizes) * 2 < sum(sizes)  # small blocks have ten queries


def test_report_joins_no_texts(spark, tmp_path, monkeypatch):
    """Texts of pairs are put together where the pairs are judged."""
    rows = [(i, f"one two Three{i % 2} four Äpfel w{i % 3} w{i % 5} x{i} Öl zwölf", "en" if i % 7 else None, "s", 9) for i in range(90)] + [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "one", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    records = catalog.Linkage(spark, str(tmp_path), "documents", catalog.TIGHT_DF)
    want = misses.miss_examples(misses.near_misses(records.views, catalog._first(), catalog.TIGHT_DF), 0).select(*catalog._MISS_COLUMNS)
    monkeypatch.setattr(misses, "near_misses", None)
    found = catalog.QUERIES["miss_report"](spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in want.schema]
    assert not want.isEmpty()
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect()))
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert "true_address" in joins and "Join" in joins and "q_address" not in joins
