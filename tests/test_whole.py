"""Registered linkage queries take every word of a record and the caps that indexes have by default."""

from difflib import SequenceMatcher

import pytest

from kindred.plans import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    word = lambda i, j: f"w{i}x{j}"
    texts = [" ".join(["common", *(word(i, j) for j in range(1, 4)), "shared", *(word(i, j) for j in range(5, 12)), "later", word(i, 13)]) for i in range(90)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_caps(spark, folder):
    run = lambda name: catalog.QUERIES[name](spark, folder)
    assert run("candidates_v3").count() == run("candidates_v2").count() == run("block_rare_name_token").count() == 30 * 60
    for name, key in (("name_token", "common"), ("address_token", "shared")):
        assert run(f"index_rare_{name}").filter(f"lookup_key like '%{key}'").count() == 60
        assert run(f"index_rare_{name}_tight").filter(f"lookup_key like '%{key}'").count() == 0
    assert run("index_name_ngram").filter("lookup_key like '%^com'").count() == 60
    assert run("miss_reasons").filter("reason = 'shared_name_and_address_tokens_but_all_suppressed'").count() == 30 * 60


def test_words_after_the_twelfth_are_indexed(spark, folder):
    run = lambda name: catalog.QUERIES[name](spark, folder)
    assert run("index_rare_address_token").filter("lookup_key like '%later' or lookup_key like '%x13'").count() == 120
    assert run("normalize_views").filter("size(split(address_nfkc, ' ')) = 10").count() == 90
    assert run("evidence").filter("address_overlap = 2").count() == 30 * 60


def test_similarities_are_those_of_the_texts(spark, folder):
    rows = catalog.QUERIES["miss_examples"](spark, folder).collect()
    assert len(rows) == 1000  # the report's default
    ratio = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 4)
    for r in rows[::50]:
        assert r["name_similarity"] == ratio(r["source1_business_name"], r["true_business_name"]) and r["address_similarity"] == ratio(r["source1_address"], r["true_address"])
    order = [(r["reason"], -r["name_similarity"], r["source1_entity_id"], r["true_entity_id"]) for r in rows]
    assert order == sorted(order)
