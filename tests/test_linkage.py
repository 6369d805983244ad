"""Invariants of the linkage engine, its files, and its record-level interface."""

import pytest
from pyspark.sql import functions as F

from kindred import cli
from kindred.functions import udfs
from kindred.operators import blocking, evaluate, index, misses, normalize, pairs, profile
from kindred.operators.store import IndexStore
from kindred.sources import tsv
from kindred.streaming import retrieval

RECORDS = [
    ("S1", "S1-1", "Acme Widgets Pvt Ltd", "12 Oak Street Delhi 110001", "India"),
    ("S1", "S1-2", "Blue Moon LLC", "5 Elm Road Austin TX 78701", "US"),
    ("S1", "S1-3", "", "", ""),
    ("S2", "S2-1", "Acme Widgets Private Limited", "12 Oak St Delhi 110001", "India"),
    ("S2", "S2-2", "Blue Moon", "99 Pine Lane Reno NV 89501", "US"),
    ("S3", "S3-1", "Blue Sun LLC", "5 Elm Road Austin TX 78701", "US"),
    ("S3", "S3-2", "Acme Widgets Pvt Ltd", "1 Far Away Mumbai 400001", "India"),
    ("S3", "S3-3", None, None, None),
]
TRUTH = [("S1-1", "S2-1,S3-2"), ("S1-2", "S3-1"), ("S1-3", "")]


@pytest.fixture(scope="module")
def link(spark):
    df = spark.createDataFrame(RECORDS, "source string, entity_id string, business_name string, business_address string, country string")
    s1 = normalize.normalize(df.filter("source = 'S1'"))
    targets = normalize.entities(df.filter("source <> 'S1'")).cache()
    truth = spark.createDataFrame(TRUTH, "source1_entity_id string, matched_entity_ids string")
    return s1, normalize.query_records(s1), targets, index.all_postings(targets, ngrams=True), truth, df


def _pairs(df):
    return {(r[0], r[1]) for r in df.select("source1_entity_id", "candidate_entity_id").collect()}


def test_strategies_nest(spark, link):
    _, s1, _, postings, truth, _ = link
    found = blocking.evidence(s1, postings, blocks=blocking.BLOCKS[:7])
    v1, v2, v3 = (_pairs(found.filter(rule)) for rule in (blocking.v1(), blocking.v2(), blocking.v3()))
    assert v2 <= v3 <= v1
    assert ("S1-1", "S2-1") in v2 and ("S1-1", "S3-2") in v2 and ("S1-2", "S3-1") in v2
    assert not any(a == "S1-3" or b == "S3-3" for a, b in v1)


def test_report_adds_up(link):
    _, s1, _, postings, truth, _ = link
    found = blocking.evidence(s1, postings, blocks=blocking.BLOCKS[:7])
    true = evaluate.true_pairs(truth)
    report = evaluate.per_s1_report(s1, blocking.candidates(found, blocking.v1()), true)
    total = evaluate.summary(report).first()
    assert (total["queries"], total["true_pairs"], total["recovered_pairs"], total["pair_recall"]) == (3, 3, 3, 1.0)
    rows = evaluate.block_diagnostics(found, true).orderBy("block_order").collect()
    assert [r["block"] for r in rows] == blocking.BLOCKS[:7]
    growing = [r["cumulative_candidate_pairs"] for r in rows]
    assert growing == sorted(growing) and growing[-1] == found.count()


def test_cap_suppresses_whole_keys(link):
    targets = link[2]
    one = index.token_postings(targets, "name_tokens", 1)
    assert one.filter("value = 'acme'").count() == 0
    two = index.token_postings(targets, "name_tokens", 2)
    assert two.filter("value = 'acme'").count() == 2


def test_misses(spark, link):
    s1, _, targets, _, _, _ = link
    none = {b: index.token_postings(targets, c, 0) for b, c in index.TOKENS.items()}
    truth = spark.createDataFrame([("S1-2", "S2-2"), ("S1-1", "S3-1"), ("S1-1", "S2-1")], "source1_entity_id string, true_entity_id string")
    found = misses.missed(misses.pair_evidence(truth, s1.withColumnRenamed("entity_id", "source1_entity_id"), targets, none))
    reasons = {(r["source1_entity_id"], r["true_entity_id"]): r["reason"] for r in found.collect()}
    assert ("S1-1", "S2-1") not in reasons  # equal core names
    assert reasons[("S1-1", "S3-1")] == "no_exact_or_indexed_token_evidence"
    assert len(misses.miss_examples(found, 10).columns) == 23


def test_bucketed_index_joins_without_shuffling_it(spark, link):
    _, s1, _, postings, _, _ = link
    saved = index.save_bucketed(postings["exact_name"], "exact_name_bucketed", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = blocking.block_pairs(s1, saved, "exact_name")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(country_key") == 1 and "Bucketed: true" in plan
    assert _pairs(found) == {("S1-1", "S3-2")}


def test_command_line(spark, tmp_path):
    for source in ("S1", "S2", "S3"):
        rows = [r for r in RECORDS if r[0] == source]
        (tmp_path / f"{source}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(x or "" for x in r[1:]) + "\n" for r in rows))
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{a}\t{b}\n" for a, b in TRUTH))
    at = lambda x: str(tmp_path / x)
    cli.main(["build-indexes", "--source2", at("S2.tsv"), "--source3", at("S3.tsv"), "--output", at("idx"), "--enable-ngrams"])
    common = ["--source1", at("S1.tsv"), "--truth", at("truth.tsv"), "--index", at("idx")]
    for what in ("evaluate", "diagnose", "misses", "candidates"):
        cli.main([what, *common, "--output", at(what)])
    assert spark.read.option("sep", "\t").option("header", True).csv(at("evaluate")).count() == 3
    assert spark.read.option("sep", "\t").option("header", True).csv(at("diagnose")).count() == 7
    cli.main(["pairs", *common, "--output", at("pairs")])
    assert spark.read.parquet(at("pairs")).filter("label = 1").count() == 3
    cli.main(["profile", "--source", "S2=" + at("S2.tsv"), "--source", at("S3.tsv"), "--truth", at("truth.tsv"), "--output", at("profile")])
    assert '"singletons": 1' in tsv.read_text(spark, at("profile/profile.json")) and "DATASET PROFILE" in tsv.read_text(spark, at("profile/profile.txt"))
    assert spark.read.option("header", True).csv(at("profile/missingness.csv")).filter("source = 'S2'").count() == 4
    cli.main(["check-index", "--index", at("idx")])
    cli.main(["stats", *common, "--ngrams", "--output", at("stats")])
    assert {r["strategy"] for r in spark.read.option("sep", "\t").option("header", True).csv(at("stats")).collect()} == {"v1", "strong", "name_and_address", "v2", "v3"}
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_store(spark, link, tmp_path):
    s1, _, targets, _, _, _ = link
    index.build_indexes(targets, str(tmp_path / "idx"), enable_ngrams=True)
    with IndexStore(spark, str(tmp_path / "idx")) as store:
        assert store.table_exists("exact_name_index") and not store.table_exists("nothing")
        assert store.exact_name("india", "acme widgets pvt ltd") == {"S3-2"}
        assert store.exact_name("", "acme widgets pvt ltd") == set() == store.exact_name("india", "")
        assert store.postal("india", ["110001", "110001", ""]) == {"S2-1"}
        record = normalize.normalize_record(spark, "Acme Widgets", "12 Oak Street", "India")
        found = store.retrieve_candidates(record, enable_ngrams=True)
        assert "core_name" in found["S2-1"] and "name_ngram" in found["S2-1"]
        assert {r["key"]: r["value"] for r in store.table("metadata").collect()}["source2_rows"] == "2"


def test_pairs(spark, link):
    _, _, targets, _, truth, df = link
    own = normalize.normalize(df.filter("source = 'S1'")).withColumnRenamed("entity_id", "source1_entity_id")
    split = pairs.split(own, ["source1_entity_id"])
    made = pairs.training_pairs(split, truth, targets).collect()
    assert {(r["s1_entity_id"], r["candidate_entity_id"]) for r in made if r["label"] == 1} == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", "S3-1")}
    negatives = {(r["s1_entity_id"], r["candidate_entity_id"]) for r in made if r["label"] == 0}
    assert negatives == {("S1-2", "S2-2")}
    for hashing in ("xxhash64", "pandas"):
        assert pairs.split(own, ["source1_entity_id"], hashing=hashing).count() == 3
    assert pairs.hard_negatives(own, truth, targets, key_profile="light").count() >= 1


def test_profile(spark, link, tmp_path):
    df, truth = link[5], link[4]
    report = profile.profile_source(df, tsv.ENTITY_FIELDS)
    assert report["rows"] == 8 and {m["column"]: m["missing_or_empty"] for m in report["missingness"]}["business_name"] == 2
    assert report["country_distribution"][0]["count"] == 3
    assert profile.profile_truth(truth)["singletons"] == 1
    tsv.write_json_report(spark, report, str(tmp_path / "r.json"))
    tsv.write_text_report(spark, report, str(tmp_path / "r.txt"))
    assert "DATASET PROFILE" in (tmp_path / "r.txt").read_text()
    assert profile.missingness(df.limit(0), ["country"]).first()["missing_pct"] == 0.0


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tNA\t"a ""b"""\tUS\nS2-2\tshort\nS2-3\ta\tb\tc\td\n')
    got = {r["entity_id"]: r for r in tsv.read_entities(spark, str(tmp_path / "a.tsv"), "S2").collect()}
    assert set(got) == {"S2-1", "S2-2"}
    assert got["S2-1"]["business_name"] == "NA" and got["S2-1"]["business_address"] == 'a "b"' and got["S2-2"]["country"] == ""
    assert {r["business_name"] for r in tsv.read_entities(spark, str(tmp_path / "a.tsv"), na_mode="default").collect()} == {"", "short"}
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    assert evaluate.true_pairs(tsv.read_truth(spark, str(tmp_path / "t.tsv"))).count() == 2
    df = spark.range(5).select(F.col("id").cast("string").alias("x"))
    assert [r["x"] for r in tsv.head(df, 2, ["x"]).collect()] == ["0", "1"] and tsv.head(df, 0, ["x"]).count() == 5
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert sorted(r["x"] for r in tsv.head(many, 300, ["x"], few=10).collect()) == list(range(300))
    assert tsv.head(many, 5000, ["x"], few=10).columns == ["x"] and tsv.head(many, 5000, ["x"], few=10).count() == 1000
    tsv.write_report(df, str(tmp_path / "out"))
    tsv.write_pairs(df, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 5


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from kindred import scratch

    unset = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_folder(session)
    session.sparkContext.master = "local[8]"
    assert scratch.shared_folder(session).startswith("file://")
    part = scratch.materialize(spark.range(3), "three")
    assert part.count() == 3
    scratch.drop_materialized(part)


# What the optional libraries add is tested only where they are installed.
def test_transliteration():
    pytest.importorskip("unidecode")
    assert udfs.transliterate_text("société") == "societe"


def test_phonetic_keys():
    pytest.importorskip("metaphone")
    assert udfs.phonetic_text("smith") == udfs.phonetic_text("smyth") != ""


def test_stream(spark, link, tmp_path):
    index.build_indexes(link[2], str(tmp_path / "idx"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nq1\tAcme Widgets\t12 Oak Street Delhi\tIndia\n")
    stream = retrieval.retrieve_stream(retrieval.query_stream(spark, str(tmp_path / "in")), IndexStore(spark, str(tmp_path / "idx")), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream.awaitTermination(120)
    assert _pairs(spark.read.parquet(str(tmp_path / "out"))) >= {("q1", "S2-1")}
