"""Command line of the linkage engine: ``python -m kindred.cli COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import blocking, evaluate, index, misses, normalize, pairs, profile
from kindred.operators.store import IndexStore
from kindred.sources import tsv


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kindred", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-indexes", help="normalise the targets and write all indexes")
    build.add_argument("--source2", required=True)
    build.add_argument("--source3", required=True)
    build.add_argument("--output", required=True)
    build.add_argument("--max-name-token-df", type=int, default=2000)
    build.add_argument("--max-address-token-df", type=int, default=2000)
    build.add_argument("--enable-ngrams", action="store_true")
    for name, what in (("candidates", "candidate pairs"), ("evaluate", "per-query report"), ("diagnose", "per-block report"), ("stats", "volume and recall of the strategies"), ("misses", "why true pairs were missed"), ("pairs", "labelled pairs")):
        one = commands.add_parser(name, help=what)
        one.add_argument("--source1", required=True)
        one.add_argument("--truth", required=True)
        one.add_argument("--index", required=True)
        one.add_argument("--output", required=True)
        one.add_argument("--sample", type=int, default=0, help="first records by id; 0 for all")
        one.add_argument("--na-mode", choices=["literal", "default"], default="literal")
        one.add_argument("--rule", choices=["v1", "v2", "v3"], default="v3" if name == "candidates" else "v1")
        one.add_argument("--max-train", type=int, default=200_000)
        one.add_argument("--max-valid", type=int, default=30_000)
        one.add_argument("--positives", type=int, default=2)
        one.add_argument("--negatives", type=int, default=4)
        one.add_argument("--ngrams", action="store_true", help="use the index of n-grams too")
    show = commands.add_parser("profile", help="profile of source tables and their ground truth")
    show.add_argument("--source", required=True, action="append", help="a file, or name=file; may be given several times")
    show.add_argument("--truth")
    show.add_argument("--output", required=True)
    check = commands.add_parser("check-index", help="open an index and list its tables, their sizes and a row of each")
    check.add_argument("--index", required=True)
    return parser


def _linked(spark: SparkSession, args: argparse.Namespace) -> None:
    store = IndexStore(spark, args.index)
    records = tsv.head(tsv.read_entities(spark, args.source1, na_mode=args.na_mode), args.sample, ["entity_id"])
    views = normalize.normalize(records).withColumnRenamed("entity_id", "source1_entity_id")
    s1 = views.select("source1_entity_id", *normalize.QUERY_COLUMNS)
    truth = tsv.read_truth(spark, args.truth).join(s1.select("source1_entity_id"), "source1_entity_id", "left_semi")
    true = evaluate.true_pairs(truth)
    postings = {b: store.table(f"{b}_index") for b in blocking.BLOCKS if args.ngrams or b != "name_ngram"}
    rule = getattr(blocking, args.rule)()

    def found() -> DataFrame:
        return blocking.evidence(s1, postings).filter(rule)

    if args.command == "pairs":
        split = pairs.split(views, ["source1_entity_id"], args.max_train, args.max_valid)
        made = pairs.training_pairs(split, truth, store.table("entities"), args.positives, args.negatives)
        made.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(args.output)
    elif args.command == "candidates":
        found().select("source1_entity_id", "candidate_entity_id", F.array_join(blocking.methods(), ",").alias("methods")).write.mode("overwrite").parquet(args.output)
    elif args.command == "evaluate":
        tsv.write_report(evaluate.per_s1_report(s1, blocking.candidates(found(), blocking.v1()), true), args.output)
        print(evaluate.summary(tsv.read_report(spark, args.output, evaluate.REPORT)).first().asDict())
    elif args.command == "diagnose":
        tsv.write_report(evaluate.block_diagnostics(found(), true).orderBy("block_order"), args.output, single=True)
    elif args.command == "stats":
        tsv.write_report(evaluate.strategy_stats(blocking.evidence(s1, postings), true, s1).orderBy("strategy"), args.output, single=True)
    else:
        targets = normalize.normalize(store.table("entities").select("entity_id", "business_name", "business_address", "country"))
        missed = misses.missed(misses.pair_evidence(true, views, targets, postings))
        tsv.write_report(misses.miss_examples(missed, 0), args.output)
        print([r.asDict() for r in misses.miss_summary(missed, true.agg(F.count("*").alias("total"))).collect()])


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    if args.command == "build-indexes":
        targets = normalize.entities(tsv.read_entities(spark, args.source2, "S2"), tsv.read_entities(spark, args.source3, "S3"))
        index.build_indexes(targets, args.output, max_name_token_df=args.max_name_token_df, max_address_token_df=args.max_address_token_df, enable_ngrams=args.enable_ngrams)
        for name, size in IndexStore(spark, args.output).sizes().items():
            print(f"{name}\t{size}")
    elif args.command == "check-index":
        with IndexStore(spark, args.index) as store:
            for name, size in store.sizes().items():
                print(f"{name}\t{size}\t{store.table(name).first()}")
    elif args.command == "profile":
        sources = dict(s.split("=", 1) if "=" in s else (s, s) for s in args.source)
        report = {"sources": {name: profile.profile_source(tsv.read_entities(spark, path), tsv.ENTITY_FIELDS) for name, path in sources.items()}}
        if args.truth:
            report["ground_truth"] = profile.profile_truth(tsv.read_truth(spark, args.truth))
        tsv.write_reports(spark, report, args.output)
    else:
        _linked(spark, args)


if __name__ == "__main__":
    main()
