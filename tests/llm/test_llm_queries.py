"""Registered training-data queries on the smallest tables, where those are there: against SQL, or worked out in plain Python."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from kindred.llm import packing, queries, tokens

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def encode():
    exact = Tokenizer.from_file(public_tokenizers.path(tokens.VOCAB))
    return lambda t: exact.encode(t, add_special_tokens=False).ids


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@needs_tables
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    want = db.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    clean = lambda f: sorted(tuple("" if v is None or v != v else v for v in r) for r in f.astype(object).itertuples(index=False))
    assert clean(want) == clean(got)


@needs_tables
def test_op1(spark, texts, encode):
    rows = run(spark, "op1_token_counts")
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["n_chars"], r["n_tokens"], r["n_tokens_edited"]) == (len(t), len(encode(t)), len(encode(tokens.edited(t, tokens.default_edits(t)))))


@needs_tables
def test_op2(spark, db, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op2_language_id")}
    langs = dict(db.sql("SELECT doc_id, lang FROM documents").fetchall())
    learned = {g for i, g in langs.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if any(c.isalpha() for c in texts[i]) else r["lang_pred"] == "und"
    assert sum(r["lang_pred"] == langs[i] for i, r in rows.items() if r["held_out"]) >= 0.97 * sum(r["held_out"] for r in rows.values())


@needs_tables
def test_op4(spark, db, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op4_quality_classifier")}
    labels = db.sql("SELECT doc_id, quality = 1 AND toxic = 0 FROM labels").fetchall()
    assert set(rows) == set(texts) and all(r["keep"] == (r["score"] >= 0.5) for r in rows.values())
    right = Counter((clean, rows[i]["keep"] == clean) for i, clean in labels if i in rows)
    assert right[True, True] >= 0.9 * (right[True, True] + right[True, False])


@needs_tables
def test_op5(spark, texts):
    prints = {}
    for i, t in texts.items():
        words = [w for w in re.split(rb"[ \t\n\x0b\f\r]+", t.translate({c: c + 32 for c in range(65, 91)}).encode()) if w]
        runs = [b" ".join(words[j : j + 3]) for j in range(max(len(words) - 2, 1))] if words else []
        h = [xxh64_intdigest(x, 42) for x in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {tuple(r) for r in run(spark, "op5_simhash_near_dedup")} == {(i, f"{prints[i]:016x}", find(i)) for i in texts}


@needs_tables
def test_op6(spark, texts, encode):
    rows, pieces, bins = run(spark, "op6_best_fit_packing"), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, mine in pieces.items():
        ids = np.array([*encode(texts[i]), 2], "<u4")
        mine = sorted(mine, key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in mine] == [(k, *x) for k, x in enumerate(packing.cut(len(ids), 1024))]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    for held in bins.values():
        held.sort()
        ends = np.cumsum([n for _, n in held])
        assert [o for o, _ in held] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= packing.lower_bound(np.array([r["length"] for r in rows]), 1024) + 1


@needs_tables
def test_op8(spark, texts):
    from test_operators import _sketch

    order = sorted(texts, reverse=True)
    want = set()
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        h = len(texts[i]) // 2
        e = texts[i][: len(texts[i]) - h] + texts[j][:h]
        x, y, z = (set(_sketch(t)) for t in (texts[i], e, texts[j]))
        want.add((i, len(texts[i]), *("".join(f"{v & (1 << 64) - 1:016x}" for v in sorted(s)) for s in (x, y)), len(x & y) / min(len(x), len(y)), len(x & z) / min(len(x), len(z))))
    got = {(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in run(spark, "op8_document_fingerprints")}
    assert got == want


@needs_tables
def test_pipeline(spark, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = [r["doc_id"] for r in rows if r["piece"] == 0]
    assert len(set(kept)) == len(kept) and {r["doc_id"] for r in rows} == set(kept) <= set(texts)
