"""The ten operators on small tables: against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and
other columns."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import components, decontam, langid, lines, packing, quality, queries, simhash, sketch, suffix, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rk long, place string"
WORDS = "the of and to in is was for on are with as by at from or an be this that which red blue green".split()


def _docs(spark, texts, langs=None, ids=None):
    """Documents with some columns more, named like the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "k", 7, "p") for i, t, g in zip(ids, texts, langs, strict=True)], SCHEMA)


def _text(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


LONG = _text(1, 30_000)
ODD = [None, "", " ", "\n\n", "a", "a", "Ünïcode — ß 漢字 😀", _text(2, 60), _text(2, 60), "x" * 5000, LONG]


# 1 token counts
def test_counts_equal_full_encoding(spark):
    exact = Tokenizer.from_file(public_tokenizers.path(tokens.VOCAB))
    size = lambda t: len(exact.encode(t, add_special_tokens=False).ids)
    texts = [*ODD[:-1], "two  spaces\t\ttabs \n x", "<|endoftext|> a <|endoftext|>b", "don't 123,456."]
    rows = {r["doc_id"]: r for r in tokens.count_with_edits(_docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["n_tokens"] == size(t or "") and rows[i]["n_chars"] == len(t or "")
        assert rows[i]["n_tokens_edited"] == size(tokens.edited(t or "", tokens.default_edits(t or "")))


def test_tree_under_random_edits():
    encode = tokens.encoder(public_tokenizers.path(tokens.VOCAB), public_tokenizers.path(tokens.RANKS))
    pick = random.Random(4)
    chinese = "".join(pick.choice("汉字漢語中文，。！、言葉かなカナ한글") for _ in range(900))
    dense = "".join(pick.choice(["don't", "x's", "12", "3.5", "é,", "<|endoftext|>", "|>", "<|", "ß", "\u0301", "_", "'", "'ll9", "\t", "…", "\u00a0", "\u3000 ", "\x1c ", "\x85\t"]) for _ in range(400))
    for start in ["", " ", _text(3, 400), "a  b\n\n c" * 50, chinese, dense]:
        tree, now = tokens.CountTree(start, encode.count, 32), start
        for _ in range(60):
            a = pick.randrange(len(now) + 1)
            edit = (a, a + pick.choice([0, 1, 5, 90]), pick.choice(["", " ", "\n", "x", "'", "7", "|>", "<|", "字", " new words ", _text(a, 40)]))
            tree.replace(*edit)
            now = tokens.edited(now, [edit])
            assert (tree.text, tree.n_tokens, tree.n_chars) == (now, len(encode.whole(now)) // 4, len(now))
    tree = tokens.CountTree(LONG, encode.count)
    tree.replace(1000, 1010, "edit")
    assert tree.encoded < 2000  # of 130 000 characters
    tree = tokens.CountTree(chinese * 20, encode.count)
    tree.replace(9000, 9010, "，")
    assert tree.encoded < 2000  # of 18 000 characters without a space


# 2 language identification
def test_language(spark):
    pick = random.Random(6)
    vocab = {"en": "the and of shall with there".split(), "fr": "le une avec être pour était".split(), "de": "der über nicht mit straße und".split()}
    rows = [(" ".join(pick.choice(vocab[g]) for _ in range(20)), g) for g in vocab for _ in range(60)]
    odd = [(None, "en"), ("", "fr"), ("123 !?", "de"), ("the and of", None)]
    got = langid.identify(_docs(spark, [t for t, _ in rows + odd], [g for _, g in rows + odd])).orderBy("doc_id").collect()
    assert all(r["lang_pred"] == g and 0 <= r["score"] <= 1 for r, (_, g) in zip(got, rows, strict=False) if r["held_out"])
    assert sum(r["held_out"] for r in got) > 20
    assert [r["lang_pred"] for r in got[-4:]] == ["und", "und", "und", "en"]
    none = langid.identify(_docs(spark, ["abc"], [None])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


def _buckets(text):
    """Buckets of the 1- to 3-grams, one by one."""
    plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    for n in langid.ORDERS:
        for i in range(len(plain) - n + 1):
            h = n
            for c in plain[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            if plain[i : i + n] != " ":
                yield h >> 16


def _by_hand(rows, texts):
    """Naive Bayes over all rows, in plain Python: the likeliest language of each text, and its probability."""
    counts, size = defaultdict(Counter), Counter(g for _, g in rows)
    for t, g in set(rows):
        counts[g].update(_buckets(t))
    out = []
    for t in texts:
        grams, logs = list(_buckets(t)), {}
        for g in sorted(counts):
            total = math.log(sum(counts[g].values()) + 0.1 * (1 << 16))
            logs[g] = math.log((size[g] + 1) / (len(rows) + len(size))) + sum(math.log(counts[g][b] + 0.1) - total for b in grams)
        best = max(logs, key=logs.get)
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())) if any(c.isalpha() for c in t) else ("und", 0.0))
    return out


@pytest.mark.parametrize("piece", [langid.PIECE, 7])
def test_language_by_hand(spark, monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "LOOKUPS", 50)
    rows = [("the cat and the hat", "en"), ("the cat and the hat", "en"), ("of mice and men", "en"), ("le chat et la souris", "fr"), ("der Hund und die Straße", "de")]
    texts = ["the men", "la  souris -- grise", "Straße", "ΣΊΣΥΦΟΣ", "the " * 30 + "souris", "12", ""]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), text="text", lang="lang")
    pred, sure = langid.score(texts, model)
    for p, x, (want, prob) in zip(pred, sure, _by_hand(rows, texts), strict=True):
        assert p == want and abs(x - prob) < 1e-4


def test_rare_languages_are_learned_or_no_answer(spark):
    pick = random.Random(9)
    words = {g: [f"{''.join(pick.choice(a) for _ in range(5))}" for _ in range(60)] for g, a in (("en", "abcdefghij"), ("de", "klmnopqrst"))}
    rows = [(" ".join(pick.choice(words[g]) for _ in range(12)), g) for g in ("en", "de") for _ in range(600)] + [("uvwxyz vwxyzu", "sw")] * 2
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), text="text", lang="lang", max_docs=100)
    assert model.langs == ["de", "en", "sw"]
    assert langid.score([rows[0][0], rows[700][0], "uvwxyz"], model)[0] == ["en", "de", "sw"]
    assert langid.quotas([1000, 3, 1000, 1], 104) == [0.05, 1.0, 0.05, 1.0]


def test_many_languages(spark):
    pick = random.Random(10)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1000)]
    rows = [(" ".join("".join(pick.choice(letters[5 * g : 5 * g + 5]) for _ in range(4)) for _ in range(8)), f"l{g:03}") for g in range(200) for _ in range(2)]
    docs = _docs(spark, [t for t, _ in rows] * 2, [g for _, g in rows] * 2)
    got = langid.identify(docs, max_docs=150).collect()
    learned = {r["lang_pred"] for r in got}
    assert len(got) == 800 and len(learned) > 150 and all(r["lang_pred"] == rows[r["doc_id"] % 400][1] for r in got)
    assert langid.identify(docs.limit(0)).count() == 0


def test_long_texts_have_the_grams_of_the_whole(monkeypatch):
    text = ("Ünïcode — ß 漢字 😀 " + LONG[:1000]) * 4200
    assert len(text) > 1 << 22
    flat = lambda: np.bincount(np.concatenate([b for _, _, b in langid.grams(["a b", text], 16)]), minlength=1 << 16)
    pieces = flat()
    monkeypatch.setattr(langid, "PIECE", 1 << 30)
    assert (pieces == flat()).all()
    told = np.arange(1 << quality.BITS) % 3 == 0
    pieces = [x.tolist() for d in quality.present(["a b", text], told) for x in d]
    monkeypatch.setattr(quality, "PIECE", 1 << 30)
    whole = [x.tolist() for d in quality.present(["a b", text], told) for x in d]
    assert pieces[1] + pieces[3] == whole[1]
    assert pieces[0] + pieces[2] == whole[0]


# 3 suffix arrays
def _copied(seed, n_docs=12):
    pick = random.Random(seed)
    shared = [_text(seed + i, pick.randint(5, 40)) for i in range(4)]
    out = []
    for i in range(n_docs):
        parts = [_text(1000 * seed + i, 10)] + [pick.choice(shared) for _ in range(pick.randint(0, 3))] + [_text(2000 * seed + i, 5)]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, monkeypatch, seed):
    texts = [*_copied(seed), None, "", "short", "ab" * 200, "z" * 300, "é" * 90, "exact copy " * 9, "exact copy " * 9]
    if seed == 2:
        monkeypatch.setattr(suffix, "CROWD", 1)
    got = suffix.repeat_report(_docs(spark, texts), window=50, k=16).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == suffix.brute_force(texts, 50)


def test_repeats_in_small_chunks(spark, monkeypatch):
    texts = _copied(5, 30)
    monkeypatch.setattr(suffix, "CHUNK", 97)
    begin = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = [suffix.anchors(b, 0, len(b) - 49, 50, 16) for b in begin if len(b) >= 50]
    for b, (s, e, p, _, _) in zip([b for b in begin if len(b) >= 50], whole, strict=True):
        assert s[0] == 0 and e[-1] == len(b) - 50 and (s[1:] == e[:-1] + 1).all() and (p >= e).all() and (p + 16 <= s + 50).all()


def test_repeated_rows_and_removal(spark):
    text = _text(9, 30)
    docs = _docs(spark, [text, text, "unique " + _text(10, 30)], ids=[1, 1, None])
    got = {(r["doc_id"], r["text"]) for r in suffix.remove_repeats(docs, window=50, k=16).collect()}
    assert (1, "") in got and any(i is None and t.startswith("unique") for i, t in got)
    assert suffix.remove_repeats(docs.limit(0), window=50, k=16).count() == 0


def _maximal(texts, window):
    """Length and occurrences of every maximal repeat, by looking at all stretches of all texts."""
    raws, out = [t.encode() if t else b"" for t in texts], set()
    places = defaultdict(list)
    for d, r in enumerate(raws):
        for n in range(window, len(r) + 1):
            for i in range(len(r) - n + 1):
                places[r[i : i + n]].append((d, i))
    for x, at in places.items():
        left = {raws[d][i - 1] if i else (d, "start") for d, i in at}
        right = {raws[d][i + len(x)] if i + len(x) < len(raws[d]) else (d, "end") for d, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(x), frozenset(at)))
    return out


def test_repeat_groups_are_all_maximal_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 64)
    a, b = "the quick brown fox jumps", "over the lazy dog again"
    texts = [f"{a} {b} one", f"x {a} {b} two", f"{b} {a}", f"{a} {b}", f"{a} {b}", "abab" * 8, "z" * 30, None, "", "unique stuff here", f"{a}é{b}"]
    got = defaultdict(set)
    rows = suffix.repeat_groups(_docs(spark, texts), window=12, k=4).collect()
    for r in rows:
        got[r["group_id"], r["length"]].add((r["doc_id"], r["start"]))
    want = _maximal(texts, 12)
    assert {(n, frozenset(at)) for (_, n), at in got.items()} == want and len(rows) == sum(len(at) for _, at in want)
    assert suffix.repeat_groups(_docs(spark, []), window=12, k=4).count() == 0


def test_windows_in_turns(monkeypatch):
    texts = [t.encode() for t in _copied(3, 20)]
    many = np.array([max(len(t) - 49, 0) for t in texts])
    texts, many = [t for t, n in zip(texts, many, strict=True) if n], many[many > 0]
    whole = sorted((n, sorted(p)) for n, p in suffix.repeats(texts, many, 50))
    monkeypatch.setattr(suffix, "SORTED", 500)
    monkeypatch.setattr(suffix, "CHUNK", 300)
    assert whole and sorted((n, sorted(p)) for n, p in suffix.repeats(texts, many, 50)) == whole


def test_maximal_repeats_have_all_occurrences():
    found = suffix.repeats([b"xabcdefghijq", b"yabcdefghijr", b"zabcdefghiks"], np.array([8, 8, 8]), 5)
    assert (9, [(0, 1), (1, 1), (2, 1)]) in [(n, sorted(p)) for n, p in found]
    assert (10, [(0, 1), (1, 1)]) in [(n, sorted(p)) for n, p in found]
    assert len(found) == 2


# 4 quality
def test_quality(spark):
    pick = random.Random(8)
    good = [_text(100 + i, 80) for i in range(150)]
    toxic = [" ".join(w if pick.random() > 0.1 else "vequil" for w in _text(500 + i, 80).split()) for i in range(60)]
    low = ["spam " * 60 + _text(700 + i, 10) for i in range(60)]
    texts = [*good, *toxic, *low, None, ""]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 210), int(150 <= i < 210)) for i in range(0, 270, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    assert sum(got[i]["keep"] for i in range(150)) >= 147
    assert sum(got[i]["keep"] for i in range(150, 270)) <= 4
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["keep"]}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == len(texts)
    assert quality.classify(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("piece", [quality.PIECE, 11])
def test_features_by_hand(monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)

    def bucket(gram):
        h = 5
        for c in gram:
            h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 15
        return h >> 12

    texts = ["spam spam spam eggs", "", "a", "Spam and eggs", "spam\tSPAM\n\nspam x x", "x" * 40, _text(4, 30)]
    words = {b: (i % 5) / 3 + 0.1 for i, b in enumerate(sorted({bucket(f" {t.lower()} "[i : i + 5]) for t in texts for i in range(len(t) - 2)})) if i % 2}
    evidence = quality.Evidence(np.array(sorted(words)), np.array([[words[b] for b in sorted(words)], [words[b] * (b % 3) for b in sorted(words)]], np.float32))
    for t, row in zip(texts, quality.features(texts, evidence), strict=True):
        found = {b for i in range(len(t) - 2) if (b := bucket(f" {t.lower()} "[i : i + 5])) in words}
        one, two = [words[b] for b in found], [words[b] * (b % 3) for b in found]
        w = t.split()
        want = [1, math.log1p(sum(one)), math.log1p(sum(two)), max(one, default=0), max(two, default=0), math.log1p(50 * sum(x == y for x, y in zip(w, w[1:], strict=False)) / max(len(w), 1)), math.log1p(len(t))]
        assert np.allclose(row, want, atol=1e-5)


def test_sites_by_hand(spark):
    pick = random.Random(3)
    rows = [(h, p, pick.gauss(m, 1)) for h, p, n, m in (("a", "x", 200, 2), ("a", "y", 50, -1), ("b", "x", 80, 0.5), ("c", None, 1, -3), (None, "x", 5, 1)) for _ in range(n)]
    sums = defaultdict(lambda: [0, 0.0])
    for h, p, l in rows:
        for key in ((h, p), h, "all"):
            sums[key][0] += 1
            sums[key][1] += 1 / (1 + math.exp(-l))
    n, total = sums.pop("all")
    mean, hosts = total / n, {k: v for k, v in sums.items() if not isinstance(k, tuple)}
    paths, within = {k: v for k, v in sums.items() if isinstance(k, tuple)}, mean * (1 - mean)

    def worth(between):
        return min(max(within / between if between > 0 else 1e6, 10.0), 1e6)

    m_host = worth((sum(s * s / k for k, s in hosts.values()) - n * mean**2 - (len(hosts) - 1) * within) / n)
    ph = {h: (s + m_host * mean) / (k + m_host) for h, (k, s) in hosts.items()}
    m_path = worth((sum(k * (s / k - ph[key[0]]) ** 2 for key, (k, s) in paths.items()) - len(paths) * within) / n)
    logit = lambda p: math.log(p / (1 - p))
    got = {(r["host"], r["path"]): r["shift"] for r in quality.site_priors(spark.createDataFrame(rows, "host string, path string, l double"), "host", "path", "l").collect()}
    assert set(got) == set(paths)
    for key, (k, s) in paths.items():
        assert abs(got[key] - (logit((s + m_path * ph[key[0]]) / (k + m_path)) - logit(mean))) < 1e-6


def test_sites_shrink(spark):
    rows = [("big", "p", 2.0)] * 500 + [("bad", "p", -2.0)] * 100 + [("one", "p", -2.0)] + [(None, None, 2.0)]
    shift = {r["host"]: r["shift"] for r in quality.site_priors(spark.createDataFrame(rows, "host string, path string, l double"), "host", "path", "l").collect()}
    assert shift["bad"] < shift["one"] < 0 < shift["big"]


# 5 SimHash
def test_fingerprints_by_definition():
    for t in [*ODD[:-1], "A b C", "one two three four"]:
        h = simhash.shingle_hashes(t, 3)
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert int(simhash.fingerprints([t], 3)[0][0, 0]) == want


def _components(prints, ids, radius):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min((ids[j] for j in range(len(ids)) if root[j] == r and ids[j] is not None), default=None) for r in root]


def test_near_duplicates(spark):
    base = _text(11, 120).split()
    texts = [*ODD]
    for i in range(12):
        changed = list(base)
        changed[i] = "other"
        texts.append(" ".join(changed))
    ids = [*range(40, 40 + len(texts) - 1), None]
    got = simhash.near_duplicates(_docs(spark, texts, ids=ids)).collect()
    prints = [int(simhash.fingerprints([t], 3)[0][0, 0]) for t in texts]
    want = dict(zip(ids, _components(prints, ids, 3), strict=True))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(int(r["fingerprint"], 16) == prints[ids.index(r["doc_id"])] for r in got)
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_tiles_find_every_link(spark):
    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = (np.uint64(1) << pick.integers(0, 64, (300, 3), dtype=np.uint64)).sum(1, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ flips]))
    rows = spark.createDataFrame([(int(p), int(p), 0) for p in prints.view(np.int64)], "key long, w0 long, size long")
    halves = lambda box: (box[:, 0] + box[:, 1]) * 33 + box[:, 2] + box[:, 3]

    def later(c):
        x, y = divmod(c, 33)
        return [p * 33 + q for p in range(x, x + 4) for q in range(max(0, y - 3), y + 4) if p * 33 + q > c and p - x + abs(q - y) <= 3]

    ids = prints.view(np.int64).tolist()
    apart = np.bitwise_count(prints[:, None] ^ prints[None])
    want = components_of(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(apart <= 3), strict=True) if i < j])
    for tile in (65_536, 4):  # small tiles: cells in several parts
        edges = simhash.tiled_links(rows, 1, simhash._population, halves, later, radius=3, first_radius=3, gap=3, tile=tile).collect()
        assert components_of(ids, [(r["a"], r["b"]) for r in edges]) == want


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    pick = random.Random(12)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(300, 340)] + [(pick.randrange(40), pick.randrange(40)) for _ in range(30)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df, "a", "b").collect()}
    true = [(a, b) for a, b in edges if a is not None and a != b]
    want = components_of({n for e in true for n in e}, true)
    assert {n: got.get(n, n) for n in want} == want
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_drop_near_duplicates(spark):
    base = _unlike(13, 300)
    near = list(base)
    near[50], near[200] = "changed", "again"
    texts = [" ".join(base), " ".join(near), " ".join(_unlike(14, 300)), None, "", " ".join(base)]
    docs = _docs(spark, texts, ids=[3, 2, 1, 5, 4, 3])
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 4]


def _sharing(seed, n, share):
    """Two texts of n shingles each with a Jaccard similarity of about ``share``: they differ in a stretch at the end."""
    words, shared = _unlike(seed, n + 4), round(2 * n * share / (1 + share))
    return " ".join(words), " ".join([*words[: shared + 4], *_unlike(seed + 50_000, n - shared)])


def test_near_duplicates_are_those_of_the_sets(spark):
    pairs = [_sharing(1000 + i, n, share) for i, (n, share) in enumerate((n, s / 100) for n in (9, 60, 190) for s in range(60, 95, 2))]
    pairs += [(" ".join(w := _unlike(2000 + i, 4 * m + 4)), " ".join([*w, *_unlike(3000 + i, m)])) for i, m in enumerate((1, 2, 4, 7))]  # contained, 4 : 5
    once = " ".join(_unlike(4000, 80))
    pairs.append((once, " ".join([once, *[" ".join(once.split()[:20])] * 12])))  # repeats do not weigh
    chain = [" ".join(_unlike(5000, 130)[i : i + 104]) for i in range(0, 24, 8)]  # neighbours at 0.85, ends at 0.72
    texts = [t for p in pairs for t in p] + chain + [None]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 > 0]
    roots = components_of(range(len(texts)), links)
    assert 0 < len(links) < len(pairs)
    got = simhash.drop_near_duplicates(_docs(spark, texts))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(roots.values()))


def test_contained_sets_of_every_size_meet(spark):
    pairs = [(" ".join(w := _unlike(7000 + i, a + 4)), " ".join([*w, *_unlike(8000 + i, b - a)])) for i, (a, b) in enumerate(((12, 15), (40, 50), (64, 80), (152, 190), (200, 250)))]
    got = simhash.drop_near_duplicates(_docs(spark, [t for p in pairs for t in p]))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 4, 6, 8]


def test_verified_links_in_tiles(spark):
    words = _unlike(6000, 400)
    texts = [" ".join(words[i : i + 60]) for i in range(0, 300, 4)] + [" ".join(words[i : i + 60]) for i in range(2, 300, 30)]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    rows = spark.createDataFrame([(i, i % 2, len(sets[i]), t) for i, t in enumerate(texts)], "key long, root long, size long, text string")
    links = [(i, j) for i in range(len(sets)) for j in range(i) if i % 2 == j % 2 and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]
    for mass in (1 << 21, 500):  # in one bundle, and in several tiles
        edges = simhash.verified_links(rows, 5, Fraction("0.8"), mass).collect()
        assert components_of(range(len(texts)), [(r["a"], r["b"]) for r in edges]) == components_of(range(len(texts)), links)


def _unlike(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


# 6 packing
@pytest.mark.parametrize("per_part", [16_384, 12])
def test_packing(spark, per_part):
    texts = [*ODD, *(_text(i, 1 + 37 * i % 900) for i in range(80)), "same", "same"]
    docs = _docs(spark, texts, ids=[None, *range(1, len(texts))])
    rows = packing.pack(docs, per_part=per_part, fan_in=3).toPandas()
    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCAB))
    bins = rows.sort_values(["sequence_id", "offset"])
    assert (bins["offset"] == bins.groupby("sequence_id")["length"].cumsum() - bins["length"]).all()
    assert bins.groupby("sequence_id")["length"].sum().max() <= 1024
    import zlib

    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = rows[rows["doc_id"].isna() if i == 0 else rows["doc_id"] == i].sort_values("piece")
        assert mine["start"].tolist() == [s for s, _ in packing.cut(len(ids), 1024)]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine["start"], mine["length"], strict=True)] == mine["ids_crc32"].tolist()
    lengths = rows["length"].to_numpy()
    assert rows["sequence_id"].nunique() <= packing.lower_bound(lengths, 1024) + 2 * -(-int((lengths < 1024).sum()) // per_part)  # for each part, its bound rounded up and a gap
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_exchanges_until_nothing_is_saved(spark):
    docs = _docs(spark, [_text(i, 1 + 53 * i % 700) for i in range(240)])
    rows = packing.pack(docs, per_part=12, fan_in=3).toPandas()
    bins = rows.sort_values(["sequence_id", "offset"])
    assert (bins["offset"] == bins.groupby("sequence_id")["length"].cumsum() - bins["length"]).all()
    assert sorted(rows["doc_id"]) == list(range(240)) and bins.groupby("sequence_id")["length"].sum().max() <= 1024
    assert rows["sequence_id"].nunique() <= packing.lower_bound(rows["length"].to_numpy(), 1024) + 4  # two rounds left 11 more than the bound
    assert packing.certificate(spark.createDataFrame(rows)) == (rows["sequence_id"].nunique(), packing.lower_bound(rows["length"].to_numpy(), 1024))
    large = [None, (1 << 60) + 1, (1 << 60) + 3]
    kept = packing.pack(_docs(spark, ["a", "b", "c"], ids=large)).collect()
    assert {r["doc_id"] for r in kept} == set(large) and packing.certificate(packing.pack(docs.limit(0))) == (0, 0)


def test_bounds_hold():
    pick = random.Random(2)
    for _ in range(200):
        sizes = np.array([pick.randint(1, 30) for _ in range(pick.randint(1, 25))])
        bins, offsets, n = packing.best_fit_decreasing(sizes, 30)
        assert packing.lower_bound(sizes, 30) <= n
        for b in range(n):
            at = sorted((offsets[bins == b][i], sizes[bins == b][i]) for i in range((bins == b).sum()))
            assert sum(s for _, s in at) <= 30 and [o for o, _ in at] == np.cumsum([0, *(s for _, s in at)])[:-1].tolist()
    assert packing.lower_bound(np.array([16, 16, 16]), 30) == 3
    assert packing.lower_bound(np.array([], int), 30) == 0


# 7 URL filters
def test_urls(spark):
    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://A.com/en/1", "", "com/en/", "block"), (2, "http://b.org/x", canonical.format("http://a.com/en/1"), None, "block"),
        (3, "http://c.org/y?q#f", "<meta http-equiv=refresh content='0; url=http://b.org/x'>", None, "block"), (4, None, None, None, "allow"), (5, "nohost", "", None, "allow"),
        (6, "http://www.example.com/en/7", "<link href=/z rel=canonical>", "example.com/en/7", "allow"), (7, "http://www.example.com/z", "", None, "allow"),
        (8, "http://d.org/q", canonical.format("http://c.org/y?q"), None, "block"), (9, "https://c.org/y?q", None, None, "block"), (9, "https://c.org/y?q", None, None, "block"),
        (10, "http://m.example.com/en/70", canonical.format("http://o.org/both"), "example.com/en/7", "allow"), (11, "http://o.org/both", canonical.format("http://x.net/de/1"), None, "allow"),
        (12, "HTTP://X.NET/de/1", "", "net/de/", "block"), (13, "ftp://", "", None, "allow"), (14, "http://notexample.com", "", None, "allow"), (15, "http://org/es/?a", "", "org/es/", "block"),
        (16, "x://h?en/", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, h, "e") for i, u, h, _, _ in rows], "page_id long, url string, html string, host string")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(df, queries.URL_RULES).collect()]
    assert Counter(got) == Counter((i, r, v) for i, _, _, r, v in rows)
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0
    more = spark.createDataFrame([("http://notexample.com", "http://a.com/en/5")], "from_url string, to_url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, queries.URL_RULES, redirects=more).collect()}[14] == "block"
    con = duckdb.connect()
    pages = df.select("page_id", "url", "html").filter("page_id in (1, 2, 4, 5, 7, 8, 12, 13, 14, 15, 16)").toPandas()
    con.register("pages", pages)
    small = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pages.astype(object).itertuples(index=False)], "page_id long, url string, html string")
    key = lambda r: tuple("" if v is None or v != v else v for v in r)
    want = sorted(map(key, con.sql(queries.ORACLE_SQL["op7_url_filters"]).df()[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False)))
    assert sorted(map(key, urls.judge(small, queries.URL_RULES).collect())) == want


# 8 fingerprints
def _xx(value, seed):
    """Spark's xxhash64 of one value, chained by the seed."""
    data = value.encode() if isinstance(value, str) else struct.pack("<i", value) if isinstance(value, bool) else struct.pack("<q", value)
    return xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)


def _chained(values):
    h = 42
    for v in values:
        h = h if v is None else _xx(v, h)
    return h


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def _sketch(text, k=5, scale=4):
    words = [_signed(_xx(w, 42)) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    runs = {_signed(_chained(words[i : i + k])) for i in range(len(words) - k + 1)} or {_signed(_chained(words))}
    low = {h for h in runs if h < -(1 << 63) + (1 << 64) // scale}
    return sorted(low or {min(runs)})


@pytest.mark.parametrize("per_part", [200_000, 3])
def test_sketches(spark, per_part):
    texts = [*ODD, _text(20, 900), _text(21, 700), "twice here", "twice here", "twice here", "one two three four five six seven"]
    ids = [*range(len(texts) - 6), None, 3, 5, 5, 5, None]
    got = sketch.fingerprints(_docs(spark, texts, ids=ids), per_part=per_part, copies=1).collect()
    place = lambda i: (ids[i] is None, -(ids[i] or 0), _signed(_chained([texts[i] or "", ids[i], ids[i] is None])))
    order = sorted(range(len(texts)), key=place)
    want = []
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[a] or "", texts[b] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        x, y, z = (set(_sketch(v)) for v in (t, e, n))
        join = lambda v: "".join(f"{u & (1 << 64) - 1:016x}" for u in _sketch(v))
        want.append((ids[a], len(t), hashlib.sha256(e.encode()).hexdigest(), join(t), join(e), len(x & y) / min(len(x), len(y)), len(x & z) / min(len(x), len(z))))
    assert Counter(map(tuple, got)) == Counter(want)
    assert sketch.fingerprints(_docs(spark, [])).count() == 0
    lone = sketch.fingerprints(_docs(spark, ["only one"])).first()
    assert lone["near_next"] == 1.0


def test_short_texts_are_found_in_long_ones(spark):
    held = [" ".join(_unlike(90 + i, 20)) for i in range(40)]
    long = " ".join([*_unlike(80, 3000), *held])
    rows = sketch.with_sketch(_docs(spark, [*held, long]), "text", "s").orderBy("doc_id").collect()
    share = [len(set(r["s"]) & set(rows[-1]["s"])) / len(r["s"]) for r in rows[:-1]]
    assert sum(x == 1 for x in share) >= 38  # but for texts without a hash under the threshold


def test_containment_and_merge(spark):
    small, big = _unlike(30, 400), _unlike(31, 6000)
    docs = _docs(spark, [" ".join(small), " ".join(big + small), " ".join(big)])
    rows = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs, "text", "s", scale=8).collect()}
    df = spark.createDataFrame([(rows[0], rows[1], rows[2])], "a array<long>, b array<long>, c array<long>")
    got = df.select(sketch.containment(F.col("a"), F.col("b")), sketch.containment(F.col("a"), F.col("c")), sketch.merge(F.col("a"), F.col("c"), 8), sketch.jaccard(F.col("a"), F.col("b"))).first()
    assert got[0] > 0.95 and got[1] == 0 and set(got[2]) == set(rows[0]) | set(rows[2]) and got[3] < 0.2


# 9 decontamination
def test_decontamination(spark):
    items = [(1, _text(40, 30)), (2, "tiny item"), (3, _text(41, 13)), (10, _text(40, 30)), (None, _text(42, 20)), (4, None), (5, ""), (3, _text(41, 13))]
    texts = [*ODD, items[0][1], f"x {items[0][1][:90]} y", "a Tiny-ITEM here", _text(41, 13).upper(), _text(42, 20), _text(41, 13) + " " + _text(50, 400), "tiny"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = _docs(spark, texts)
    want = decontam.brute_force(texts, items)
    for size, at_once in ((8 << 20, 8), (60, 50), (60, 2)):  # in one block, in several of one turn, and in many turns
        got = decontam.hits(docs, bench, block_bytes=size, at_once=at_once, shard_chars=500).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == want
    twice = decontam.hits(docs.unionAll(docs), bench, block_bytes=60, at_once=2).collect()
    assert Counter(tuple(r)[1:] for r in twice) == Counter(w for w in want for _ in range(2))
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if not w[-1]}
    assert not any(r["contaminated"] for r in decontam.hits(docs, bench.limit(0)).collect())
    assert decontam.hits(docs.limit(0), bench).count() == 0


def test_longest_matches(spark):
    item = _unlike(60, 40)
    text = " ".join(["aa", "bb", *item[5:35], "cc", *item[:14]])
    bench = spark.createDataFrame([(9, " ".join(item)), (10, " ".join(_unlike(61, 40))), (11, None)], "item_id long, text string")
    for size in (1 << 20, 100):
        got = decontam.longest_matches(_docs(spark, [text, None, ""]), bench, block_bytes=size, at_once=1).collect()
        assert sorted((r["item_id"], r["doc_word"], r["item_word"], r["n_words"]) for r in got) == [("9", 2, 5, 30), ("9", 33, 0, 14)]
    assert decontam.longest_matches(_docs(spark, []), bench).count() == 0


# 10 line dedup
def test_lines(spark):
    pick = random.Random(15)
    pool = [_text(70 + i, 6) for i in range(12)]

    def vary(s):
        i = pick.randrange(len(s))
        return pick.choice([s, s[:i] + s[i + 1 :], s[:i] + "q" + s[i:], s[:i] + "é" + s[i + 1 :], s + "!", s[1:]])

    texts = ["\n".join(pick.choice([vary(pick.choice(pool)), "", " ", "short", "shirt", "x" * 40, "x" * 41]) for _ in range(pick.randint(0, 8))) for _ in range(40)]
    texts += [None, "", "\n", "aaaaaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaaaaabb", LONG, LONG + "z"]
    want = lines.brute_force(list(enumerate(texts)))
    docs = _docs(spark, texts)
    got = lines.dedup_report(docs).orderBy("doc_id").collect()
    assert [r["kept_lines"] for r in got] == want
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        full = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j in want[i] or not x.strip(" \t\n\x0b\f\r"))
        assert out[i]["text"] == full and (full is None or out[i]["n_chars"] == len(full))
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_repeated_rows(spark):
    docs = _docs(spark, ["one line here\ntwo", "one line here\ntwo", "two\nthree", "two"], ids=[1, 1, None, 2])
    got = sorted((r["doc_id"] or 99, r["text"]) for r in lines.dedup_lines(docs).collect())
    assert got == [(1, "one line here\ntwo"), (1, "one line here\ntwo"), (2, ""), (99, "three")]


def test_many_long_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "PIECE", 64)
    line = "".join(random.Random(1).choice("abcdefgh") for _ in range(1000))
    texts = ["\n".join(line[:i] + "X" + line[i + 1 :] for i in range(j, 1000, 100)) for j in range(30)] + [line, "é", "e", "éa", "xyzzy", "a" * 999, "a" * 1000]
    got = lines.dedup_report(_docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["kept_lines"] for r in got] == lines.brute_force(list(enumerate(texts)))


@pytest.mark.parametrize("piece", [5, 1 << 17])
def test_variants_come_in_pieces(piece):
    line, keys = "abcdéfghijk" * 4, list(range(8))
    found = list(lines._variants(line, keys, piece))
    whole = list(lines._variants(line, keys, 1 << 20))
    flat = lambda parts: Counter((int(h), int(r)) for hs, rs in parts for h, r in zip(hs, rs, strict=True))
    assert flat(found) == flat(whole) and all(len(h) <= 8 * piece for h, _ in found)


# What all have in common.
def _clash(docs):
    """``docs`` with columns named like those that operators add."""
    names = ["rk", "did", "kept", "spans", "own", "nth", "logit", "host", "path", "shift", "words", "runs"]
    for n in names:
        docs = docs.withColumn(f"__kn_{n}", F.lit(n)).withColumnRenamed(n, f"{n}x")
    return docs


def test_clashing_names(spark):
    text = " ".join(_unlike(15, 60))
    docs = _clash(_docs(spark, [text, text, None, "one\nones\ntwo", ""]))
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    for kept, n in ((lines.dedup_lines(docs), 5), (simhash.drop_near_duplicates(docs), 3), (suffix.remove_repeats(docs, window=50, k=16), 5), (quality.keep_good(docs, labels), None), (decontam.remove_contaminated(docs, bench), 5)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert (n is None or len(rows) == n) and all(r["__kn_rk"] == "rk" for r in rows)


def test_ids_may_be_strings(spark):
    texts = [_text(2, 60), _text(2, 60), "short", None, "shorts"]
    docs = _docs(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    ids = {f"d{i}" for i in range(5)}
    labels = spark.createDataFrame([("d0", 1, 0), ("d2", 0, 0)], "doc_id string, quality int, toxic int")
    bench = spark.createDataFrame([(1, _text(2, 60))], "item_id long, text string")
    for found in (tokens.count_with_edits(docs), langid.identify(docs), suffix.repeat_report(docs, window=50, k=16), quality.classify(docs, labels), simhash.near_duplicates(docs), packing.pack(docs), sketch.fingerprints(docs), decontam.hits(docs, bench), lines.dedup_report(docs)):
        assert {r["doc_id"] for r in found.collect()} == ids
    assert {r["component_id"] for r in simhash.near_duplicates(docs).filter("doc_id < 'd2'").collect()} == {"d0"}
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {"d0", "d2", "d3", "d4"}
    assert tokens.count_with_edits(docs.limit(0)).count() == simhash.drop_near_duplicates(docs.limit(0)).count() == lines.dedup_report(docs.limit(0)).count() == 0
