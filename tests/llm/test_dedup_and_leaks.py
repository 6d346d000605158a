import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import decontaminate, fingerprint, substring_dedup


def brute_repeats(rows, window=13):
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"crowd": 3}, {"rows": 10}, {"window": 6}, {"window": 3}, {"window": 30, "crowd": 2}])
def test_repeats_against_brute_force(docs, rows, options):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_report(docs, **options).collect()}
    want = brute_repeats(rows, options.get("window", 13))
    assert got == want and sum(w[1] for w in want.values()) > 500


def test_trees_against_brute_force():
    rng = np.random.default_rng(4)
    group, doc = rng.integers(0, 5, 300), rng.integers(0, 40, 300)
    words = rng.integers(0, 2, (300, 7, 1)).astype(np.uint8) * np.ones((1, 1, substring_dedup.CODE), np.uint8)
    before = rng.integers(0, 2, (300, 3, 1)).astype(np.uint8) * np.ones((1, 1, substring_dedup.CODE), np.uint8)
    reach = rng.integers(0, 16, 300)
    order, depth = substring_dedup.tree(group, words.reshape(300, -1))
    for a, b, d in zip(order[:-1], order[1:], depth, strict=True):
        common = next((k for k in range(7) if (words[a, k] != words[b, k]).any()), 7)
        assert d == (common if group[a] == group[b] else -1)
    got = substring_dedup.repeated(group, before.reshape(300, -1), words.reshape(300, -1), doc, reach, 7)
    for i in range(300):
        want = 0
        for a in range(4):
            if reach[i] >> a & 1:
                same = (group == group[i]) & (reach >> a & 1 > 0) & (words[:, : 7 - a] == words[i, : 7 - a]).all(axis=(1, 2)) & (before[:, :a] == before[i, :a]).all(axis=(1, 2))
                want |= (doc[same].min() < doc[i]) << a
        assert got[i] == want


def test_leads_of_equal_windows_are_equal():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 4, 400).astype(np.uint64)
    a = substring_dedup.Anchors(hashes, 13)
    least = substring_dedup.leads(hashes, 13)
    seen = {}
    for place, reach, lead in zip(a.places, a.reach, a.lead, strict=True):
        for left in range(a.width):
            if reach >> left & 1:
                start = place - left
                assert least.view(np.int64)[start] == lead
                assert seen.setdefault(tuple(hashes[start : start + 13]), left) == left
    assert sum(int(r).bit_count() for r in a.reach) == 388


def test_repeated_rows_and_empty_table(docs, empty, rows):
    assert substring_dedup.dedup_report(empty).count() == 0
    got = substring_dedup.dedup_report(docs.unionAll(docs)).collect()
    want = brute_repeats(rows)
    assert len(got) == 2 * len(rows) and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


def test_texts_that_share_an_id(spark, docs):
    p = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, p), (1, "x " + p), (2, p + " y"), (None, p), (None, "z " + p)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_report(df).collect())
    assert got == [(False, 1, 20, 0), (False, 1, 21, 0), (False, 2, 21, 20), (True, 0, 20, 20), (True, 0, 21, 20)]


def test_stage_keeps_columns_and_drops_what_is_used_up(docs, rows):
    odd = docs.withColumn("key", F.lit(1)).withColumn("found", F.lit("s")).withColumn("whole", F.lit(2)).withColumn("_key", F.lit(3))
    out = substring_dedup.deduplicated(odd).collect()
    want = brute_repeats(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in out:
        assert (r.text == texts[r.doc_id]) == (want[r.doc_id][1] == 0)
    assert {r.doc_id for r in out} == {i for i, (n, gone, _) in want.items() if gone < n or n == 0}


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_leaks(rows, bench, n=10):
    items = {str(i): alnum(t) for i, t in bench}
    out = {}
    for i, t, *_ in rows:
        w = alnum(t)
        hit, found = set(), set()
        for item, x in items.items():
            k = min(n, len(x))
            grams = {tuple(x[s : s + k]) for s in range(len(x) - k + 1)} if k else set()
            for s in range(len(w) - k + 1):
                if k and tuple(w[s : s + k]) in grams:
                    found.add(item)
                    hit |= set(range(s, s + k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


@pytest.fixture(scope="session")
def bench(rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) >= 30]
    some = [(k, " ".join(t.split()[3:25]).upper()) for k, t in enumerate(texts[:6])]
    return [*some, (50, "to re"), (51, ""), (52, None), (53, some[0][1]), (54, "absent words here")]


@pytest.mark.parametrize("most", [250_000, 7])
def test_leaks_against_brute_force(spark, docs, rows, bench, most):
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, b, most=most).collect()}
    want = brute_leaks(rows, bench)
    assert got == want and sum(w[1] > 0 for w in want.values()) > 5
    twice = decontaminate.contamination(docs.unionAll(docs), b, most=most).collect()
    assert len(twice) == 2 * len(rows) and all((r.n_words, r.n_hit, r.n_items, r.items_sha256) == want[r.doc_id] for r in twice)


def test_many_windows_and_a_very_long_text(spark, docs):
    words = [f"w{k}" for k in range(200_030)]
    long = " ".join(words[i % 40_000] for i in range(100_000))
    bench = spark.createDataFrame([(k, " ".join(words[k * 10_000 : k * 10_000 + 10_020])) for k in range(20)], "item_id long, text string")
    df = spark.createDataFrame([(1, long), (None, "Q " + " ".join(words[50:70]) + ", z"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {1: (100_000, 100_000, 4), None: (22, 20, 1), 2: (0, 0, 0)}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminated(df, bench, remove="spans").collect()}
    assert cut == {1: "", None: "Q, z", 2: None}


def test_leaks_removed(spark, docs, rows, bench, empty):
    b = spark.createDataFrame([x for x in bench if x[0] != 50], "item_id long, text string")
    want = brute_leaks(rows, [x for x in bench if x[0] != 50])
    clean = {i for i, w in want.items() if not w[1]}
    assert {r.doc_id for r in decontaminate.decontaminated(docs, b).collect()} == clean
    cut = decontaminate.decontaminated(docs, b, remove="spans")
    texts = {i: t for i, t, *_ in rows}
    for r in cut.collect():
        if r.doc_id in clean:
            assert r.text == texts[r.doc_id]
        else:
            assert len(alnum(r.text)) == want[r.doc_id][0] - want[r.doc_id][1] and set(re.split("[^A-Za-z0-9é]", r.text)) <= set(re.split("[^A-Za-z0-9é]", texts[r.doc_id]))
    assert decontaminate.contamination(empty, b).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, nothing).where("contaminated").count() == 0


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: -r[0])
    want = {}
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    got = fingerprint.edited_fingerprints(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    prints = {r.doc_id: r.fingerprint for r in got}
    texts = {i: t or "" for i, t, *_ in rows}
    for a, b in zip(sorted(texts), sorted(texts)[1:], strict=False):
        assert (prints[a] == prints[b]) == (fingerprint.canonical(texts[a]) == fingerprint.canonical(texts[b]))
    assert all(r.near_edited == float(r.fingerprint == r.edited_fingerprint) for r in got)
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_fingerprints_of_odd_rows(spark, docs):
    df = spark.createDataFrame([(5, "ab cd"), (5, "ab cd"), (None, "wx"), (None, None), (7, "AB\tcd")], "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("part", F.lit(3))
    got = fingerprint.edited_fingerprints(df).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got}) == 3
    assert sum(r.near_next for r in got) == 2.0  # 7 to 5 and 5 to 5
    assert fingerprint.canonical("a\x1cb") == fingerprint.canonical("a\x1cｂ") == b"a b"


def test_folding_and_groups(spark, docs):
    assert fingerprint.canonical("  Ｆoo BAR\n") == fingerprint.canonical("foo bar") == b"foo bar"
    assert fingerprint.canonical("Straße") == fingerprint.canonical("STRASSE")
    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, None), (4, ""), (5, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.copies, r.first_id) for r in fingerprint.fingerprints(df).collect()}
    assert got[1] == got[2] and got[1][1:] == (2, 1) and got[3] == got[4] and got[5][1:] == (1, 5)
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fingerprint.edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_colliding_digests_are_told_apart(spark, docs, monkeypatch):
    df = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2"), (4, "a", "d1")], "id long, folded string, digest string").withColumn("folded", F.col("folded").cast("binary"))
    fake = fingerprint.buckets(df.withColumnsRenamed({"id": "doc_id"}).select("doc_id", F.lit("x").alias("text")))
    assert fake.count() == 1
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, **k: df if "folded" in schema else real(self, f, schema, **k))
    got = {bytes(r.folded): r.fingerprint for r in fingerprint.buckets(df.select(F.col("id").alias("doc_id"), F.lit("").alias("text"))).collect()}
    assert got == {b"a": "d1-1", b"b": "d1-2", b"c": "d2"}
