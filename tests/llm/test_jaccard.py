import itertools

import numpy as np
import pytest

from fieldlens.llm import jaccard, trees
from fieldlens.llm.common import WordHashes
from fieldlens.operators.graphs import star_components


def brute(rows, percent=80, size=5):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def degrees(rows, percent=80, size=5):
    """Of each id, how many other sets reach the similarity."""
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    kinds = set(sets.values())
    return {i: sum(s != o and bool(s & o) and 100 * len(s & o) >= percent * len(s | o) for o in kinds) for i, s in sets.items()}


@pytest.mark.parametrize("options", [{}, {"block": 4, "block_bytes": 3000}, {"region": 8, "sample": 10**9, "frequent": 1000}, {"percent": 50}])
def test_components_and_links_against_brute_force(docs, rows, options):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(docs, **options).collect()}
    percent = options.get("percent", 80)
    links = degrees(rows, percent)
    want = {i: (*x, links[i]) for i, x in brute(rows, percent).items()}
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(want) - 20 and max(links.values()) > 8


def test_empty_table_and_repeats(docs, empty, rows):
    assert jaccard.jaccard_components(empty).count() == 0
    got = jaccard.jaccard_components(docs.unionAll(docs)).collect()
    want, links = brute(rows), degrees(rows)
    assert len(got) == 2 * len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] and r.n_links == links[r.doc_id] for r in got)


def test_null_ids_and_clashing_columns(docs, spark, rows):
    from pyspark.sql import functions as F

    odd = docs.withColumn("n", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("node", F.lit(2)).withColumn("key", F.lit(3)).withColumn("own", F.lit(3))
    nameless = odd.withColumn("doc_id", F.when(F.col("doc_id") > 100, F.col("doc_id")))
    kept = jaccard.near_duplicates_removed(nameless.unionAll(nameless))
    got = kept.collect()
    want = brute([(i if i > 100 else 10_000 + i, t) for i, t, *_ in rows])  # ids after all others stand for none
    heads = {i for i, (n, c) in want.items() if i == c}
    assert set(kept.columns) == set(odd.columns)
    assert {r.doc_id for r in got if r.doc_id is not None} == {i for i in heads if i < 9_000}
    texts = {10_000 + i: t for i, t, *_ in rows}
    lost = [texts[i] for i in heads if i > 9_000]
    empties = [t for t in lost if not (t or "").split()]
    assert sum(r.doc_id is None for r in got) == len(lost) - len(empties) + len(set(empties))
    one = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert jaccard.jaccard_components(one).first().component_id is None


def test_one_row_of_repeated_rows_stays(docs, rows):
    got = sorted((r.doc_id for r in jaccard.near_duplicates_removed(docs.unionAll(docs)).collect()))
    assert got == sorted(i for i, (_, c) in brute(rows).items() if i == c)


def test_tree_leaves_out_no_pair(monkeypatch):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(2, 400), dtype=np.uint64)
        sets.append(np.unique(base))
        for _ in range(6):
            other = base.copy()
            swap = rng.random(len(base)) < rng.choice([0.02, 0.08, 0.3])
            other[swap] = rng.integers(0, 2**63, swap.sum(), dtype=np.uint64)
            sets.append(np.unique(other))
    n = np.array([len(s) for s in sets])
    bits = [trees.bitmap(s) for s in sets]
    none, zero, one = np.full(len(sets), -1), np.zeros(len(sets), np.int64), np.ones((len(sets), 1), np.uint64)
    pairs = lambda lead, group, side: {tuple(sorted(p)) for i, j in trees.candidates(n, bits, one, lead, group, side, 80) for p in zip(i.tolist(), j.tolist(), strict=True)}
    got = pairs(zero, none, zero)
    true = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * (same := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - same)]
    assert set(true) <= got and len(got) < len(sets) ** 2 / 8
    side = np.arange(len(sets)) % 2
    assert pairs(zero, none, side) == {p for p in got if side[p[0]] != side[p[1]]}
    monkeypatch.setattr(trees, "MOST_PAIRS", 128)
    monkeypatch.setattr(trees, "MOST_WORDS", 8)
    assert pairs(np.arange(len(sets)) * 7 % 11, none, zero) == got
    whole = trees.hang_together(n, bits, one, zero, none, zero, 80).names()
    assert all(whole[a] == whole[b] for a, b in true) and (whole <= np.arange(len(sets))).all()
    half = np.where(np.arange(len(sets)) < 100, 5, -1)
    assert not any(a < 100 and b < 100 for a, b in pairs(zero, half, zero))


def test_shingles_of_short_texts():
    known = WordHashes()
    assert len(jaccard.shingle_set("", known)) == len(jaccard.shingle_set(None, known)) == 0
    assert len(jaccard.shingle_set("a B", known)) == 1
    assert (jaccard.shingle_set("A b", known) == jaccard.shingle_set("a  B\n", known)).all()


def test_components_of_a_long_chain(spark, docs):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in star_components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 1001: 1000}
    assert star_components(edges.where("a < 0")).count() == 0


def test_overlaps_are_exact_either_way(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200), dtype=np.uint64)) for _ in range(40)]
    i, j = (np.array(k) for k in zip(*itertools.combinations(range(40), 2), strict=True))
    want = [len(np.intersect1d(sets[p], sets[q])) for p, q in zip(i, j, strict=True)]
    assert jaccard.overlaps(sets)(i, j).tolist() == want
    monkeypatch.setattr(jaccard, "MOST_WORDS", 0)
    assert jaccard.overlaps(sets)(i, j).tolist() == want
