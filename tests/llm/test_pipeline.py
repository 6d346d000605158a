"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import re

import pytest

import corpus_pipeline
from fieldlens.llm import language

from .test_dedup_and_leaks import brute_leaks, brute_repeats
from .test_jaccard import brute


@pytest.fixture(scope="module")
def documents(spark, small_tables):
    return spark.read.parquet(f"{small_tables}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "n-gram jaccard join", "substring dedup", "benchmark decontamination", "source mixing"]


def test_run_against_plain_python(spark, small_tables, documents):
    model = language.train(documents)
    rows = [tuple(r) for r in documents.collect()]
    rows = [r for r in rows if not model.predict(r[1])[2]]
    root = brute(rows)
    rows = [r for r in rows if root[r[0]][1] == r[0]]
    gone = brute_repeats(rows)
    kept = []
    words = {r[0]: r[1].encode().split() for r in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for r in rows:
        n, cut, _ = gone[r[0]]
        if cut == n and n:
            continue
        text = r[1]
        if cut:
            w = words[r[0]]
            mask = [False] * n
            for k in range(n - 12):
                if first[tuple(w[k : k + 13])] < r[0]:
                    mask[k : k + 13] = [True] * 13
            text = b" ".join(x for x, m in zip(w, mask, strict=True) if not m).decode()
        kept.append((r[0], text, *r[2:]))
    bench = [tuple(r) for r in spark.read.parquet(f"{small_tables}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = brute_leaks(kept, bench)
    want = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in kept if not leaks[r[0]][1]}
    got = corpus_pipeline.run(spark, small_tables).collect()
    assert {r.doc_id: r.size for r in got} == want
    total = sum(want.values())
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 25


def test_stages_keep_columns(spark, small_tables, documents):
    odd = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, small_tables).columns == documents.columns
