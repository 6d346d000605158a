"""Substring dedup with prefix-partitioned suffix trees.

A window (13 words) is a repeat where the same words also start in a document of smaller id. The lead of
a window is the six-word run inside it of the smallest hash, the first of equal ones. Equal windows have
equal leads at equal places, so only suffixes that begin with a lead are needed: about a fifth of all
positions, a sparse suffix tree.

Leads are the prefixes by which suffixes are dealt into groups; a lead that stands in one text only makes
no suffix. A group's subtree is read off its sorted suffixes, as the tree of common prefixes: neighbours
with d common words hang below an internal node of depth d or more. The words before a lead make a second
such tree, read backwards. The window that reaches a words to the left of its lead ends below the node
of depth 13 - a in the first tree and of depth a in the second, and the smallest document below both
decides. Windows that are found so and follow each other make up maximal repeats.

Prefixes vary in length: where a lead has more than crowd suffixes, its windows go by all their 13 words,
and the smallest document of each is an aggregation with partial sums, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from fieldlens.storage import stored, stored_with
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, gram_hashes

LEAD = 6
LAST = (1 << 63) - 1  # stands for a null id: larger than any other
CODE = 6  # bytes of a word's hash that a suffix carries
SECOND = np.uint64(0x5851F42D4C957F2D)
MIXERS = np.random.default_rng(1).integers(0, 1 << 63, 2 * (LEAD + 25), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def leads(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window, the hash of its lead."""
    least = gram_hashes(hashes, min(LEAD, window))
    width, have = max(1, window - LEAD + 1), 1
    if len(least) < width:
        return least[:0]
    while have < width:  # minima over have positions each, joined to wider ones
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


class Anchors:
    """The places of a document's leads, and the windows that have each.

    reach has bit a set where the window that starts a words before the lead has it. first is the first
    place with the same words around it and the same windows: what holds there holds here.
    """

    def __init__(self, hashes: np.ndarray, window: int) -> None:
        run = min(LEAD, window)
        self.width, self.window, self.hashes = window - run + 1, window, hashes
        count = len(hashes) - window + 1
        if count < 1:
            self.places = self.reach = self.first = np.empty(0, np.int64)
            self.lead = np.empty(0, np.int64)
            return
        runs = gram_hashes(hashes, run)
        start = np.arange(count)
        at = np.lib.stride_tricks.sliding_window_view(runs, self.width)[:count].argmin(axis=1) + start
        self.places, which = np.unique(at, return_inverse=True)
        self.reach = np.zeros(len(self.places), np.int64)
        np.bitwise_or.at(self.reach, which, np.int64(1) << (at - start))
        self.lead = runs[self.places].view(np.int64)
        self.padded = np.concatenate([np.zeros(self.width - 1, np.uint64), hashes, np.zeros(window, np.uint64)])
        around = self.padded[self.places[:, None] + np.arange(self.width - 1 + window)] * MIXERS[: self.width - 1 + window]
        around = around.sum(axis=1) ^ (self.reach.view(np.uint64) * SECOND)
        _, index, inverse = np.unique(around, return_index=True, return_inverse=True)
        self.first = self.places[index[inverse]]

    def suffixes(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words before, nearest first; words from the lead on) of the kept places, as bytes of hashes."""
        codes = self.padded.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
        at = self.places[keep] + self.width - 1
        before = codes[at[:, None] - 1 - np.arange(self.width - 1)[None]]
        return before.reshape(len(at), -1), codes[at[:, None] + np.arange(self.window)[None]].reshape(len(at), -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, key, text): key tells texts apart that share an id, and is the same for repeated rows."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key"), "text")


def _leads(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            doc, key, digest, found = [], [], [], []
            for d, k, t in zip(b["doc"].to_pylist(), b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = tokens(t)
                if len(words) >= window:
                    own = leads(known.of(words), window)
                    own = np.unique(own[np.concatenate([[True], own[1:] != own[:-1]])])
                    doc.append(d)
                    key.append(k)
                    digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    found.append(own.view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.record_batch({"doc": pa.array(doc, pa.int64()), "key": pa.array(key, pa.int64()), "digest": pa.array(digest, pa.binary()), "leads": lists})

    return run


SUFFIX = pa.schema([("lead", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("reach", pa.int32()), ("before", pa.binary()), ("words", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])
SUFFIXES = "lead long, doc long, key long, place int, reach int, before binary, words binary, w1 long, w2 long"


def _bytes(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _within(values: np.ndarray, some: list[int]) -> np.ndarray:
    some_ = np.sort(np.array(some, dtype=np.int64))
    return some_[np.minimum(np.searchsorted(some_, values), len(some_) - 1)] == values if len(some_) else np.zeros(len(values), bool)


def _suffixes(window: int):
    """Suffixes of a document that begin with a shared lead, equal ones once; windows of a crowded lead, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for doc, key, text, shared, crowded in zip(*(b[c].to_pylist() for c in ("doc", "key", "text", "shared", "crowded")), strict=True):
                a = Anchors(known.of(tokens(text)), window)
                once = a.first == a.places
                keep = np.flatnonzero(once & _within(a.lead, shared))
                for i in range(0, len(keep), 20_000):
                    some = keep[i : i + 20_000]
                    n = len(some)
                    before, words = a.suffixes(some)
                    none = pa.nulls(n, pa.int64())
                    yield pa.record_batch([a.lead[some], pa.array(np.full(n, doc)), pa.array(np.full(n, key)), pa.array(a.places[some], pa.int32()), pa.array(a.reach[some], pa.int32()), _bytes(before), _bytes(words), none, none], schema=SUFFIX)
                many = np.flatnonzero(once & _within(a.lead, crowded))
                if len(many):
                    left = np.arange(a.width)
                    row, reach = np.nonzero(a.reach[many][:, None] >> left & 1)
                    start = a.places[many][row] - left[reach]
                    w1, w2 = (gram_hashes(h, window)[start].view(np.int64) for h in (a.hashes, a.hashes ^ SECOND))
                    n = len(row)
                    yield pa.record_batch([pa.nulls(n, pa.int64()), pa.array(np.full(n, doc)), pa.array(np.full(n, key)), pa.array(a.places[many][row], pa.int32()), pa.array(1 << left[reach], pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), w1, w2], schema=SUFFIX)

    return run


def tree(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, depths) of the suffixes (rows of words, as bytes) of several groups: depths are those of the internal
    nodes that join each suffix to the next one in the order; -1 between two groups.
    """
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), words], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    w = words[order].reshape(len(order), -1, CODE) if words.shape[1] else np.empty((len(order), 0, CODE), np.uint8)
    depth = np.logical_and.accumulate((w[1:] == w[:-1]).all(axis=2), axis=1).sum(axis=1, dtype=np.int64)
    return order, np.where(group[order][1:] == group[order][:-1], depth, -1)


def below(order: np.ndarray, depths: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, the number of the topmost node of at least that depth that it hangs below (or of itself)."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(depths < depth)])
    return out


def repeated(group: np.ndarray, before: np.ndarray, words: np.ndarray, doc: np.ndarray, reach: np.ndarray, window: int) -> np.ndarray:
    """Of each suffix, the bits of its windows that also start in a smaller document."""
    right, left = tree(group, words), tree(group, before)
    out = np.zeros(len(group), np.int64)
    for a in range(before.shape[1] // CODE + 1):
        rows = np.flatnonzero(reach >> a & 1)
        if len(rows):
            node = below(*right, window - a)[rows] * len(group) + below(*left, a)[rows]
            order = np.argsort(node, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
            first = np.repeat(np.minimum.reduceat(doc[rows][order], start), np.diff(np.concatenate([start, [len(rows)]])))
            hit = rows[order[first < doc[rows][order]]]
            out[hit] |= 1 << a
    return out


def _trees(window: int, rows: int):
    """Reads suffixes by lead, some whole groups at a time."""

    def done(t: pa.Table) -> pa.RecordBatch:
        lead = t["lead"].to_numpy()
        group = np.cumsum(np.concatenate([[0], lead[1:] != lead[:-1]]))
        flat = lambda c: np.frombuffer(b"".join(t[c].to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        found = repeated(group, flat("before"), flat("words"), t["doc"].to_numpy(), t["reach"].to_numpy(), window)
        hit = np.flatnonzero(found)
        return pa.record_batch({"key": t["key"].to_numpy()[hit], "place": t["place"].to_numpy()[hit], "reach": pa.array(found[hit], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= rows:
                t = pa.Table.from_batches(held)
                lead = t["lead"].to_numpy()
                cut = np.flatnonzero(lead[1:] != lead[:-1])
                if len(cut):
                    k = int(cut[-1]) + 1
                    yield done(t.slice(0, k))
                    held = t.slice(k).combine_chunks().to_batches()
                    count = sum(x.num_rows for x in held)
        if count:
            yield done(pa.Table.from_batches(held))

    return run


FOUND = "array<struct<place:int,reach:int>>"


def repeats(docs: DataFrame, window: int = 13, crowd: int = 4096, rows: int = 50_000) -> DataFrame:
    """(key, found, whole): by document, the leads (by place) and which of their windows also start in a smaller document.

    whole marks an exact copy (by words) of a smaller document, all of whose windows do. A null id is
    larger than any other. Rows that share an id never count against each other.
    """
    if not 1 <= window <= LEAD + 25:
        raise ValueError(f"a window has 1 to {LEAD + 25} words")
    base = _keyed(docs)
    texts = stored(base.mapInArrow(_leads(window), "doc long, key long, digest binary, leads array<long>"), "texts")
    kinds = stored(texts.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "kinds")
    copies = stored(texts.select("key", "doc", "digest").join(kinds, "digest").where("doc > first").select("key").distinct(), "copies")

    own = texts.select("doc", "key", "leads").join(copies, "key", "left_anti").select(F.explode("leads").alias("lead"), "doc", "key")
    twice = stored(own.groupBy("lead").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b").select("lead", "n"), "twice")
    some = lambda where: F.collect_set(F.when(where, F.col("lead")))
    lists = own.select("lead", "key").join(twice, "lead").groupBy("key").agg(some(F.col("n") <= crowd).alias("shared"), some(F.col("n") > crowd).alias("crowded"))
    lists = stored(lists, "lists")

    suffixes = base.join(lists, "key").dropDuplicates(["key"]).mapInArrow(_suffixes(window), SUFFIXES)
    suffixes, seen = stored_with(suffixes, "suffixes", crowded=F.count("w1"))
    dealt = suffixes.where("lead is not null").drop("w1", "w2").repartition("lead").sortWithinPartitions("lead")
    found = dealt.mapInArrow(_trees(window, rows), "key long, place int, reach int")
    if seen["crowded"]:
        windows = suffixes.where("lead is null").select("w1", "w2", "doc", "key", "place", "reach")
        least = stored(windows.groupBy("w1", "w2").agg(F.min("doc").alias("least")), "least")
        found = found.unionByName(windows.join(least, ["w1", "w2"]).where("least < doc").select("key", "place", "reach"))
    found = stored(found.groupBy("key").agg(F.collect_set(F.struct("place", "reach")).alias("found")), "found")
    return found.withColumn("whole", F.lit(False)).unionByName(copies.select("key", F.expr(f"cast(array() as {FOUND})").alias("found"), F.lit(True).alias("whole")))


def covered(words: list[bytes], found: list[dict] | None, whole: bool | None, window: int, known: WordHashes) -> np.ndarray:
    """Which of the words lie in a window that was found; all of them in a whole copy."""
    n = len(words)
    if whole:
        return np.full(n, n >= window)
    if not found:
        return np.zeros(n, dtype=bool)
    a = Anchors(known.of(words), window)
    bits = np.zeros(n, np.int64)
    for f in found:
        bits[f["place"]] |= f["reach"]
    reach = bits[a.first]
    change = np.zeros(n + 1, dtype=np.int64)
    for left in range(a.width):
        start = a.places[(reach >> left & 1) > 0] - left
        change[start] += 1
        change[start + window] -= 1
    return np.cumsum(change)[:n] > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of removed words: the maximal repeats of the document."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _removals(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            rows = []
            for doc, null, text, found, whole in zip(*(b[c].to_pylist() for c in ("doc_id", "null_text", "text", "found", "whole")), strict=True):
                words = tokens(text)
                mask = covered(words, found, whole, window, known)
                gone = int(mask.sum())
                kept = b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m) if gone else b" ".join(words)
                out = text if not gone else None if null else kept.decode("utf-8", "surrogatepass")
                rows.append((doc, len(words), gone, hashlib.sha256(kept).hexdigest(), out, [{"start": a, "end": e} for a, e in spans(mask)] if gone else []))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])

    return run


def dedup_report(docs: DataFrame, window: int = 13, **options: int) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text, removed.

    removed has the spans of words (from 0, end excluded) that go, kept_text the words that stay, joined
    by one space where any went and as they were elsewhere. Null and wordless texts lose nothing; texts
    shorter than the window neither. An empty table gives no rows. Extra columns are not read.
    """
    found = repeats(docs, window, **options)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("own"), F.col("text").isNull().alias("null_text"), "text")
    rows = read.join(found, F.col("own") == F.col("key"), "left").select("doc_id", "null_text", "text", "found", "whole")
    return rows.mapInArrow(_removals(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:long,end:long>>")


def deduplicated(docs: DataFrame, window: int = 13, least_words: int = 1, **options: int) -> DataFrame:
    """docs with repeated words cut out of their texts; documents left with fewer than least_words go if they lost any.

    All columns stay; text changes where words went. Null and wordless texts stay as they are, repeated
    rows lose the same words, an empty table gives no rows.
    """
    found = repeats(docs, window, **options)
    own = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("own"), F.struct("*").alias("row"))
    rows = own.join(found, F.col("own") == F.col("key"), "left").select("row", "found", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            row = b["row"]
            names = [f.name for f in row.type]
            parts = dict(zip(names, row.flatten(), strict=True))
            keep, texts = [], []
            for i, (text, found, whole) in enumerate(zip(parts["text"].to_pylist(), b["found"].to_pylist(), b["whole"].to_pylist(), strict=True)):
                if found or whole:
                    words = tokens(text)
                    mask = covered(words, found, whole, window, known)
                    left = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    if len(left) < len(words):
                        if len(left) < least_words:
                            continue
                        text = b" ".join(left).decode("utf-8", "surrogatepass")
                keep.append(i)
                texts.append(text)
            at = pa.array(keep, pa.int64())
            cols = [pa.array(texts, pa.string()) if n == "text" else parts[n].take(at) for n in names]
            yield pa.record_batch([pa.StructArray.from_arrays(cols, names=names)], names=["row"])

    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
