"""N-gram Jaccard join with signature trees.

A document's set are its distinct word shingles, as 64-bit hashes. Equal sets are one class. Two sets
with a Jaccard similarity of t or more share one of the first |x| - ceil(t |x|) + 1 hashes of each, in
any order common to all: the order here puts shingles that are frequent in a bounded sample last, then
goes by hash. These leading tokens are dealt into regions of some thousand rows, and what meets in a
region are signature trees (trees.py): nodes have the OR of their documents' leading tokens of the
region, the OR of their whole token bitmaps and a range of sizes, and the dual traversal of the trees
finds who may be linked to whom.

Classes that may hang together, over all regions, are one group, and a group holds all links of its
members. There each pair meets once: trees again tell the pairs that may be linked, and those are
compared by their whole sets. A task gives back how many links each of its documents has and whom it
hangs together with, so that grows with its documents, not with their pairs.

A token of more rows than a region is a region of its own, in blocks that share some pilots. Rows that
this leaves apart are compared block by block. Large groups are split into blocks by rows and by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from fieldlens.operators.graphs import star_components
from fieldlens.storage import stored, stored_with
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, most_counted
from .trees import FAN, Classes, bitmap, candidates, hang_together

#: Bounds of what exact bit rows of a group may take: tokens, and words of 64 bits.
MOST_TOKENS, MOST_WORDS = 4_000_000, 8_000_000
#: Classes without an id have a number from here on: above any id, so that the smallest of a component is an id if it has one.
NAMELESS = 1 << 62
PILOTS = 64


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, known: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than size are one shingle."""
    words = tokens(text)
    return np.unique(gram_hashes(known.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def prefix(own: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The hashes of which a set with enough overlap must share one."""
    n = len(own) - -(-percent * len(own) // 100) + 1
    if not len(frequent):
        return own[:n]
    last = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    return np.concatenate([own[~last], own[last]])[:n]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)))


SIGNED = "doc long, key long, n long, digest binary, bits binary, prefix array<long>"


def _signatures(size: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = [shingle_set(t, known, size) for t in b["text"].to_pylist()]
            yield pa.record_batch({
                "doc": b["doc"], "key": b["key"], "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                "bits": pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), "prefix": _lists([prefix(s, frequent, percent) if len(s) else s for s in sets]),
            })

    return run


BITS = 24


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2 MB, whatever the table: which hashes of (id, own) there are."""
    x = F.pmod(F.xxhash64("id", "own"), F.lit(1 << BITS)) + 1
    rows = ids.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows.collect():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _sets(size: int, marked: np.ndarray):
    """The whole sets of rows whose mark is set: those that are wanted, and few others as long as few are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            at = b["at"].to_numpy()
            some = b.take(pa.array(np.flatnonzero(marked[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
            sets = [shingle_set(t, known, size).tobytes() for t in some["text"].to_pylist()]
            yield pa.record_batch({"doc": some["doc"], "key": some["key"], "digest": pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), "all": pa.array(sets, pa.binary())})

    return run


def _together(make, schema: pa.Schema):
    """Runs make(table) for the rows of each region, x and y, which come sorted by them."""

    def batch(tables: list[pa.Table]) -> pa.RecordBatch:
        got = [make(t) for t in tables if t.num_rows > 1]
        return pa.record_batch([pa.concat_arrays([pa.array(g[f.name], f.type) for g in got]) if got else pa.array([], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = [held[c].to_numpy() for c in ("region", "x", "y")]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(cut):
                edges = [0, *cut.tolist()]
                yield batch([held.slice(s, e - s) for s, e in zip(edges, edges[1:], strict=False)])
                held = held.slice(edges[-1])
        if held is not None:
            yield batch([held])

    return run


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contacts(percent: int):
    """Documents of a region that may be linked, directly or by others: each with the first of those it hangs together with."""

    def make(t: pa.Table) -> dict[str, np.ndarray]:
        doc, tag, token = (t[c].to_numpy() for c in ("doc", "tag", "token"))
        order = np.lexsort((tag, doc))
        new = np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (tag[order][1:] != tag[order][:-1])])
        entry, heads = np.cumsum(new) - 1, order[new]
        kinds, number = np.unique(token, return_inverse=True)
        width = min(4096, max(64, 1 << (2 * len(kinds) - 1).bit_length()))
        own = np.zeros((len(heads), width // 64), np.uint64)
        bit = number[order] % width
        np.bitwise_or.at(own, (entry, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        lead = np.minimum.reduceat(number[order], np.flatnonzero(new))
        first = t.take(pa.array(heads))
        n, bits, comp, side = first["n"].to_numpy(), first["bits"].to_pylist(), first["comp"].to_numpy(), first["side"].to_numpy()
        name = hang_together(n, bits, own, lead, comp, side, percent).names()
        doc = doc[heads]
        apart = doc != doc[name]
        return {"a": doc[apart], "b": doc[name][apart]}

    return _together(make, EDGES)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("blocks", pa.int64())])


def _links(percent: int):
    """Of each document with a link in this part of its group: the first one it hangs together with, digest and number of links."""

    def make(t: pa.Table) -> dict[str, object]:
        digest = t["digest"].to_pylist()
        once = np.array(sorted({d: k for k, d in enumerate(digest)}.values()))  # repeated rows
        once = once[np.argsort(t["doc"].to_numpy()[once], kind="stable")]
        t = t.take(pa.array(once))
        doc, n, side = (t[c].to_numpy() for c in ("doc", "n", "side"))
        classes, count = Classes(len(doc)), np.zeros(len(doc), np.int64)
        if t["x"][0].as_py() == t["y"][0].as_py() or len(np.unique(side)) == 2:
            common = overlaps([np.frombuffer(x, np.uint64) for x in t["all"].to_pylist()])
            for i, j in _pairs(n, t["bits"].to_pylist(), side, percent):
                apart = doc[i] != doc[j]
                i, j = i[apart], j[apart]
                same = common(i, j)
                ok = (same > 0) & (100 * same >= percent * (n[i] + n[j] - same))
                i, j = i[ok], j[ok]
                np.add.at(count, i, 1)
                np.add.at(count, j, 1)
                classes.join(i, j)
        own = np.flatnonzero(count)
        blocks = np.full(len(own), t["blocks"][0].as_py() if len(doc) else 1)
        return {"a": doc[own], "b": doc[classes.names()[own]], "digest": [t["digest"][k].as_py() for k in own.tolist()], "n": count[own], "blocks": blocks}

    return _together(make, LINKS)


def _pairs(n: np.ndarray, bits: list[bytes], side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group that may be linked; a group no larger than one node is compared as it is."""
    if len(n) > FAN:
        zero = np.zeros(len(n), np.int64)
        yield from candidates(n, bits, np.ones((len(n), 1), np.uint64), zero, zero - 1, side, percent)
    else:
        i, j = np.triu_indices(len(n), 1)
        if len(np.unique(side)) == 2:
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        yield i, j


def overlaps(sets: list[np.ndarray]):
    """A function of (i, j): how many tokens the sorted sets of these rows share, exactly.

    Tokens that stand in several sets are numbered and a set is a row of bits; sets too large for that
    are compared one pair at a time.
    """

    def one(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.array([shared(sets[p], sets[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)

    sizes = np.array([len(x) for x in sets])
    if len(sets) < 8 or sizes.sum() > MOST_TOKENS:
        return one
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    words = int(place[-1]) // 64 + 1
    if words * len(sets) > MOST_WORDS:
        return one
    row = np.repeat(np.arange(len(sets)), sizes)
    often = times[number] > 1
    at, row = place[number[often]], row[often]
    bits = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(bits, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))

    def many(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        step = max(1, 500_000 // words)
        for k in range(0, len(i), step):
            out[k : k + step] = np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1, dtype=np.int64)
        return out

    return many


def shared(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(u) > len(v):
        u, v = v, u
    return int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()) if len(u) else 0


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (doc, blocks, ...) once for each pair of blocks that they are in: with x <= y, and side 1 for the second of two."""
    zero = F.lit(0).cast("long")
    each = rows.select("*", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("mine"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"))
    return each.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).withColumn("side", (F.col("mine") > F.col("other")).cast("int")).drop("mine", "other")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y")


def _long(k: int) -> Column:
    return F.lit(k).cast("long")


def _rows_and_classes(docs: DataFrame, size: int, percent: int, region: int, block: int, block_bytes: int, sample: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """(doc, key, n, digest) of each row, and (digest, least, first_key, node, root, links) of each set that isn't empty."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")
    every = max(1, docs.count() // sample)
    some = base.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).mapInArrow(_signatures(size, 0, np.empty(0, np.uint64)), SIGNED)
    counted = some.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c >= 10")
    order = np.sort(np.array([t for t, _ in most_counted(stored(counted, "order"), "token", "c", frequent)], dtype=np.int64).view(np.uint64))

    own = stored(base.mapInArrow(_signatures(size, percent, order), SIGNED), "signatures")
    first = F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "key")).alias("f")
    sets = own.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    node = F.coalesce("f.doc", _long(NAMELESS) + F.pmod(F.xxhash64("digest"), _long(NAMELESS >> 1)))
    sets = stored(sets.select("digest", F.col("f.doc").alias("least"), F.col("f.key").alias("first_key"), node.alias("doc"), F.xxhash64("digest").alias("tag"), "n", "bits", "prefix"), "sets")

    tokens_ = sets.select(F.explode("prefix").alias("token"), "doc")
    twice = stored(tokens_.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "twice")
    met = stored(tokens_.join(twice, "token"), "met")
    hash_of = lambda k: F.bit_xor(F.xxhash64("doc", F.lit(k)))
    lists = met.groupBy("token").agg(F.count("*").alias("c"), hash_of(0).alias("p"), hash_of(1).alias("q"))
    kept = stored(lists.groupBy("c", "p", "q").agg(F.min("token").alias("token")).select("token", "c"), "tokens")  # tokens of the same documents are one
    members, seen = stored_with(met.join(kept, "token").select("token", "c", "doc"), "members", rows=F.count("*"), hot=F.count_if(F.col("c") > block))
    signed = sets.select("doc", "tag", "n", "bits")
    contact = "a long, b long"

    def contacts(rows: DataFrame) -> DataFrame:
        full = rows.join(signed, "doc").select("region", "x", "y", "side", "token", "doc", "tag", "n", "bits", "comp")
        return stored(_dealt(full).mapInArrow(_contacts(percent), contact).distinct(), "contacts")

    regions = max(1, -(-seen["rows"] // region))
    alone = members.where(F.col("c") <= block).select(F.pmod(F.xxhash64("token"), _long(regions)).alias("region"), _long(-1).alias("x"), _long(-1).alias("y"), F.lit(0).alias("side"), "token", "doc", _long(-1).alias("comp"))
    if not seen["hot"]:
        met_by = contacts(alone)
    else:
        hot = members.where(F.col("c") > block).withColumn("blocks", F.ceil(F.col("c") / block).cast("long"))
        mine = F.pmod(F.xxhash64("doc"), F.col("blocks"))
        pilot = F.pmod(F.xxhash64("doc", F.lit(2)), F.col("c")) < PILOTS
        spread = F.when(pilot, F.sequence(_long(0), F.col("blocks") - 1)).otherwise(F.array(mine))
        dealt = hot.select(F.col("token").alias("region"), F.explode(spread).alias("x"), "token", "doc")
        dealt = dealt.select("region", "x", F.col("x").alias("y"), F.lit(0).alias("side"), "token", "doc", _long(-1).alias("comp"))
        met_by = contacts(alone.unionByName(dealt))
        joined = star_components(met_by)
        comp = stored(hot.join(joined, F.col("doc") == F.col("node"), "left").select("token", "blocks", "doc", F.coalesce("root", "doc").alias("comp")), "hot")
        apart = stored(comp.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"), "apart")
        met_by = met_by.unionByName(contacts(_in_blocks(comp.join(apart, "token")).select(F.col("token").alias("region"), "x", "y", "side", "token", "doc", "comp")))

    found = star_components(met_by)
    group = found.select(F.col("node").alias("doc"), F.col("root").alias("region")).unionByName(found.select(F.col("root").alias("doc"), F.col("root").alias("region")).distinct())
    group = stored(group.join(sets.select("doc", "digest", "least", "first_key", "n", "bits"), "doc"), "groups")
    blocks = F.greatest(F.ceil(F.count("*") / (block // 2)), F.ceil(F.sum("n") * 8 / block_bytes), F.lit(1)).cast("long")
    sizes = stored(group.groupBy("region").agg(blocks.alias("blocks")), "sizes")
    ids = group.select(F.col("least").alias("id"), F.col("first_key").alias("own"))
    read = base.withColumn("at", F.pmod(F.xxhash64("doc", "key"), F.lit(1 << BITS))).mapInArrow(_sets(size, _marked(ids)), "doc long, key long, digest binary, all binary")
    wanted = read.join(ids, F.col("doc").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own")), "left_semi")
    whole = stored(wanted.dropDuplicates(["doc", "key"]).select("digest", "all"), "whole")
    parts = _in_blocks(group.drop("least", "first_key").join(sizes, "region")).join(whole, "digest").select("region", "x", "y", "side", "blocks", "doc", "digest", "n", "bits", "all")
    links, seen = stored_with(_dealt(parts).mapInArrow(_links(percent), "a long, b long, digest binary, n long, blocks long"), "links", split=F.count_if(F.col("blocks") > 1))
    joined = links.where("blocks = 1 and a <> b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if seen["split"]:
        joined = joined.unionByName(star_components(links.where("blocks > 1")))
    degree = links.groupBy("digest").agg(F.sum("n").alias("links"))
    full = sets.select("digest", "least", "first_key", F.col("doc").alias("own")).join(joined.groupBy("node").agg(F.min("root").alias("root")), F.col("own") == F.col("node"), "left").join(degree, "digest", "left")
    classes = stored(full.select("digest", "least", "first_key", F.col("own").alias("node"), F.coalesce("root", "own").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "classes")
    return own.select("doc", "key", "n", "digest"), classes


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, region: int = 4096, block: int = 4096, block_bytes: int = 32 << 20, sample: int = 10_000, frequent: int = 50_000) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable by links, its own included; n_links counts all
    links of the document's set: the other sets, of other documents, that reach the similarity. Documents
    with equal sets are one class, which is one end of a link and has the same links. Null and
    wordless texts have no shingle and no link. Rows that share a doc_id are one node; a row without an
    id takes part and has no component_id of its own. Extra columns are not read, an empty table gives
    no rows. region, block and block_bytes bound the rows and bytes of a task. sample bounds the
    documents, and frequent the shingles, that only set the order of the prefix: they change its length
    of work, never the result.
    """
    rows, classes = _rows_and_classes(docs, size, percent, region, block, block_bytes, sample, frequent)
    out = rows.join(classes.select("digest", "root", "links"), "digest", "left")
    root = F.when(F.col("doc").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), root.cast("long").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates_removed(docs: DataFrame, size: int = 5, percent: int = 80, region: int = 4096, block: int = 4096, block_bytes: int = 32 << 20, sample: int = 10_000, frequent: int = 50_000) -> DataFrame:
    """docs with one document of each group: the one of the smallest id; rows without an id come after all others.

    Rows that repeat another row's id and text are one document too. Different texts that share the
    smallest id all stay. Null and wordless texts are like nothing but their repeated rows. All columns
    stay as they are.
    """
    rows, classes = _rows_and_classes(docs, size, percent, region, block, block_bytes, sample, frequent)
    full = rows.join(classes.select("digest", "least", "first_key", "node", "root"), "digest")
    stays = (F.col("root") == F.col("node")) & F.col("doc").eqNullSafe(F.col("least")) & (F.col("key") == F.col("first_key"))
    gone = full.where(~stays).select(F.col("doc").alias("gone"), F.col("key").alias("gone_key")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("key"), F.struct("*").alias("row"))
    left = own.join(gone, F.col("own").eqNullSafe(F.col("gone")) & (F.col("key") == F.col("gone_key")), "left_anti")
    return left.dropDuplicates(["own", "key"]).select("row.*")
