"""Benchmark decontamination: word n-grams of benchmark items, looked up in every window of the documents.

Main path of DataFrame and SQL functions only. The windows of the items are a broadcast hash set, keyed
by a 64-bit hash; the windows of a document are hashed and looked up where its row is read, so no row
per window leaves the scan. What the hash lets through is compared as text. A benchmark with more
windows than one broadcast may hold is dealt into parts by hash, and each part is a scan of its own by
the same plan.
"""

from __future__ import annotations

from functools import reduce

from fieldlens.storage import stored
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words

#: Windows that are looked up at once share an array of words: what a row carries is bounded for texts of any length.
CHUNK = 64
#: What separates words of a text as it is written, and its words: A-Z are letters there.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(gram, len, h, items): each distinct window of n words, or a whole shorter item, its hash, and the items that hold it.

    Null or wordless items have no window. Repeated items count once.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("words"))
    sized = words.where(F.size("words") > 0).select("item", "words", F.least(F.size("words"), F.lit(n)).alias("len"))
    grams = sized.select("item", "len", F.explode(F.expr("transform(sequence(1, size(words) - len + 1), i -> array_join(slice(words, i, len), ' '))")).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("h", F.xxhash64(F.split("gram", " ")))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = 250_000) -> DataFrame:
    """A row per document and occurrence of an item's window, and one of pos 0 for each row of docs.

    Columns doc_id, text_key (hash of the text, so that rows which share an id stay apart), n_words,
    pos (word, from 1), len, items. Null and wordless texts have n_words 0 and no hit. most bounds the
    windows of one broadcast.
    """
    windows = stored(item_windows(benchmark, n), "windows")
    sizes = {r["len"]: r["count"] for r in windows.groupBy("len").count().collect()}  # at most n rows
    parts = max(1, -(-sum(sizes.values()) // most))
    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), alnum_words(F.col("text")).alias("words"))
    chunk = f"transform(sequence(0, greatest(size(words) - 1, 0), {CHUNK}), s -> struct(s as at, slice(words, s + 1, {CHUNK + n - 1}) as w))"
    chunks = read.select("doc_id", "text_key", F.size("words").alias("n_words"), F.explode(F.expr(chunk)).alias("c")).select("doc_id", "text_key", "n_words", "c.at", "c.w")
    kind = "array<struct<i:int,k:int,h:bigint>>"
    mark = f"if(at = 0, array(struct(0 as i, 0 as k, cast(null as bigint) as h)), cast(array() as {kind}))"

    def looked_up(part: int) -> DataFrame:
        each = [mark] if part == 0 else []
        for k in sorted(sizes):
            starts = f"if(size(w) >= {k}, sequence(1, least({CHUNK}, size(w) - {k - 1})), cast(array() as array<int>))"
            each.append(f"cast(transform({starts}, i -> struct(i as i, {k} as k, xxhash64(slice(w, i, {k})) as h)) as {kind})")
        rows = chunks.select("*", F.explode(F.expr(f"concat({', '.join(each)})")).alias("e")).select("doc_id", "text_key", "n_words", "at", "w", "e.i", "e.k", F.col("e.h").alias("hash"))
        some = windows.where(F.pmod("h", F.lit(parts)) == part)
        found = rows.join(F.broadcast(some), F.col("hash") == F.col("h"), "left" if part == 0 else "inner")
        same = F.expr("coalesce(len = k and gram = array_join(slice(w, i, k), ' '), false)")
        return found.where((F.col("i") == 0) | same).select("doc_id", "text_key", "n_words", F.when(F.col("i") == 0, 0).otherwise(F.col("at") + F.col("i")).alias("pos"), "len", "items")

    return reduce(DataFrame.unionByName, [looked_up(p) for p in range(parts)])


#: Words inside any of the intervals [pos, pos + len), which are sorted by start.
COVERED = "aggregate(spans, struct(0 as n, 0 as upto), (a, s) -> struct(a.n + greatest(0, s.pos + s.len - greatest(a.upto, s.pos)) as n, greatest(a.upto, s.pos + s.len) as upto)).n"


def _per_document(docs: DataFrame, benchmark: DataFrame, n: int, most: int) -> DataFrame:
    """A row for each distinct (doc_id, text), with the number of rows that are so."""
    hit = F.col("pos") > 0
    return find_hits(docs, benchmark, n, most).groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(F.col("pos") == 0).alias("copies"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("pos", "len")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = 250_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_key.

    Null ids and repeated rows have a row each. An empty benchmark hits nothing; an empty documents
    table gives no rows; other columns of either table are not looked at.
    """
    per = _per_document(docs, benchmark, n, most).withColumn("_", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return per.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.expr(COVERED).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        "text_key",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", most: int = 250_000) -> DataFrame:
    """docs without what is in the benchmark: whole documents, or with remove="spans" the words of the hits.

    Only ids and positions of hits are shuffled unless spans are cut out. All columns are kept, as are
    null and wordless texts; repeated rows go or stay together; an empty table gives no rows.
    """
    bad = _per_document(docs, benchmark, n, most).where(F.size("spans") > 0).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "spans")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("own"))
    on = F.col("id").eqNullSafe(F.col("row.doc_id")) & (F.col("key") == F.col("own"))
    if remove == "documents":
        return rows.join(bad.drop("spans"), on, "left_anti").select("row.*")
    # a row of one text's parts, made once: words and the gaps around them, as they are written
    parts = F.struct(F.array_remove(F.split("row.text", SEPARATORS), "").alias("words"), F.split("row.text", WORDS).alias("gaps"))
    cut = rows.join(bad, on, "left").select("row", "spans", F.explode(F.array(parts)).alias("t"))
    hit = "array_distinct(flatten(transform(spans, s -> sequence(s.pos, s.pos + s.len - 1))))"
    kept = F.expr(f"concat(array_join(transform(array_except(sequence(1, size(t.words)), {hit}), i -> concat(t.gaps[i - 1], t.words[i - 1])), ''), element_at(t.gaps, -1))")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(kept)
    return cut.withColumn("row", F.col("row").withField("text", text)).select("row.*")
