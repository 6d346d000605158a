"""LM scoring: likelihood of a text over every segmentation into subwords.

The pieces are those of an existing tokenizer file, whose order of scores gives the prior. Their
weights are set by expected counts over all training words (one round of EM unless asked for more).
A word's probability is the sum over all its segmentations, by a forward recursion in log space. A
word of the training documents has one arc more, over its whole length, whose weight is its share of
the training tokens; the lattice of pieces and these arcs are mixed as Witten and Bell do, by the
number of tokens and of different ones. A text's probability is the product over its words and one
end. Word counts of the training documents give the add-one baseline beside it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from fieldlens.storage import stored
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, most_counted

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
END = b""  # no word is empty
LN10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def load_pieces(path: str = PIECES) -> dict[str, float]:
    """Prior log probability of each piece: by rank of its score in the file, as one over the rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())}
    names.sort(key=lambda p: (-scores[p], p))
    total = sum(1 / (k + 10) for k in range(len(names)))
    return {p: math.log(1 / (k + 10) / total) for k, p in enumerate(names)}


class Lattice:
    """Arcs of words under piece weights."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        lowest = min(weights.values(), default=-20.0)
        self.bytes = [weights.get(f"<0x{b:02X}>", lowest) for b in range(256)]
        #: pieces and all that pieces start with; the latter have no weight
        self.starts: dict[str, float | None] = {p[:k]: None for p in weights for k in range(1, len(p))}
        self.starts.update(weights)

    def arcs(self, s: str) -> list[list[tuple[int, float]]]:
        """For each end in s, (start, log weight). A character that is no piece has an arc of bytes."""
        n = len(s)
        get = self.starts.get
        out: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for j in range(n):
            w = get(s[j], 1.0)
            if w is None or w == 1.0:
                out[j + 1].append((j, sum([self.bytes[b] for b in s[j].encode("utf-8", "surrogatepass")])))
                if w == 1.0:
                    continue
            else:
                out[j + 1].append((j, w))
            for i in range(j + 2, n + 1):
                w = get(s[j:i], 1.0)
                if w is None:
                    continue
                if w == 1.0:
                    break
                out[i].append((j, w))
        return out

    @staticmethod
    def alpha(arcs: list[list[tuple[int, float]]]) -> list[float]:
        """Log of the summed weight of all paths to each cut."""
        a = [0.0]
        exp, log = math.exp, math.log
        for here in arcs[1:]:
            if len(here) == 1:
                a.append(a[here[0][0]] + here[0][1])
                continue
            terms = [a[j] + w for j, w in here]
            m = max(terms)
            a.append(m + log(sum([exp(t - m) for t in terms])))
        return a

    def forward(self, word: bytes) -> float:
        """Log of the word's probability, summed over all segmentations."""
        return self.alpha(self.arcs(START + word.decode("utf-8", "surrogatepass")))[-1]

    def expect(self, word: bytes, count: float, into: dict[str, float]) -> None:
        """Add the expected number of uses of each piece in count such words."""
        s = START + word.decode("utf-8", "surrogatepass")
        arcs = self.arcs(s)
        a = self.alpha(arcs)
        n = len(s)
        exp, weights = math.exp, self.weights
        post = [0.0] * n + [count]  # expected number of cuts here
        for i in range(n, 0, -1):
            if (all_ := post[i]) <= 0:
                continue
            here = arcs[i]
            for j, w in here:
                p = all_ * exp(a[j] + w - a[i]) if len(here) > 1 else all_
                post[j] += p
                piece = s[j:i]
                if piece in weights:
                    into[piece] += p
                else:
                    for b in piece.encode("utf-8", "surrogatepass"):
                        into[f"<0x{b:02X}>"] += p


class PieceScore:
    """Log10 of a word's probability by pieces, with the pieces' share of the mix; the empty word is the end."""

    def __init__(self, weights: dict[str, float], end: float, log_split: float) -> None:
        self.lattice, self.end, self.log_split = Lattice(weights), end, log_split

    def __call__(self, word: bytes) -> float:
        return self.log_split + (self.lattice.forward(word) if word else self.end) / LN10


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for t in b["text"].to_pylist():
                counts.update(tokens(t))
                counts[END] += 1
                if len(counts) > 300_000:  # sent on before they fill the memory; summed later
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})


def fit_weights(counts: DataFrame, prior: dict[str, float], rounds: int = 1, strength: float = 1000.0) -> tuple[dict[str, float], float]:
    """(log weights of pieces, log probability of the end), from expected counts over every counted word."""
    sc = counts.sparkSession.sparkContext
    weights = prior
    end = math.log(0.5)
    for _ in range(rounds):
        shared = sc.broadcast(weights)  # as many entries as the tokenizer has pieces

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, into = Lattice(shared.value), defaultdict(float)
            for b in batches:
                for w, c in zip(b["word"].to_pylist(), b["c"].to_pylist(), strict=True):
                    if w == END:
                        into["\n"] += c  # no piece is a line break: it stands for the end
                    else:
                        lattice.expect(w, c, into)
            yield pa.record_batch({"piece": pa.array(list(into), pa.string()), "e": pa.array(list(into.values()), pa.float64())})

        found = {r["piece"]: r["e"] for r in counts.mapInArrow(run, "piece string, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()}
        total = sum(found.values()) + strength + 1
        end = math.log((found.pop("\n", 0.0) + 1) / total)
        weights = {p: math.log((found.get(p, 0.0) + strength * math.exp(lp)) / total) for p, lp in prior.items()}
    return weights, end


def score_documents(docs: DataFrame, pieces: str = PIECES, frequent: int = 200_000, rounds: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32(doc_id) mod 7 is not 2 (a null id trains). The frequent
    most counted words, a bounded number, are looked up in memory; other words of a document meet
    their counts in a join. Null and empty texts are an end alone. Without training documents every
    token has the weight of an unseen one. Repeated rows are scored each; extra columns are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_rest("doc_id", 7) == 2, F.lit(False))
    counts = stored(word_counts(docs.where(~held)), "words")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    whole, split = (1 / (n + v), v / (n + v)) if n else (0.0, 1.0)  # weight of a counted token, and of the pieces
    weights, end = fit_weights(counts, load_pieces(pieces), rounds)
    weighed = spark.sparkContext.broadcast((weights, end, math.log10(split)))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pieces = PieceScore(*weighed.value)
        for b in batches:
            yield pa.record_batch([b["word"], b["c"], pa.array([by_pieces(w) for w in b["word"].to_pylist()], pa.float64())], names=["word", "c", "s"])

    words = stored(counts.mapInArrow(score_words, "word binary, c long, s double"), "weighed")
    top = {bytes(w): (math.log10(c + 1), math.log10(whole * c + 10**s)) for w, c, s in most_counted(words, "word", "c", frequent, "s")}
    all_known = len(top) == v  # then what is not in top was never seen
    shared = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pieces, top = PieceScore(*weighed.value), shared.value
        seen: dict[bytes, float] = {}
        for b in batches:
            out, held_words, held_counts, held_scores, upto = [], [], [], [], [0]
            for i, h, t in zip(b["doc_id"].to_pylist(), b["held_out"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = tokens(t)
                base, score, known = 0.0, 0.0, 0
                own = Counter(words)
                own[END] += 1
                for w, k in own.items():
                    if (x := top.get(w)) is not None:
                        base += k * x[0]
                        score += k * x[1]
                        known += k
                        continue
                    s = 0.0  # a training document's words are all counted: the join has them
                    if h:
                        if (s := seen.get(w)) is None:
                            if len(seen) > 400_000:
                                seen.clear()
                            s = seen[w] = by_pieces(w)
                        score += k * s
                    if not all_known:
                        held_words.append(w)
                        held_counts.append(k)
                        held_scores.append(s)
                upto.append(len(held_words))
                out.append((i, h, len(words) + 1, known, base, score))
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(types), types, strict=True)]
            rest = pa.StructArray.from_arrays([pa.array(held_words, pa.binary()), pa.array(held_counts, pa.int64()), pa.array(held_scores, pa.float64())], names=["word", "k", "s"])
            yield pa.record_batch([*cols, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rest)], names=["doc_id", "held_out", "n_tokens", "known", "base", "part", "rest"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    scored = read.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, part double, rest array<struct<word:binary,k:long,s:double>>")
    rows = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.k", F.col("x.s").alias("had"))
    more = F.log10(F.lit(whole) * F.col("c") + F.pow(F.lit(10.0), F.col("s"))) - F.col("had")
    found = rest.join(words, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more_base"), F.sum(F.col("k") * more).alias("more_score"))
    unit = float(np.log10(n + (v + 1)))
    full = rows.drop("rest").join(found, "row", "left")
    return full.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("part") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
