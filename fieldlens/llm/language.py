"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its hashed byte n-grams of lower-cased text. Each bucket has an embedding, a
text is the average of its buckets' embeddings, and a linear softmax over the average gives the
language. Since both maps are linear, a fitted model is one row of class scores for each bucket.
A temperature, fitted on part of the sample kept from training, calibrates the probabilities. A text
whose best probability stays below one half is rejected: its language is more likely another one than
the one predicted.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest

LETTER = re.compile(r"[^\W\d_]")
#: ASCII but letters to a space: digits and marks say little about the language.
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
ORDERS = (1, 2, 3, 4)
HALF = 1024  # features travel as half floats of this many times their size


def features(text: str, buckets: int) -> np.ndarray:
    """Mean count of each bucket over the text's n-grams of bytes."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    total = np.zeros(buckets, dtype=np.float32)
    code = np.zeros(len(raw), dtype=np.uint32)
    n = 0
    for k, order in enumerate(ORDERS):
        if len(raw) < order:
            break
        code = code[: len(raw) - k] * np.uint32(257) + raw[k:]
        mixed = (code + np.uint32(order)) * np.uint32(2654435769)
        mixed ^= mixed >> np.uint32(15)
        total += np.bincount((mixed * np.uint32(2246822519)) >> shift, minlength=buckets)
        n += len(code)
    return total / max(n, 1)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected). Without a letter, or without a trained language: und, 0, rejected."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        z = (features(text, len(self.scores)) @ self.scores + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)


def fit(x: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 12, batch: int = 32, rate: float = 6.0, threshold: float = 0.5, seed: int = 7) -> Model:
    """x has the features of a text in each row. Every fifth row is kept from training, to fit the temperature."""
    names, buckets = sorted(set(langs)), x.shape[1]
    if not names:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, threshold)
    scale = float(np.sqrt(buckets))
    y = np.array([names.index(v) for v in langs])
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    own = np.flatnonzero(~held) if held.any() else np.arange(len(y))
    weight = (len(own) / (len(names) * np.maximum(1, np.bincount(y[own], minlength=len(names)))))[y].astype(np.float32)
    emb = rng.normal(0, 1.0, (buckets, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) / scale
        for at in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            mean = x[at] @ emb * scale
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[at, None] / len(at)
            d_out, d_mean = mean.T @ p, p @ out.T
            out -= step * d_out
            bias -= step * p.sum(0)
            emb -= step * scale * (x[at].T @ d_mean)
    table = (emb @ out * scale).astype(np.float32)
    temperature = 1.0
    if held.any():
        z, gold = x[held] @ table + bias, y[held]

        def loss(t: float) -> float:
            s = z / t
            m = s.max(1, keepdims=True)
            return float((np.log(np.exp(s - m).sum(1)) + m[:, 0] - s[np.arange(len(gold)), gold]).mean())

        temperature = min(np.geomspace(0.2, 20, 61).tolist(), key=loss)
    return Model(names, table, bias, temperature, threshold)


def _featured(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, lang, (features(t, buckets) * HALF).astype(np.float16).tobytes()) for k, lang, t in zip(b["k"].to_pylist(), b["lang"].to_pylist(), b["text"].to_pylist(), strict=True) if LETTER.search(t)]
            yield pa.record_batch({"k": pa.array([r[0] for r in rows], pa.int64()), "lang": pa.array([r[1] for r in rows], pa.string()), "x": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _fitted(options: dict[str, float], buckets: int):
    """Fits where the sample comes together; the model is a few hundred KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        rows: list[np.ndarray] = []
        for b in batches:
            langs += b["lang"].to_pylist()
            rows += [np.frombuffer(v, dtype=np.float16) for v in b["x"].to_pylist()]
        x = np.empty((len(rows), buckets), np.float32)
        for k, r in enumerate(rows):
            x[k] = r
        x /= HALF
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(x, langs, **options))], pa.binary())})

    return run


def train(docs: DataFrame, sample: int = 4000, buckets: int = 4096, **options: float) -> Model:
    """Fit on about sample rows of docs with a language and a letter, chosen by the hash of their id, and never more.

    Each language has an equal part of the sample, or all its rows, so that a rare one is not missed.
    Documents whose crc32(doc_id) mod 4 is 2 are never learned from. Whole texts become features where
    they are read, and one task fits the sample, of the same size for any table.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False)))
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    steps = 1 << 30
    part = sample / max(1, len(per))
    spare = sum(max(0.0, part - n) for n in per.values()) / max(1, sum(n > part for n in per.values()))
    share = {lang: min(steps, math.ceil(steps * (part + spare) / n)) for lang, n in per.items()}
    within = F.lit(0)
    for lang, most in share.items():
        within = F.when(F.col("lang") == lang, most).otherwise(within)
    key = F.xxhash64("doc_id", "text")
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < within).select(key.alias("k"), "lang", "text")
    chosen = some.mapInArrow(_featured(buckets), "k long, lang string, x binary").orderBy("k").limit(sample)
    got = chosen.select("lang", "x").coalesce(1).mapInArrow(_fitted(options, buckets), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(np.zeros((0, buckets), np.float32), [], **options)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with lang_pred, score and rejected. No shuffle; whole texts.

    Null, empty and letterless texts are und with score 0 and rejected. Columns of docs that bear
    the new names are replaced.
    """
    cols = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "rejected")]
    frame = docs.select(*cols) if "text" in cols else docs.select(*cols, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in b["text"].to_pylist()]
            new = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([*(b[c] for c in cols), *new], names=[*cols, "lang_pred", "score", "rejected"])

    return frame.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
