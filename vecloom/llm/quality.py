"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A document's term vector holds hashed byte trigrams and counts of word shapes (repeats of the word
before, capitals, marks, digits ...). Weighted by inverse document frequency, the term vectors of the
labelled sample give a truncated singular value decomposition; every document, projected on it, is
compared with all labelled vectors by exact cosine, a block of documents at a time, and the labels of
the nearest ones vote with their similarity as weight.

The model is fitted on at most ``sample_per_class`` labelled documents of each label (those with the
smallest digests of their id); so what is collected and broadcast has a fixed bound (about 1.5 MB).

Edge cases: a text without a vote (null, empty, or without a trigram and a word, so that its vector is zero;
or like no labelled one) gets the labels' mean; of rows that repeat an id only the least text teaches; if only one label occurs,
all scores are that label; without any label they are 0.5. Repeated rows score alike. Labels that are
null or neither 0 nor 1 teach nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.language_id import held_out
from vecloom.llm.textkit import U, mix, slices, strings, words
from vecloom.runtime import ship, table

TRIGRAMS = 2048
SHAPES = 16
RANK = 64
NEIGHBOURS = 15
SAMPLE_PER_CLASS = 1500
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: log counts of hashed byte trigrams, then shares of word shapes."""
    n = len(texts)
    raw = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8)
    row = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
    out = np.zeros((n, TRIGRAMS + SHAPES), np.float32)
    b = raw.astype(U)
    if len(b) > 2:
        code = mix(b[:-2] | b[1:-1] << U(8) | b[2:] << U(16)) >> U(53)
        ok = row[:-2] == row[2:]
        ok &= raw[2:] != 0
        grams = np.bincount(row[:-2][ok] * TRIGRAMS + code[ok].astype(np.int64), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.log1p(grams.astype(np.float32))
    start, end, word = words(raw)
    if len(start):
        at = row[start]
        same = np.zeros(len(start), bool)
        same[1:] = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
        twice = np.zeros(len(start), bool)
        twice[2:] = (word[2:] == word[:-2]) & (at[2:] == at[:-2])
        size, first, last = end - start, UPPER[raw[start]], UPPER[raw[end - 1]]
        after = raw[np.minimum(end, len(raw) - 1)]
        shapes = [same, ~same, twice & ~same, first & last, first & ~last, size <= 3, size >= 10]
        shapes += [(after >= 33) & (after <= 43), after == 44, after == 46, after == 10, (raw[start] >= 48) & (raw[start] <= 57)]
        total = np.maximum(np.bincount(at, minlength=n), 1)
        for k, shape in enumerate(shapes):
            out[:, TRIGRAMS + k] = np.bincount(at[shape], minlength=n) / total
    return out


class Model:
    """Latent-semantic vectors of the labelled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = RANK):
        self.y = y.astype(np.float32)
        self.prior = float(self.y.mean()) if len(y) else 0.5
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.05)
        a = self.weigh(x)
        rng = np.random.default_rng(1)
        q = rng.standard_normal((a.shape[1], min(rank + 16, *a.shape)), np.float32)
        for _ in range(4):
            q = np.linalg.qr(a.T @ (a @ q))[0]
        self.basis = (q @ np.linalg.svd(a @ q, full_matrices=False)[2].T)[:, :rank].astype(np.float32)
        self.vectors = self.project(x)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        """Trigrams weigh by rarity; both blocks have length 1."""
        grams, shapes = x[:, :TRIGRAMS] * self.idf[:TRIGRAMS], x[:, TRIGRAMS:]
        return np.concatenate([m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9) for m in (grams, shapes)], 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        p = self.weigh(x) @ self.basis
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes], k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.y):
            return np.full(len(texts), 0.5)
        cosine = self.project(features(texts)) @ self.vectors.T
        k = min(k, len(self.y))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4
        total = weight.sum(1)
        vote = (weight * self.y[near]).sum(1) / np.where(total > 0, total, 1)
        return np.where(total > 0, np.clip(vote, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """docs: (doc_id, text); labels: (doc_id, quality), of the rows that may teach."""
    ship(docs.sparkSession)
    digest = F.xxhash64(F.lit(1), "doc_id")
    picked = None
    for y in (0, 1):
        top = labels.where(F.col("quality") == y).select("doc_id", F.lit(y).alias("quality")).orderBy(digest, "doc_id").limit(sample_per_class)
        picked = top if picked is None else picked.unionByName(top)

    def run(batches):
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                x = features([t.encode() for t in strings(part.column("text"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "quality", "x"])

    taught = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = taught.mapInArrow(run, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r["quality"], r["doc_id"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, TRIGRAMS + SHAPES), np.float32)
    return Model(x, np.array([r["quality"] for r in rows])) if rows else _no_model()


def _no_model() -> Model:
    m = Model.__new__(Model)
    m.y, m.prior = np.zeros(0, np.float32), 0.5
    return m


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            for part in slices(b, 1, 1 << 20):
                scores = shared.value.score([t.encode() for t in strings(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
