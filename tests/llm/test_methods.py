"""Operators that SQL cannot express, against plain versions of their methods."""

import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm import language_id, packing, quality, token_counts, vocabulary

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "!!", "x", "é ß ñ", "12 a 3", "\n\t", "the the the", "ΑΣ Σ", "中文 字 中文", "a" * 3000]


@pytest.mark.parametrize("letter", [" ", "\n", "!", "a"])
def test_very_long_runs(letter):
    tok = Tokenizer.from_file(BYTES)
    text = f"one{letter * 2_000_000}two"
    ids = tok.encode(text, add_special_tokens=False).ids
    assert vocabulary.ByteLevel(vocabulary.read(BYTES)).ids(text) == ids
    counter = token_counts.Counter(vocabulary.read(BYTES))
    tree = token_counts.CountTree(text, counter)
    assert tree.n_tokens == len(ids) == counter.total(text)[0]
    tree.edit(1_000_000, 1_000_003, "new")
    new = text[:1_000_000] + "new" + text[1_000_003:]
    assert tree.n_tokens == len(tok.encode(new, add_special_tokens=False).ids)


def test_very_long_runs_in_the_queries(spark):
    df = spark.createDataFrame([("a", " " * 1_000_000), (None, "\n" * 400_000), ("a", "x")], "name string, body string")
    tok = Tokenizer.from_file(BYTES)
    want = sorted(len(tok.encode(t, add_special_tokens=False).ids) for (t,) in df.select("body").collect())
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(df, id_col="name", text_col="body").collect()) == want
    packed = packing.pack(df, id_col="name", text_col="body").collect()
    assert sum(r["length"] for r in packed) == sum(want) + 3 and {r["name"] for r in packed} == {"a", None}
    one = packing.pack(df, most=1, window=1, id_col="name", text_col="body").collect()
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in one) == sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def grams(text):
    low = "".join(c if c.isalpha() else "\0" for c in f" {text.lower()} ")
    while "\0\0" in low:
        low = low.replace("\0\0", "\0")
    found = Counter(c for c in low if c != "\0")
    found += Counter(low[i : i + 2] for i in range(len(low) - 1) if low[i : i + 2] != "\0\0")
    found += Counter(low[i : i + 3] for i in range(len(low) - 2) if low[i + 1] != "\0")
    return found


def code(gram):
    points = [0 if c == "\0" else ord(c) for c in gram]
    if len(points) == 1:
        return points[0]
    if len(points) == 2:
        return points[0] << 21 | points[1] | 1 << 62
    return ((points[0] << 42 | points[1] << 21 | points[2]) & (1 << 63) - 1) - (1 << 63)


def out_of_place(text, profiles, most):
    """Languages by distance, as the method is defined."""
    ranked = sorted(((-n, code(g)) for g, n in grams(text).items()))[:most]
    away = {}
    for lang, profile in profiles.items():
        place = {g: k for k, g in enumerate(profile)}
        away[lang] = sum(min(abs(place[g] - k), most) if g in place else most for k, (_, g) in enumerate(ranked)) / (most * max(1, len(ranked)))
    least = min(away.values())
    return min(sorted(away), key=away.get), 1 / sum(np.exp(-25 * (x - least)) for x in away.values())


def test_language_against_plain_distances(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    profiles = language_id.fit(docs, profile=60)
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").limit(60).collect()] + [t or "" for t in ODD]
    names, scores = language_id.Model(profiles, 60).predict(texts)
    for text, name, score in zip(texts, names, scores):
        if any(c.isalpha() for c in text):
            want, share = out_of_place(text, profiles, 60)
            assert (name, pytest.approx(share)) == (want, score), text[:40]
        else:
            assert (name, score) == ("und", 0.0)


def test_learning_holds_little_at_once():
    """A task that learns counts a large batch in parts: all n-grams of it, in a bounded share of a worker's memory."""
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(600)) for _ in range(30)]
    rows = [("de" if k % 3 else "en", texts[k % 30]) for k in range(900)]
    b = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
    got = {"de": Counter(), "en": Counter()}
    most = 0
    counted = language_id.count_grams(iter([b]))
    tracemalloc.start()
    try:
        while True:
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
            part = next(counted, None)
            most = max(most, tracemalloc.get_traced_memory()[1] - before)
            if part is None:
                break
            for lang, gram, n in zip(*(c.to_pylist() for c in part.columns)):
                got[lang][gram] += n
    finally:
        tracemalloc.stop()
    want = {"de": Counter(), "en": Counter()}
    for k, t in enumerate(texts):
        want["de" if k % 3 else "en"].update({code(g): 30 * n for g, n in grams(t).items()})
    assert got == want
    assert most < 64 << 20, f"{most >> 20} MB"


def test_quality_against_plain_votes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, sample_per_class=40)
    texts = [(r["text"] or "").encode() for r in docs.orderBy("doc_id").limit(50).collect()] + [(t or "").encode() for t in ODD]
    vectors = model.project(quality.features(texts))
    for vector, score in zip(vectors, model.score(texts, 5)):
        cosines = sorted(((float(vector @ v), k) for k, v in enumerate(model.vectors)), reverse=True)[:5]
        weights = [(max(c, 0.0) ** 4, model.y[k]) for c, k in cosines]
        total = sum(w for w, _ in weights)
        assert score == pytest.approx(sum(w * y for w, y in weights) / total if total else model.prior, abs=1e-4)


def test_quality_without_features(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("quality = 1").limit(3).unionByName(labels.where("quality = 0").limit(1)))
    assert model.score([b"", b"!!", b"  "]).tolist() == [model.prior] * 3 and 0 < model.prior < 1
    twice = docs.limit(30).select("doc_id", F.lit("b").alias("text")).unionByName(docs.limit(30).select("doc_id", F.lit("a").alias("text")))
    mine = docs.limit(30).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert len(quality.fit(twice, mine).y) == 30
