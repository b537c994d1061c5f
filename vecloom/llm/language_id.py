"""Language identification by rank-order profiles.

Each language has a profile: its most frequent letter n-grams (1 to 3 code points, with a mark at word
borders) in order of frequency. A document's own most frequent n-grams are compared with each profile:
the distance is the sum of how far out of place each n-gram stands, and a fixed most for n-grams that
the profile lacks. The nearest profile wins. All n-grams of a document are counted and ranked, also those
that no profile has: they take places and add the most to every distance.

Profiles are fitted on at most about ``sample_per_lang`` documents of a language (those with the
smallest digests of their id), a stated bound; every document is predicted from its whole text.

Edge cases: a null text, or one without a letter, gives ``und`` with score 0; if nothing can be learned
(no labelled text at all) every document gives ``und``; ties go to the language that sorts first; other
columns are ignored here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.textkit import batch, slices, strings
from vecloom.runtime import ship, table

PROFILE = 400
SAMPLE_PER_LANG = 2000
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, lower case; each run of other characters is one 0. With the row of each."""
    low = [f" {t.lower()} " for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), [len(t) for t in low])
    is_letter = letter_table()[cp]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    keep[1:] |= row[1:] != row[:-1]
    return np.where(is_letter, cp, 0)[keep].astype(np.int64), row[keep]


def gram_codes(cp: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the code of each n-gram (21 bits a code point) and its row."""
    found = [(cp[cp > 0], row[cp > 0])]
    two = (cp[:-1] << 21) | cp[1:]
    ok = (row[:-1] == row[1:]) & ((cp[:-1] > 0) | (cp[1:] > 0))
    found.append(((two | (1 << 62))[ok], row[:-1][ok]))
    three = (two[:-1] << 21) | cp[2:]
    ok = (row[:-2] == row[2:]) & (cp[1:-1] > 0)
    found.append(((three & ((1 << 63) - 1))[ok] | np.int64(-(1 << 63)), row[:-2][ok]))
    return found


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def count_grams(batches):
    for b in batches:
        for part in slices(b, "text"):  # counting takes over 100 times their bytes
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            cp, row = letters(strings(part.column("text")))
            of = np.array([names.index(x) for x in langs])
            codes = gram_codes(cp, row)
            gram, lang = np.concatenate([c for c, _ in codes]), of[np.concatenate([r for _, r in codes])]
            for k in np.unique(lang):
                g, n = np.unique(gram[lang == k], return_counts=True)
                yield batch(COUNTS, lang=[names[k]] * len(g), gram=g, n=n)


def fit(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language from rows (doc_id, text, lang): n-gram codes, the most frequent first."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count()
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(sample_per_lang)) / F.col("count")).alias("share"))
    digest = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(digest < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= profile).orderBy("lang", "r").collect()
    out: dict[str, list[int]] = {}
    for r in top:
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Model:
    """Rank tables of the profiles over the union of their n-grams."""

    def __init__(self, profiles: dict[str, list[int]], profile: int = PROFILE):
        self.langs, self.most = sorted(profiles), profile
        self.vocab = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.langs), len(self.vocab) + 1), profile, np.int32)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.vocab, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        v = len(self.vocab)
        if not v or not texts:
            return names, scores
        cp, row = letters(texts)
        has = np.bincount(row[cp > 0], minlength=len(texts)) > 0
        codes = gram_codes(cp, row)
        code, of = np.concatenate([c for c, _ in codes]), np.concatenate([r for _, r in codes])
        names_of = np.unique(code)
        pair = np.sort(of * len(names_of) + np.searchsorted(names_of, code))
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        count = np.diff(np.append(first, len(pair)))
        of, gram = np.divmod(pair[first], max(1, len(names_of)))
        order = np.lexsort((gram, -count, of))
        of, gram = of[order], names_of[gram[order]]
        begin = np.searchsorted(of, np.arange(len(texts)))
        place = np.arange(len(of)) - begin[of]
        top = place < self.most
        of, gram, place = of[top], gram[top], place[top]
        at = np.minimum(np.searchsorted(self.vocab, gram), v - 1)
        at[self.vocab[at] != gram] = v  # in no profile
        used = np.maximum(np.bincount(of, minlength=len(texts)), 1) * self.most
        away = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            rank = self.rank[k][at]
            gap = np.where(rank < self.most, np.minimum(np.abs(rank - place), self.most), self.most)
            away[:, k] = np.bincount(of, gap, len(texts)) / used
        best = away.argmin(1)
        weight = np.exp(-25 * (away - away.min(1, keepdims=True)))
        share = 1 / weight.sum(1)
        for i in np.flatnonzero(has):
            names[i], scores[i] = self.langs[best[i]], float(share[i])
        return names, scores


RESULT = "lang_pred string, score double"


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; the profiles travel with the task, at most langs x 400 numbers."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        model = Model(profiles)
        for b in batches:
            for part in slices(b, 1, most_rows=256):
                names, scores = model.predict(strings(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {RESULT}")


def drop_unidentified(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language can be told at all (not ``und``)."""
    ship(docs.sparkSession)

    def run(batches):
        model = Model(profiles)
        for b in batches:
            for part in slices(b, text_col, most_rows=256):
                names, _ = model.predict(strings(part.column(text_col)))
                yield part.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id, parts: int, left: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == left, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    return predict(docs, profiles).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
