"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree whose nodes hold sums of characters and tokens.
An edit finds its leaves by descent, splits only the text it touches, from the last border that it cannot
move to the first later border where old and new splits meet again, encodes the new pre-tokens there and
updates the sums on the way up. The root is the count of tokens of the whole text.

Edits are (start, stop, replacement) in code points, applied in order, each to the text that the one
before left; ranges are clipped to the text. A text that holds a special token, before or after an edit,
is counted anew from the start, since such a token splits the text first.

Edge cases: a null text is empty; a null list of edits is none; a null replacement is empty, null ends
stand for the text's own; repeated rows are counted each; an empty table gives an empty result; other
columns are ignored here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import vocabulary
from vecloom.llm.textkit import strings
from vecloom.runtime import ship, table

SPLIT = regex.compile(vocabulary.PATTERN)
MOST_CACHED = 300_000
EDITS = "array<struct<start:bigint,stop:bigint,replacement:string>>"


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, data: bytes):
        self.coder = vocabulary.ByteLevel(data)
        self.known: dict[str, int] = {}

    def of(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= MOST_CACHED:
                self.known.clear()
            n = self.known[piece] = len(self.coder.plain(piece))
        return n

    def special(self, text: str) -> bool:
        return any(t in text for t in self.coder.special)

    def total(self, text: str) -> tuple[int, int]:
        """Tokens and pre-tokens of a text."""
        if self.special(text):
            return len(self.coder.ids(text)), len(SPLIT.findall(text))
        pieces = SPLIT.findall(text)
        known, of = self.known, self.of
        return sum([known[p] if p in known else of(p) for p in pieces]), len(pieces)


def sums(leaves: list[int], size: int) -> list[int]:
    level = np.zeros(size, np.int64)
    level[: len(leaves)] = leaves
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).sum(1)
        levels.append(level)
    return np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tolist()


def upto(pieces: list[str], at: int) -> list[str]:
    """The pieces before character ``at``, a border."""
    out, pos = [], 0
    for p in pieces:
        if pos >= at:
            break
        out.append(p)
        pos += len(p)
    return out


class CountTree:
    """The segment tree of one document."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        self.build(text)

    def build(self, text: str) -> None:
        self.plain = not self.counter.special(text)
        self.slots = SPLIT.findall(text) if self.plain else [text]
        self.encoded += len(self.slots)
        self.size = 1 << max(0, len(self.slots) - 1).bit_length()
        self.chars = sums([len(s) for s in self.slots], self.size)
        self.tokens = sums([self.counter.of(s) for s in self.slots] if self.plain else [self.counter.total(text)[0]], self.size)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.slots)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and its first character."""
        k, first = 1, 0
        while k < self.size:
            k *= 2
            if at - first >= self.chars[k]:
                first += self.chars[k]
                k += 1
        return k - self.size, first

    def put(self, slot: int, piece: str, tokens: int) -> None:
        """Replace a leaf and the sums above it."""
        self.slots[slot] = piece
        k = slot + self.size
        dc, dt = len(piece) - self.chars[k], tokens - self.tokens[k]
        while k and (dc or dt):
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2

    def edit(self, start: int | None, stop: int | None, new: str | None) -> None:
        n, new = self.chars[1], new or ""
        start = 0 if start is None else min(max(start, 0), n)
        stop = n if stop is None else min(max(stop, start), n)
        if not self.plain or not n:
            old = self.text()
            return self.build(old[:start] + new + old[stop:])
        # a pre-token's end depends on one character behind it: the leaf at start - 2 begins at a sure border
        lo, first = self.find(max(0, start - 2))
        hi, _ = self.find(min(stop, n - 1))
        region = "".join(self.slots[lo : hi + 1])
        region = region[: start - first] + new + region[stop - first :]
        reach, last = 4, len(self.slots) - 1
        while True:
            end = min(hi + reach, last)
            whole = region + "".join(self.slots[hi + 1 : end + 1])
            pieces = SPLIT.findall(whole)
            if end == last:
                stay = end
                break
            borders = set(np.cumsum([len(p) for p in pieces]).tolist())
            at, stay = len(region), None
            for s in range(hi, end):
                at += len(self.slots[s]) if s > hi else 0
                if at in borders and at < len(whole):
                    stay = s
                    break
            if stay is not None:
                pieces = upto(pieces, at)
                break
            reach *= 2
        if self.counter.special(self._around(lo, first, whole)):
            old = self.text()
            return self.build(old[:start] + new + old[stop:])
        self.encoded += len(pieces)
        room = stay - lo + 1
        for k in range(room):
            part = pieces[k : k + 1] if k < room - 1 else pieces[k:]
            self.put(lo + k, "".join(part), sum(map(self.counter.of, part)))

    def _around(self, lo: int, first: int, whole: str) -> str:
        """The new text with what stands before it, as far as a special token could reach."""
        before, k, width = "", lo - 1, max([0, *map(len, self.counter.coder.special)])
        while k >= 0 and len(before) < width:
            before = self.slots[k] + before
            k -= 1
        return before + whole


def count_after_edits(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """id, n_tokens and n_pretokens of the text, n_tokens_edited of the text after its edits, and n_reencoded pre-tokens that those took."""
    spark = docs.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(vocabulary.read(path or vocabulary.default_path(vocabulary.BYTE_LEVEL)))
    names = ["n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded"]

    def run(batches):
        counter = Counter(data.value)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                out = []
                for text, edits in zip(strings(part.column(1)), part.column(2).to_pylist()):
                    if edits:
                        tree = CountTree(text, counter)
                        n, built = tree.n_tokens, tree.encoded
                        for e in edits:
                            tree.edit(e["start"], e["stop"], e["replacement"])
                        out.append((n, built, tree.n_tokens, tree.encoded - built))
                    else:
                        n, pieces = counter.total(text)
                        out.append((n, pieces, n, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[i] for x in out], pa.int64()) for i in range(4)]], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.col(edits_col).cast(EDITS)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_pretokens of every row."""
    return count_after_edits(docs.select(id_col, text_col, F.lit(None).cast(EDITS).alias("edits")), path, id_col, text_col).select(id_col, "n_tokens", "n_pretokens")


def revision(text):
    """The edit script of the query: a word goes in at a third, twelve characters go at two thirds, and the last ones are replaced."""
    n = F.char_length(F.coalesce(text, F.lit(""))).cast("long")
    third = (n / 3).cast("long")
    one = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), F.lit(new).alias("replacement"))
    return F.array(one(third, third, " revised"), one(2 * third, 2 * third + 12, ""), one(n - 8, n, "\nEnd, 2026."))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_after_edits(docs.select("doc_id", "text", revision(F.col("text")).alias("edits")))
