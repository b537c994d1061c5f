"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its token ids and a closing id 0. A longer one is cut into full pieces, the first of which
may be shorter; only that one can share a sequence. Pieces stream through bounded-space online best-fit:
``most`` bins (4,096) are open, kept by free space in a bitset; a piece goes to the fullest bin that holds it,
and where a bin too many would open, the fullest closes first. The stream looks ahead over ``window`` pieces
(8,192; 1 is none), the largest of which goes first. Bins that are still open at a task's end are packed once
more, with the same two numbers, together with those of other tasks.

Tokens never travel: a piece is a row of seven numbers. Any number of tasks can pack; memory is the open
bins, one window and one Arrow batch.

Ids may be of any type that sorts. Edge cases: an empty or null text is one piece, its closing id; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored here.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import vocabulary
from vecloom.llm.textkit import slices, strings
from vecloom.runtime import Scratch, ship, table

CAPACITY = 2048
OPEN_BINS = 4096
WINDOW = 8192
PIECES_PER_TASK = 50_000
LEFTOVER_TASKS = 32


class OpenBins:
    """Bounded-space best fit: bins by free space, and a bitset of the free spaces that occur."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = 0

    def take(self, free: int) -> list:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return out

    def put(self, free: int, held: list) -> None:
        self.by_free[free].append(held)
        self.bits |= 1 << free
        self.count += 1

    def add(self, size: int, item) -> list[list]:
        """Place an item; the bins that this closes."""
        closed = []
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            held = self.take(free)
        else:
            if self.count >= self.most:
                closed.append(self.take((self.bits & -self.bits).bit_length() - 1))
            free, held = self.capacity, []
        held.append(item)
        if free == size:
            closed.append(held)
        else:
            self.put(free - size, held)
        return closed

    def rest(self) -> list[list]:
        return [held for bins in self.by_free for held in bins]


def piece_schema(id_type: str) -> str:
    return f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: full ones, before them the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document."""
    spark = docs.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(vocabulary.read(path or vocabulary.default_path(vocabulary.BYTE_LEVEL)))

    def run(batches):
        coder = vocabulary.ByteLevel(data.value)
        for b in batches:
            of: list[int] = []
            rows: list[tuple] = []
            begin = 0
            for part in slices(b, 1, 1 << 20):
                for doc, text in enumerate(strings(part.column(1)), begin):
                    ids = np.array([*coder.ids(text), 0], "<u4")
                    for k, (at, size) in enumerate(cut(len(ids), capacity)):
                        of.append(doc)
                        rows.append((k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                begin += part.num_rows
            if rows:
                numbers = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *numbers], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, piece_schema(docs.schema[id_col].dataType.simpleString()))


def _pack_round(rows: DataFrame, tasks: int, round_no: int, last: bool, capacity: int, most: int, window: int) -> DataFrame:
    """Pack the pieces of each task; bins still open at its end get a null sequence unless this is the last round."""
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        bins, made = OpenBins(capacity, most), 0
        base = (round_no << 60) | (TaskContext.get().partitionId() << 36)
        out: list[tuple] = []
        kinds: list[pa.DataType] = []

        def close(held: list, number: int | None) -> None:
            at = 0
            for item in held:
                out.append((*item, number, at))
                at += item[3]

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in zip(kinds, cols)], names=fields)

        ahead: list[tuple] = []
        for b in chain(batches, (None,)):
            if b is not None:
                kinds[:] = [*(b.column(n).type for n in fields[:5]), pa.int64(), pa.int64()]
                ahead += zip(*(b.column(n).to_pylist() for n in fields[:5]))
            while len(ahead) >= window or (b is None and ahead):
                for item in sorted(ahead[:window], key=lambda x: -x[3]):
                    for held in bins.add(item[3], item):
                        close(held, base | made)
                        made += 1
                del ahead[:window]
                if out:
                    yield flush()
        for held in bins.rest():
            close(held, base | made if last else None)
            made += 1
        if out:
            yield flush()

    order = F.xxhash64(F.lit(round_no), "doc_id", "piece", "ids_crc32")
    dealt = rows.withColumn("__o", order).repartition(tasks, "__o").sortWithinPartitions("__o", "doc_id", "piece")
    return dealt.drop("__o").mapInArrow(run, piece_schema(rows.schema["doc_id"].dataType.simpleString()) + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, most: int = OPEN_BINS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cuts = scratch.save(pieces(docs, path, capacity, id_col, text_col), "pieces")
    tasks = max(1, -(-cuts.count() // PIECES_PER_TASK))
    first = scratch.save(_pack_round(cuts, tasks, 1, False, capacity, most, window), "first")
    scratch.drop("pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = _pack_round(first.where("sequence_id IS NULL").select(names), max(1, tasks // LEFTOVER_TASKS), 2, True, capacity, most, window)
    out = first.where("sequence_id IS NOT NULL").unionByName(scratch.save(again, "again"))
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
