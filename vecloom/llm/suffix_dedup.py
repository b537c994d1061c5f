"""Removal of byte strings that repeat across documents, by bucket-pointer refinement.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a document with a smaller
doc_id. Suffixes are put into buckets by their first q bytes, and buckets are refined by sorting on the
bucket pointers of the suffixes some places on, until strings in one bucket agree in 50 bytes:

* Initial buckets, q = 25. Their identifiers are 64-bit digests, so that blocks of whole texts agree on them
  without talk. Of each 26 neighbouring suffixes one is entered, the one with the least identifier: every
  string of 50 bytes holds the same one wherever it stands, so none is missed; a run of strings that hold the
  same one shares an entry. A bucket that one document alone enters is final.
* Refinement. For entries of other buckets the block sends the run's bytes, each distinct run once with its
  smallest doc_id. Runs of equal bytes are one; in buckets where runs differ, suffixes get pointers: where their
  8-gram bucket begins in the sorted order, then, depth 16, 32 and 50, where their part of that bucket begins
  once it is sorted on the pointers 8, 16 and 18 places on. A pointer that was refined is what the next depth
  reads; buckets of one suffix are final and are sorted no more. (Pointers of one depth are refined together,
  level by level, since one that is refined beyond 50 bytes would part equal strings.) In the end equal
  pointers mean equal bytes: digests choose candidates, bytes decide.
* The smallest doc_id of each last bucket says which strings go; the reply is a bit for each string of a run.

Copies come first: of rows with equal texts (SHA-256) only those with the smallest id are searched, the others
lose every byte, so a group of copies of any size is a row.

Everything travels as plain rows: one of 17 bytes for each entry (about one for 13 bytes of text), one for
each distinct run of a shared bucket in a block, one for each of those that loses a string. Their number grows
with the input, and a passage that a third of all documents share is one row for each block of 2 MB. Keys that
more than ``HOT`` blocks enter are dealt to several tasks: the distinct runs of such a key with their smallest
doc_id, summed before the shuffle, are sent to each of them.

Edge cases: a null text is empty; matches never cross documents; rows with the same doc_id never remove each
other's bytes; a null doc_id counts as larger than all; ids must be whole numbers (``unsupportedID`` otherwise);
texts under 50 bytes stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vecloom.llm.textkit import BASE, BYTE, U, fresh, mix, release
from vecloom.runtime import Scratch, ship, shuffle_partitions, table
from vecloom.types import EngineError

LENGTH = 50
HALF = LENGTH // 2
SPREAD = LENGTH - HALF + 1
RUN = 32
BLOCK_BYTES = 2 << 20
#: Text whose entries make one group of buckets, which is refined at a time.
BUCKET_BYTES = 2 << 20
HOT = 4096
LARGEST_BROADCAST = 200_000
CHUNK = 1 << 18
LAST = np.iinfo(np.int64).max


def power(k: int) -> np.uint64:
    return U(pow(BASE, k, 1 << 64))


def identifiers(buf: np.ndarray) -> np.ndarray:
    """Bucket identifiers at depth 25 of the suffixes of ``buf``, by doubling (before mixing)."""
    h1 = BYTE[buf]
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    h24 = h16[:-8] * power(8) + h8[16:]
    return h24[:-1] * power(1) + h1[24:]


def least_of_neighbours(h: np.ndarray) -> np.ndarray:
    """The least of each 26 neighbours."""
    m = h
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    return np.minimum(m[:-10], m[10:])


class Block:
    """Whole texts one after another, and the runs of their 50-byte strings that share an entry."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, contexts: bool):
        self.ids = ids
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.offset[1:])
        n = max(0, len(self.buf) - LENGTH + 1)
        least = np.zeros(n, U)
        self.half = np.zeros(n + HALF if contexts and n else 0, U)
        for a in range(0, n, CHUNK):
            z = min(n, a + CHUNK)
            h = identifiers(self.buf[a : z + LENGTH - 1])
            if contexts:
                self.half[a : z + HALF] = h
            h ^= h >> U(32)
            h *= U(0xD6E8FEB86659FD93)
            least[a:z] = least_of_neighbours(h)
        valid = np.zeros(n + 1, np.int8)
        size = np.diff(self.offset)
        long_enough = size >= LENGTH
        valid[self.offset[:-1][long_enough]] += 1
        ends = self.offset[1:][long_enough] - LENGTH + 1
        np.subtract.at(valid, ends, 1)
        valid = np.cumsum(valid[:n], dtype=np.int8) > 0
        new, over = valid.copy(), ~valid
        if n:
            new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
            over[1:] &= valid[:-1]
        start = np.flatnonzero(new)
        stop = np.append(start[1:], n)
        gaps = np.flatnonzero(over)
        if len(gaps) and len(start):
            at = np.searchsorted(gaps, start, side="right")
            stop = np.minimum(stop, np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)], n))
        pieces = -(-(stop - start) // RUN)
        if len(pieces) and pieces.max() > 1:  # long runs, of periodic texts, in pieces
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ends = np.repeat(stop, pieces)
            start = np.repeat(start, pieces) + k * RUN
            stop = np.minimum(start + RUN, ends)
        self.start, self.size = start, stop - start
        self.key = mix(least[start])
        self.doc = ids[np.searchsorted(self.offset, start, side="right") - 1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct identifiers in order, whether two documents here enter each, and each run's place in them."""
        order = np.argsort(self.key, kind="stable")
        key, doc = self.key[order], self.doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        if not len(first):
            return key, new, place
        return key[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), place

    def records(self, shared: np.ndarray):
        """Of the runs in shared entries (their identifiers, in order): the runs, each run's record, and each record's
        run and smallest doc_id. Runs of equal bytes are one record."""
        at = np.minimum(np.searchsorted(shared, self.key), max(len(shared) - 1, 0))
        runs = np.flatnonzero(shared[at] == self.key) if len(shared) else np.zeros(0, np.int64)
        if not len(runs):
            return runs, runs, runs, runs
        start, size = self.start[runs], self.size[runs]
        end = start + size + LENGTH - 1
        digest = mix(size.astype(U))
        for place in (start, start + HALF, end - LENGTH, end - HALF):
            digest = mix(digest ^ self.half[place])
        order = np.argsort(digest, kind="stable")
        new = np.append(True, digest[order][1:] != digest[order][:-1])
        first = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(order))))
        record = np.empty(len(runs), np.int64)
        record[order] = np.cumsum(new) - 1
        again = np.flatnonzero(~new)
        k = np.arange(LENGTH - 1 + RUN)
        odd = [np.zeros(0, np.int64)]
        for a in range(0, len(again), 1 << 16):  # equal digests: compare the bytes
            one, two = order[again[a : a + (1 << 16)]], order[first[again[a : a + (1 << 16)]]]
            last = len(self.buf) - 1
            same = self.buf[np.minimum(start[one][:, None] + k, last)] == self.buf[np.minimum(start[two][:, None] + k, last)]
            same |= k >= (size[one] + LENGTH - 1)[:, None]
            odd.append(one[~same.all(1) | (size[one] != size[two])])
        odd = np.concatenate(odd)
        record[odd] = int(new.sum()) + np.arange(len(odd))
        source = np.empty(int(new.sum()) + len(odd), np.int64)
        source[record[::-1]] = runs[::-1]
        least = np.full(len(source), LAST)
        np.minimum.at(least, record, self.doc[runs])
        return runs, record, source, least


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def bucket_cuts(buckets: int) -> np.ndarray:
    """Buckets are dealt out in equal ranges of identifiers."""
    return np.array([(k << 64) // buckets for k in range(buckets)], U)


def classes(buf: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bucket pointers at depth 50 of all suffixes with 50 bytes left in their run (others: any number).

    A pointer is where a suffix's bucket begins in the sorted order of all suffixes.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(U)
    gram = np.zeros(n, U)
    for k in range(8):
        gram = gram << U(8) | padded[k : k + n]
    pointer = np.zeros(n, np.int64)
    members = np.flatnonzero(left >= 8)
    order = members[np.argsort(gram[members])]
    head = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1])[: len(order)])
    size = np.diff(np.append(head, len(order)))
    pointer[order] = np.repeat(head, size)
    alone = np.ones(n, bool)
    alone[order] = np.repeat(size, size) == 1
    for depth, on in ((16, 8), (32, 16), (LENGTH, LENGTH - 32)):
        members = np.flatnonzero((left >= depth) & ~alone)
        if not len(members):
            break
        # sort each bucket on the pointers ``on`` places on; its parts begin where the bucket did, plus what is before them
        key = pointer[members] * n + pointer[members + on]
        turn = np.argsort(key)
        order, key = members[turn], key[turn]
        old = pointer[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(order)))
        begin = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        inside = head - np.repeat(begin, np.diff(np.append(begin, len(order))))[head]
        pointer[order] = np.repeat(old[head] + inside, size)
        alone[order] = np.repeat(size, size) == 1
    return pointer


def pack_blocks(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows gathered into blocks of about BLOCK_BYTES of text, all columns kept: block, n_bytes, payload."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        total = 0

        def close():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in held:
                    w.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([total], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "payload"])

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False)
            a = 0
            while a < b.num_rows:
                room = np.cumsum(sizes[a:])
                z = a + max(1, int(np.searchsorted(room, max(BLOCK_BYTES - total, 1), side="left")) + 1)
                z = min(z, b.num_rows)
                held.append(b.slice(a, z - a))
                total += int(room[z - a - 1])
                a = z
                if total >= BLOCK_BYTES:
                    yield close()
                    held, total, made = [], 0, made + 1
        if held:
            yield close()

    return docs.mapInArrow(run, "block long, n_bytes long, payload binary")


def open_block(payload: bytes, id_col: str, text_col: str, contexts: bool) -> tuple[pa.Table, list[bytes], Block]:
    t = pa.ipc.open_stream(payload).read_all()
    texts = [x or b"" for x in t.column(text_col).cast(pa.binary()).to_pylist()]
    ids = pc.fill_null(t.column(id_col).cast(pa.int64()), LAST).to_numpy(zero_copy_only=False)
    return t, texts, Block(texts, ids, contexts)


def rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time; lists as arrays."""
    for k in range(b.num_rows):
        yield {n: (c[k].as_py() if not pa.types.is_list(c.type) else c[k].values) for n, c in zip(b.schema.names, b.columns)}
        release()


def numbers(values, kind=np.int64) -> np.ndarray:
    """A list of a row (null: none) as an array."""
    return np.zeros(0, kind) if values is None else values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


REPLY = pa.schema([("block", pa.int64()), ("rec", pa.int32()), ("bits", pa.int32())])


def refine_bucket(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """For one group of buckets: which strings of each run start in a document smaller than the run's own, as bits."""
    runs = t.column("context").combine_chunks().dictionary_encode()
    which, doc, bucket = runs.indices.to_numpy(), t.column("doc").to_numpy(), t.column("key").to_numpy()
    block, rec = t.column("block").to_numpy(), t.column("rec").to_numpy()
    n = len(runs.dictionary)
    _, offsets, data = runs.dictionary.buffers()
    offsets = np.frombuffer(offsets, np.int32)[: n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)
    size = np.diff(offsets) - (LENGTH - 1)
    least = np.full(n, LAST)
    np.minimum.at(least, which, doc)
    own = np.zeros(n, np.int64)
    own[which] = bucket
    smallest = np.full((n, RUN), LAST)
    strings = np.arange(RUN) < size[:, None]
    smallest[strings] = np.repeat(least, size)
    # buckets where runs differ
    order = np.argsort(own, kind="stable")
    edge = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
    count = np.diff(np.append(edge, n))
    several = np.zeros(n, bool)
    several[order] = np.repeat(count, count) > 1
    at = order[several[order]]
    while len(at):
        end = min(len(at) - 1, int(np.searchsorted(np.cumsum(size[at] + LENGTH - 1), CHUNK * 8)))
        part, at = np.split(at, [int(np.searchsorted(own[at], own[at[end]], side="right"))])  # whole buckets
        long = size[part] + LENGTH - 1
        text = buf[spread(offsets[part], long)]
        left = np.repeat(np.cumsum(long), long) - np.arange(len(text))
        begin = np.cumsum(long) - long
        start = spread(begin, size[part])
        found = classes(text, left)[start]
        low = np.repeat(least[part], size[part])
        turn = np.argsort(found, kind="stable")
        head = np.flatnonzero(np.append(True, found[turn][1:] != found[turn][:-1]))
        lows = np.empty(len(found), np.int64)
        lows[turn] = np.repeat(np.minimum.reduceat(low[turn], head), np.diff(np.append(head, len(found))))
        smallest[np.repeat(part, size[part]), start - np.repeat(begin, size[part])] = lows
    bits = np.zeros(len(which), np.uint32)
    for a in range(0, len(which), 1 << 15):
        goes = smallest[which[a : a + (1 << 15)]] < doc[a : a + (1 << 15), None]
        bits[a : a + (1 << 15)] = np.packbits(goes, axis=1, bitorder="little").view(np.uint32)[:, 0]
    told = np.flatnonzero((bits != 0) & (block >= 0))
    release()
    return pa.table({"block": block[told], "rec": rec[told], "bits": bits[told].view(np.int32)}, schema=REPLY)


def split_copies(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows to search, and rows that are copies of a text of at least 50 bytes with a smaller id: all of their bytes go."""
    sha, first = fresh(docs, "sha"), fresh(docs, "first")
    text = F.col(f"`{text_col}`")
    digest = F.when(F.octet_length(text) >= LENGTH, F.unhex(F.sha2(text.cast("binary"), 256)))
    known = docs.select(digest.alias(sha), F.col(f"`{id_col}`").alias(first)).where(F.col(sha).isNotNull()).groupBy(sha).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias(first))
    known = scratch.save(known.where("n > 1").drop("n"), "copies")
    few = known.limit(LARGEST_BROADCAST + 1).count() <= LARGEST_BROADCAST
    told = docs.withColumn(sha, digest).join(F.broadcast(known) if few else known, sha, "left")
    copy = F.col(first).isNotNull() & ~F.col(f"`{id_col}`").eqNullSafe(F.col(first))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return told.where(~copy).select(*columns), told.where(copy).select(*columns)


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def check_ids(docs: DataFrame, id_col: str) -> None:
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise EngineError("unsupportedID", f"{id_col} is {docs.schema[id_col].dataType.simpleString()}")


def _passes(docs: DataFrame, id_col: str, text_col: str, finish, schema: str, scratch: Scratch) -> DataFrame:
    """Run the rounds; ``finish(table, texts, masks)`` makes a block's result, masks being None where nothing goes."""
    spark = docs.sparkSession
    ship(spark)
    blocks = scratch.save(pack_blocks(docs, text_col), "blocks")
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    cuts = bucket_cuts(max(shuffle_partitions(spark), -(-total // BUCKET_BYTES)))

    def entries(batches):
        for b in batches:
            for r in rows_of(b):
                key, many, _ = open_block(r["payload"], id_col, text_col, False)[2].entries()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), r["block"])), pa.array(many)], names=["key", "block", "many"])

    # buckets that two documents enter, as lists for each block (no longer than the block's own entries)
    same = Window.partitionBy("key")
    entered = blocks.select("block", "payload").mapInArrow(entries, "key long, block long, many boolean")
    shared = entered.select("key", "block", F.count(F.lit(1)).over(same).alias("n"), F.max("many").over(same).alias("two")).where("n > 1 OR two")
    salts = F.ceil(F.col("n") / HOT).cast("int")
    first = shared.groupBy("block").agg(F.collect_list("key").alias("first"), F.collect_list(F.when(salts > 1, F.col("key"))).alias("hot"), F.collect_list(F.when(salts > 1, salts)).alias("salts"))
    first = scratch.save(first, "first")

    def contexts(batches):
        for b in batches:
            for r in rows_of(b):
                block = open_block(r["payload"], id_col, text_col, True)[2]
                source, least = block.records(np.sort(numbers(r["first"]).view(U)))[2:]
                key, size = block.key[source], block.size[source] + LENGTH - 1
                dealt = dict(zip(numbers(r["hot"]).view(U).tolist(), numbers(r["salts"]).tolist()))
                parts = np.array([dealt.get(k, 1) for k in key.tolist()], np.int32) if dealt else np.ones(len(key), np.int32)
                offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
                text = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(block.buf[spread(block.start[source], size)])])
                group = np.searchsorted(cuts, key, side="right") | (mix(np.array([r["block"]], U)) % parts.astype(U)).astype(np.int64) << 40
                cols = [group, key.view(np.int64), least, np.full(len(key), r["block"]), np.arange(len(key), dtype=np.int32)]
                made = pa.RecordBatch.from_arrays([*map(pa.array, cols), text], names=["group", "key", "doc", "block", "rec", "context"])
                for a in range(0, made.num_rows, 1 << 14):
                    yield made.slice(a, 1 << 14)

    told = blocks.select("block", "payload").join(first, "block").mapInArrow(contexts, "group long, key long, doc long, block long, rec int, context binary")
    hot = first.where(F.size("hot") > 0).select(F.explode(F.arrays_zip("hot", "salts")).alias("x")).select(F.col("x.hot").alias("key"), F.col("x.salts").alias("parts")).distinct()
    if not hot.isEmpty():
        told = scratch.save(told, "told")
        runs = told.join(hot, "key").groupBy("key", "parts", "context").agg(F.min("doc").alias("doc"), F.min(F.col("group").bitwiseAND((1 << 40) - 1)).alias("bucket"))
        every = runs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        group = F.col("bucket") + F.shiftleft(F.col("part").cast("long"), 40)
        told = told.unionByName(every.select(group.alias("group"), "key", "doc", F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("rec"), "context"))
    second = told.groupBy("group").applyInArrow(refine_bucket, "block long, rec int, bits int")
    second = scratch.save(second.groupBy("block").agg(F.collect_list("rec").alias("rec"), F.collect_list("bits").alias("bits")), "second")
    scratch.drop("told")

    def apply(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                t, texts, block = open_block(r["payload"], id_col, text_col, True)
                runs, record, source, least = block.records(np.sort(numbers(r["first"]).view(U)))
                bits = np.zeros(len(source), np.uint32)
                bits[numbers(r["rec"])] = numbers(r["bits"], np.int32).view(np.uint32)
                gone = np.zeros(len(block.buf) + 1, np.int32)
                if len(runs):
                    size = block.size[runs]
                    at = spread(block.start[runs], size)
                    goes = np.repeat(bits[record], size) >> spread(np.zeros(len(runs), np.int64), size).astype(np.uint32) & np.uint32(1)
                    gone[at[(goes > 0) | np.repeat(block.doc[runs] > least[record], size)]] = 1
                    # a byte goes if one of the 50 strings that cover it does
                    sums = np.cumsum(gone)
                    sums[LENGTH:] -= sums[:-LENGTH].copy()
                    gone = sums
                gone = gone[:-1] > 0
                masks = []
                for a, z in zip(block.offset, block.offset[1:]):
                    m = gone[a:z]
                    masks.append(m if m.any() else None)
                yield from finish(t, texts, masks)

    joined = blocks.select("block", "payload").join(first.select("block", "first"), "block", "left").join(second, "block", "left")
    return joined.mapInArrow(apply, schema)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""

    def finish(t, texts, masks):
        removed = [0 if m is None else int(m.sum()) for m in masks]
        spans = [0 if m is None else int(m[0]) + int((m[1:] & ~m[:-1]).sum()) for m in masks]
        kept = [hashlib.sha256(x if m is None else np.frombuffer(x, np.uint8)[~m].tobytes()).hexdigest() for x, m in zip(texts, masks)]
        cols = [t.column(id_col).combine_chunks(), pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    check_ids(docs, id_col)
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows, copies = split_copies(docs.select(id_col, text_col), id_col, text_col, scratch)
    size = F.octet_length(text_col).cast("long")
    whole = copies.select(id_col, size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    found = _passes(rows, id_col, text_col, finish, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {DIGEST}", scratch)
    return found.unionAll(whole)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the repeats cut from the text (what is left of a cut character
    goes too; null stays null) and, if ``size_col`` is given, that column set to the new number of code points."""

    def finish(t, texts, masks):
        old = t.column(text_col).to_pylist()
        new = [o if m is None else np.frombuffer(x, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for o, x, m in zip(old, texts, masks)]
        cols = {n: t.column(n).combine_chunks() for n in t.schema.names}
        cols[text_col] = pa.array(new, pa.string())
        if size_col:
            cols[size_col] = pa.array([None if x is None else len(x) for x in new], pa.int64()).cast(t.schema.field(size_col).type)
        yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    check_ids(docs, id_col)
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows, copies = split_copies(docs, id_col, text_col, scratch)
    cut = {text_col: F.lit(""), **({size_col: F.lit(0).cast(docs.schema[size_col].dataType)} if size_col else {})}
    whole = copies.select(*[cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in docs.columns])
    return _passes(rows, id_col, text_col, finish, docs.schema, scratch).unionAll(whole)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, h, unnest(generate_series(0, (length(h) // 2 - 50) // 500)) AS c FROM d WHERE length(h) >= 100),
q AS (SELECT doc_id, c, substr(h, CAST(1000 * c + 1 AS BIGINT), 1098) AS h FROM e),
w AS (SELECT doc_id, 500 * c + i AS i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, c, h, unnest(generate_series(0, length(h) // 2 - 50)) AS i FROM q)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE doc_id > first),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
x AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY 1, 2),
y AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM x),
o AS (SELECT y.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS kept, max(z) AS e FROM y JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, CAST(2 * e + 1 AS BIGINT)), h))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))
