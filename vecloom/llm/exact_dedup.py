"""Exact deduplication by content sort, in DataFrame operations only.

Texts are equal when identical after each run of ASCII white space became one space; null counts as
empty. The rows are range-partitioned on sampled splitters of the leading bytes (ties: a 64-bit
digest), Spark's external sort places equal texts side by side, and the window below compares each
text in full with its neighbour. Of equal texts the smallest doc_id stays.

A text that holds more than 1/2048 of all rows or bytes is "hot": its rows are dealt over several
sub-groups (salt), so that no task gets a whole hot group; one row of each sub-group, with its text,
then settles the whole group. At most 4096 texts can be hot, whatever the size of the table, so the
two broadcast tables (hot digests; outcome of each sub-group) have a fixed bound.

Edge cases: an empty table gives an empty result; repeated rows (same doc_id and text) all appear in
the result and exactly one of them is kept; a null doc_id sorts after every number (rows without one are dealt out by their place); other columns of
the input are ignored here and kept by :func:`drop_duplicates_exact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vecloom.llm.textkit import fresh
from vecloom.runtime import Scratch, shuffle_partitions

SHARE = 2048
LEAST_ROWS, LEAST_BYTES = 16, 256 * 1024


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] = (), again: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, then the payload columns.

    ``again`` may say how to read the text from the payload columns, which are named __p_0, __p_1 ... inside.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    src = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__norm"), *[F.col(c).alias(f"__p_{i}") for i, c in enumerate(payload)]).withColumn("__h", F.xxhash64("__norm"))

    # how often each digest occurs: sums before the shuffle, one small row per digest after it
    total = Observation()
    counts = (
        src.select("__h", F.octet_length("__norm").alias("__b"))
        .observe(total, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("__b"), F.lit(0)).alias("bytes"))
        .groupBy("__h")
        .agg(F.count(F.lit(1)).alias("__n"), F.sum("__b").alias("__bytes"))
        .where(F.col("__n") > 1)
    )
    counts = scratch.save(counts, "counts")
    sums = {"rows": 0, "bytes": 0} if src.isEmpty() else total.get  # nothing is observed in an empty plan
    rows_each = max(LEAST_ROWS, sums["rows"] // SHARE)
    bytes_each = max(LEAST_BYTES, sums["bytes"] // SHARE)
    hot = counts.where((F.col("__n") > rows_each) | (F.col("__bytes") > bytes_each)).select(
        "__h", F.least(F.col("__n"), F.greatest(F.ceil(F.col("__n") / rows_each), F.ceil(F.col("__bytes") / bytes_each))).cast("int").alias("__salts")
    )

    key = ["__lead", "__h", "__salt"]
    dealt = (
        src.join(F.broadcast(hot), "__h", "left")
        .withColumn("__salt", F.coalesce(F.pmod(F.coalesce(F.when(F.col("__id").isNotNull(), F.xxhash64("__id")), F.monotonically_increasing_id()), F.col("__salts")).cast("int"), F.lit(-1)))
        .withColumn("__lead", F.substring("__norm", 1, 32))
        .drop("__salts", *(["__norm"] if again is not None else []))
        .repartitionByRange(shuffle_partitions(spark), *key)
    )
    if again is not None:  # the payload has the text: it is normalised anew rather than sent twice
        dealt = dealt.withColumn("__norm", normalised(again))
    # the range partitioning already clusters these keys: the window adds a sort, no second exchange
    same = Window.partitionBy(*key, "__norm")
    order = same.orderBy(F.col("__id").asc_nulls_last())
    sorted_rows = dealt.select(
        "*", F.row_number().over(order).alias("__rn"), F.first("__id").over(order).alias("__first"), F.count(F.lit(1)).over(same).alias("__size")
    )
    parts = scratch.save(
        sorted_rows.select(
            "__id",
            "__first",
            "__size",
            "__rn",
            "__salt",
            F.sha2(F.col("__norm").cast("binary"), 256).alias("__sha"),
            F.when((F.col("__salt") >= 0) & (F.col("__rn") == 1), F.col("__norm")).alias("__rep"),
            *[f"__p_{i}" for i in range(len(payload))],
        ),
        "parts",
    )
    scratch.drop("counts")
    settled = (
        parts.where((F.col("__salt") >= 0) & (F.col("__rn") == 1))
        .groupBy("__rep", "__sha")
        .agg(F.min(F.struct(F.col("__first").isNull().alias("__last"), "__first", "__salt")).alias("__best"), F.sum("__size").alias("__total"), F.collect_list("__salt").alias("__salts"))
        .select(F.col("__sha").alias("__of"), F.col("__best.__first").alias("__keep"), F.col("__best.__salt").alias("__home"), "__total", F.explode("__salts").alias("__part"))
    )
    # a text has one sub-group of each salt; ids cannot name it, for they may be null or repeated
    joined = parts.drop("__rep").join(F.broadcast(settled), (F.col("__salt") == F.col("__part")) & (F.col("__sha") == F.col("__of")), "left")
    keep = F.when(F.col("__salt") >= 0, F.col("__keep")).otherwise(F.col("__first"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("__total"), F.col("__size")).cast("long").alias("group_size"),
        ((F.col("__rn") == 1) & keep.eqNullSafe(F.col("__id")) & (F.coalesce("__home", "__salt") == F.col("__salt"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *[F.col(f"__p_{i}").alias(c) for i, c in enumerate(payload)],
    )


def drop_duplicates_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, with all their columns as they were."""
    row = fresh(docs, "row")
    packed = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = exact_groups(packed, id_col, text_col, [row], F.col("__p_0").getField(text_col)).where("kept")
    return kept.select(f"{row}.*")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from vecloom.runtime import table

    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
