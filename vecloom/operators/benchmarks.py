"""Timing reports: statistics of a run, of several runs, and the comparison of two reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.types import EngineError


def run_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, least, most, deviation (population), median, p95 (nearest rank) and throughput of (..., ms)."""
    return samples.groupBy(*by).agg(
        F.count("ms").alias("n"),
        F.round(F.avg("ms"), 6).alias("mean"),
        F.min("ms").alias("least"),
        F.max("ms").alias("most"),
        F.round(F.stddev_pop("ms"), 6).alias("deviation"),
        F.round(F.median("ms"), 6).alias("median"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"),
        F.round(F.count("ms") * 1000.0 / F.sum("ms"), 6).alias("per_second"),
    )


def cross_run(samples: DataFrame) -> DataFrame:
    """(metric, run, ms): median of the runs' medians, p95 of all samples, median of the runs' throughput."""
    runs = samples.groupBy("metric", "run").agg(F.median("ms").alias("m"), (F.count("ms") * 1000.0 / F.sum("ms")).alias("t"))
    medians = runs.groupBy("metric").agg(F.round(F.median("m"), 6).alias("median"), F.round(F.median("t"), 6).alias("per_second"), F.count(F.lit(1)).alias("runs"))
    pooled = samples.groupBy("metric").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"))
    return medians.join(pooled, "metric")


def compare(baseline: DataFrame, candidate: DataFrame, limit: float) -> DataFrame:
    """(metric, median) of both: change in percent, and whether it passes the limit (told before rounding).

    Refused: metrics that only one side has, no metric at all, and times that are not positive, finite numbers.
    """
    both = baseline.select("metric", F.col("median").alias("old")).join(candidate.select("metric", F.col("median").alias("new")), "metric", "full_outer")
    sound = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    one_sided = F.col("old").isNull() | F.col("new").isNull()
    seen = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(one_sided).alias("odd"), F.count_if(~one_sided & ~(sound("old") & sound("new"))).alias("bad")).first()
    if seen["odd"] or not seen["n"]:
        raise EngineError("metricsDiffer")
    if seen["bad"]:
        raise EngineError("invalidTiming")
    change = 100 * (F.col("new") / F.col("old") - 1)
    return both.select("metric", F.round(change, 6).alias("change_percent"), (change > limit).alias("regression"))


#: What two reports must have in common to be compared, and the states of heat that forbid it.
KEY = ("workloadVersion", "configuration", "modelID", "modelRevision", "modelContract", "embeddingDimension", "hardware", "os", "platform", "simulatorModel", "gpuName", "physicalMemoryBytes", "actualImageComputeUnits", "actualTextComputeUnits", "artifacts")
HOT = ("serious", "critical")


def problem(report: dict, needed: list[str]) -> str | None:
    """Why a report cannot be used: the first rule it breaks."""
    metrics = report.get("metrics") or {}
    times = [t for m in metrics.values() for t in m.get("samples", [None])]
    if report.get("schema") != 1 or report.get("status") != "complete":
        return "incompleteReport"
    if sorted(metrics) != sorted(needed):
        return "metricsDiffer"
    if not times or not all(isinstance(t, (int, float)) and 0 < t < float("inf") for t in times):
        return "invalidTiming"
    return None


def compare_reports(spark: SparkSession, baseline: dict, candidate: dict, needed: list[str], limit: float) -> DataFrame:
    """``compare`` of two whole reports ({schema, status, key, thermalStates, metrics: {name: {samples}}})."""
    for report in (baseline, candidate):
        if (code := problem(report, needed)) is not None:
            raise EngineError(code)
    if any(baseline["key"].get(k) != candidate["key"].get(k) for k in KEY):
        raise EngineError("notComparable")
    if {*baseline["thermalStates"], *candidate["thermalStates"]} & {*HOT}:
        raise EngineError("thermalPressure")
    rows = lambda r: spark.createDataFrame([(n, float(t)) for n, m in r["metrics"].items() for t in m["samples"]], "metric string, ms double").groupBy("metric").agg(F.median("ms").alias("median"))
    return compare(rows(baseline), rows(candidate), limit)


def write_report(compared: DataFrame, folder: str) -> None:
    """A comparison as one JSON file and one table in Markdown; it has a row for each metric, a few dozen."""
    compared.orderBy("metric").coalesce(1).write.mode("overwrite").json(f"{folder}/comparison")
    line = F.format_string("| %s | %+.1f %% | %s |", "metric", "change_percent", F.when(F.col("regression"), "slower").otherwise("-"))
    head = compared.sparkSession.createDataFrame([(0, "| metric | change | verdict |"), (1, "|-|-|-|")], "at int, value string")
    body = compared.select(F.lit(2).alias("at"), line.alias("value"))
    head.unionByName(body).orderBy("at", "value").select("value").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")


def source_fingerprint(files: DataFrame) -> DataFrame:
    """One ``fingerprint`` of source files (name, content binary): equal only for equal names and contents.

    Files are digested where they are read; only names and digests, a few hundred of a checkout, come together.
    """
    each = files.select(F.col("name").cast("string").alias("name"), F.sha2("content", 256).alias("digest"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("name", "digest"))), lambda f: F.concat(f["name"], F.lit(":"), f["digest"]))
    return each.agg(F.sha2(F.concat_ws("\n", lines), 256).alias("fingerprint"))


def required_metrics(sizes: list[int], with_search: bool = True) -> list[str]:
    """Names of the measurements that a complete report has."""
    names = ["image_model_load", "image_first_batch", "image_batch", "image_batch_1", "text_model_load", "text_first_query", "text_query"]
    if with_search:
        names += [f"{kind}_{n}" for n in sizes for kind in ("index_build", "search_first", "search", "text_search")]
    return sorted(names)


def missing_metrics(found: DataFrame, required: DataFrame) -> DataFrame:
    """metric, problem: names that only one side has."""
    a = required.select("metric").exceptAll(found.select("metric").distinct()).withColumn("problem", F.lit("missing"))
    b = found.select("metric").distinct().exceptAll(required.select("metric")).withColumn("problem", F.lit("unknown"))
    return a.unionByName(b)


def workload(runs: int = 3, samples: int = 20, warmups: int = 3, batch: int = 32, k: int = 120, sizes: tuple[int, ...] = (1000, 10000, 25000)) -> dict:
    """A workload inside its bounds."""
    for name, value, low, high in (("runs", runs, 1, 20), ("samples", samples, 3, 1000), ("warmups", warmups, 1, 100), ("batch", batch, 1, 128), ("k", k, 1, 1000)):
        if not low <= value <= high:
            raise EngineError("invalidWorkload", name)
    if not sizes or list(sizes) != sorted(set(sizes)) or sizes[0] < 1 or sizes[-1] > 100_000:
        raise EngineError("invalidWorkload", "sizes")
    return {"runs": runs, "samples": samples, "warmups": warmups, "batchSize": batch, "topK": k, "indexSizes": list(sizes)}
