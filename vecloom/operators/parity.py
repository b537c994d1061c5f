"""Parity of candidate vectors with reference vectors: pair gates and the cross-modal gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vector
from vecloom.functions.ranking import spearman
from vecloom.types import EngineError

#: Fixed values by precision: greatest cosine distance, least rank correlation, tolerance of the norm.
TOLERANCES = {"fp32": (1e-4, 0.999, 1e-3), "fp16": (5e-3, 0.99, 1e-2)}


#: A reference is held to this tolerance of its norm whatever the candidate's precision.
REFERENCE_OFF = TOLERANCES["fp32"][2]
MOST_FIXTURES = 20_000


def pair_gate(pairs: DataFrame, tolerances: str = "fp32") -> DataFrame:
    """(id, kind, reference, candidate) to id, kind, cosine_distance, failures, without the rank part.

    vector-validation: null, empty, of unequal lengths, with a component that is not finite, a reference off length 1
    or a candidate of length 0; such a pair has no distance.
    """
    if tolerances not in TOLERANCES:
        raise EngineError("invalidManifest", "unknown tolerance ID")
    most, _, off = TOLERANCES[tolerances]
    distance = vector.cosine_distance(vector.cosine_raw(F.col("reference"), F.col("candidate")))
    size = vector.norm(F.col("candidate")).cast("float")
    ref = vector.norm(F.col("reference")).cast("float")
    single = lambda x: F.lit(x).cast("float")
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & vector.is_finite(x))
    shaped = (F.size("reference") > 0) & (F.size("reference") == F.size("candidate")) & finite("reference") & finite("candidate")
    measured = pairs.select("id", "kind", F.coalesce(shaped, F.lit(False)).alias("shaped"), distance.alias("cosine_distance"), size.alias("candidate_norm"), ref.alias("reference_norm"))
    sound = F.col("shaped") & (F.abs(F.col("reference_norm") - 1) <= single(REFERENCE_OFF)) & (F.col("candidate_norm") > 0)
    failures = F.array_compact(
        F.array(
            F.when(~F.coalesce(sound, F.lit(False)), F.lit("vector-validation")),
            F.when(F.col("shaped") & (F.col("cosine_distance") > single(most)), F.lit("cosine-distance")),
            F.when(F.col("shaped") & (F.abs(F.col("candidate_norm") - 1) > single(off)), F.lit("candidate-norm")),
        )
    )
    return measured.select("id", "kind", F.when(F.col("shaped"), F.col("cosine_distance")).alias("cosine_distance"), failures.alias("failures"))


def fixture_gate(reference: DataFrame, candidates: DataFrame, tolerances: str = "fp32") -> DataFrame:
    """Reference (id, kind, vector) against candidates (id, vector): one row per fixture.

    Ids must be the same on both sides, with two probes of each kind at least; each fixture ranks all
    probes of the other kind, and both rankings must correlate. Probes are a curated set of a checked size, since
    each meets all of the other kind.
    """
    odd = reference.select("id", F.lit(1).alias("r")).join(candidates.select("id", F.lit(1).alias("c")), "id", "full_outer").where("r IS NULL OR c IS NULL")
    if not odd.isEmpty():
        raise EngineError("candidateIDsMismatch")
    counts = {r["kind"]: (r["n"], r["d"]) for r in reference.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).collect()}
    if set(counts) != {"image", "text"} or any(n < 2 or n != d for n, d in counts.values()):
        raise EngineError("invalidFixtures")
    if sum(n for n, _ in counts.values()) > MOST_FIXTURES:
        raise EngineError("invalidFixtures", f"more than {MOST_FIXTURES}")
    pairs = reference.select("id", "kind", F.col("vector").alias("reference")).join(candidates.select("id", F.col("vector").alias("candidate")), "id")
    gated = pair_gate(pairs, tolerances)
    probes = pairs.select(F.col("id").alias("probe"), F.col("kind").alias("probe_kind"), F.col("reference").alias("probe_reference"), F.col("candidate").alias("probe_candidate"))
    scored = pairs.join(probes, F.col("kind") != F.col("probe_kind")).select(
        "id", vector.cosine_raw(F.col("reference"), F.col("probe_reference")).alias("a"), vector.cosine_raw(F.col("candidate"), F.col("probe_candidate")).alias("b")
    )
    ranked = spearman(scored, "a", "b", ["id"])
    least = TOLERANCES[tolerances][1]
    rank = F.round(F.col("rank_correlation"), 9)
    failures = F.concat("failures", F.when(F.col("rank_correlation").isNull() | (F.col("rank_correlation") < least), F.array(F.lit("rank-correlation"))).otherwise(F.array().cast("array<string>")))
    return gated.join(ranked, "id").select("id", "kind", "cosine_distance", rank.alias("rank_correlation"), failures.alias("failures"), (F.size(failures) == 0).alias("passed"))
