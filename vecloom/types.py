"""Schemas, defaults and error names of the retrieval engine."""

from __future__ import annotations

from pyspark.sql import types as T

DIMENSION = 64
DEFAULT_K = 120
LEAST_NORM = 1e-8
FRAGMENT, ENCODE_BATCH, COMPACT_OVER = 100, 32, 32

INDEX = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])
LIBRARY = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("modification_ts", T.TimestampType()), T.StructField("visible", T.BooleanType())])
TOKEN_FIXTURE = "manifest STRUCT<fixtureVersion: STRING, modelID: STRING, modelRevision: STRING, checkpointHash: STRING, tokenizerAssets: ARRAY<STRING>, preprocessingFingerprint: STRING, embeddingDimension: INT, contextLength: INT, createdAt: STRING>, cases ARRAY<STRUCT<id: STRING, prompt: STRING, paddedLength: INT, expectedTokenIDs: ARRAY<INT>>>"
VECTOR_FIXTURE = "manifest STRUCT<fixtureVersion: STRING, modelID: STRING, modelRevision: STRING, checkpointHash: STRING, tokenizerAssets: ARRAY<STRING>, preprocessingFingerprint: STRING, embeddingDimension: INT, contextLength: INT>, precision STRING, vectors ARRAY<STRUCT<id: STRING, kind: STRING, source: STRING, vector: ARRAY<FLOAT>>>"


class EngineError(ValueError):
    """An error with a stable name (``code``)."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code
