"""Answers that arrive late or more than once: of each request the first final one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_final(stream: DataFrame, key: list[str], final: str, event_time: str | None = None, within: str = "1 hour") -> DataFrame:
    """Final answers, one for each request; partial, repeated and later ones are dropped as they come.

    Without ``event_time`` a key is kept for ever. With it, keys are forgotten ``within`` after their first
    answer, so the state is bounded; a repeat that comes later than that passes.
    """
    answers = stream.where(final)
    if event_time is None:
        return answers.dropDuplicates(key)
    return answers.withWatermark(event_time, within).dropDuplicatesWithinWatermark(key)


def run(answers: DataFrame, folder: str, checkpoint: str):
    """Append all answers available now to Parquet files in ``folder``."""
    return answers.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
