"""Scoring of reads as they arrive, against a static query set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kmerloom.operators.similarity import MOST_BROADCAST, score_queries


def score_stream(reads: DataFrame, references: DataFrame, ref_id: str = "ref_id", read_id: str = "read_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(ref_id, read_id, score) of every read of a stream against a reference set of at most ``most_broadcast`` rows, which is broadcast.

    Stateless: each micro-batch is scored by itself, so any output mode and trigger works and restarts repeat nothing. A larger set is refused.
    """
    return score_queries(references, reads, ref_id, read_id, most_broadcast=most_broadcast)
