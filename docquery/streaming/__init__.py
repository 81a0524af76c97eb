"""Stateless stages over streams. The query language has no windows, watermarks or state; nothing more is claimed here."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from docquery.operators import stages as S
from docquery.plans import pipelines as P

STATELESS = (P.Match, P.Project, P.AddFields, P.Unwind)


def apply_pipeline(stream: DataFrame, pipeline: list[dict[str, Any]]) -> DataFrame:
    """A streaming DataFrame through $match, $project, $addFields, $set and $unwind."""
    stages = P.parse_pipeline(pipeline)
    for s in stages:
        if not isinstance(s, STATELESS):
            raise ValueError(f"not a stateless stage: {type(s).__name__}")
    return S.run(S.Frame(stream), stages).result()
