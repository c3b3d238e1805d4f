"""From a source to what the detectors read: points and state events."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strayline.operators.vectors import assemble_points
from strayline.sources.readers import read_source
from strayline.sources.specs import DEFAULT_SPECS, Field, apply_field_spec


def load_points(
    spark: SparkSession,
    source: str,
    spec: Sequence[Field] = DEFAULT_SPECS["vector"],
    **options: Any,
) -> DataFrame:
    """Points from a source of feature cells."""
    return assemble_points(apply_field_spec(read_source(spark, source, **options), spec))


def load_states(
    spark: SparkSession,
    source: str,
    spec: Sequence[Field] = DEFAULT_SPECS["state"],
    tiebreak: str | None = None,
    **options: Any,
) -> DataFrame:
    """State events from a source; see `build_sequences` for the sequences themselves."""
    return apply_field_spec(read_source(spark, source, **options), spec, tiebreak)
