"""One entry for both detectors, and the run from source to store."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strayline.plans.kmeans import check_strategy, find_kmeans_outliers
from strayline.plans.markov import find_markov_outliers
from strayline.operators.markov import check_metric
from strayline.sources.loaders import load_points, load_states
from strayline.sources.specs import field_spec
from strayline.sources.store import claimed, read_results, write_params, write_results

# Algorithm names and the parameters each one needs.
REQUIRED = {
    "KMEANS": ("top", "iterations", "strategy"),
    "MARKOV": ("scale", "states", "strategy", "threshold"),
}
# Parameters that are kept with a run, and their type names.
STORED = {
    "KMEANS": {"top": "integer", "strategy": "string", "iterations": "integer"},
    "MARKOV": {"strategy": "string", "threshold": "double"},
}
_RESULT_KIND = {"KMEANS": "vector", "MARKOV": "state"}


def check_params(algorithm: str, params: dict[str, Any]) -> None:
    """Raise ValueError for an unknown algorithm or strategy or a missing parameter."""
    if algorithm not in REQUIRED:
        raise ValueError(f"unknown algorithm '{algorithm}', expected one of {', '.join(REQUIRED)}")
    missing = [name for name in REQUIRED[algorithm] if params.get(name) is None]
    if missing:
        raise ValueError(f"{algorithm} needs the parameter(s) {', '.join(missing)}")
    (check_strategy if algorithm == "KMEANS" else check_metric)(params["strategy"])


def detect_outliers(df: DataFrame, algorithm: str, **params: Any) -> DataFrame:
    """Run a detector: ``KMEANS`` on points or ``MARKOV`` on state events."""
    check_params(algorithm, params)
    find = find_kmeans_outliers if algorithm == "KMEANS" else find_markov_outliers
    return find(df, **params)


def run_detection(
    spark: SparkSession,
    store: str,
    uid: str,
    algorithm: str,
    source: str,
    source_options: dict[str, Any],
    **params: Any,
) -> DataFrame:
    """Read a source, detect, store results and parameters under ``uid``, return the stored rows.

    The field spec registered for ``uid`` applies, else the default one. A ``uid`` that has results
    or is being run is refused before anything runs; a run that fails leaves none and can be
    repeated.
    """
    check_params(algorithm, params)
    kind = _RESULT_KIND[algorithm]
    with claimed(spark, store, uid):
        load = load_points if algorithm == "KMEANS" else load_states
        data = load(spark, source, field_spec(spark, store, uid, kind), **source_options)
        stored = {n: (t, params[n]) for n, t in STORED[algorithm].items()}
        write_results(detect_outliers(data, algorithm, **params), store, uid, kind)
        write_params(spark, store, uid, stored)
    return read_results(spark, store, uid, kind)
