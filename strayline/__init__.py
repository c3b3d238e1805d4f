"""Outlier detection on Spark DataFrames: cluster-based for points, Markov-based for behavior."""

from strayline.plans.detect import detect_outliers, run_detection
from strayline.plans.kmeans import detect_kmeans, find_kmeans_outliers, prepare, sweep_k
from strayline.plans.markov import find_markov_outliers

__all__ = [
    "detect_kmeans",
    "detect_outliers",
    "find_kmeans_outliers",
    "find_markov_outliers",
    "prepare",
    "run_detection",
    "sweep_k",
]
