"""Column expressions shared by the operators."""

from strayline.functions.columns import (
    entropy_bits,
    entropy_nats,
    entropy_term,
    epoch_micros,
    euclidean,
    outlier_flag,
)

__all__ = [
    "entropy_bits",
    "entropy_nats",
    "entropy_term",
    "epoch_micros",
    "euclidean",
    "outlier_flag",
]
