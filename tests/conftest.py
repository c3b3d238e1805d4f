import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


def events_frame(spark, sequences, site="s"):
    """State events from ``{user: states}``, in a shuffled row order."""
    rows = [(site, user, t, state) for user, states in sequences.items() for t, state in enumerate(states)]
    rows = rows[1::2] + rows[0::2]
    return spark.createDataFrame(rows, "site string, user string, timestamp long, state string")


def points_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, features array<double>")
