import math
import random
from collections import Counter

from strayline.operators.entropy import int_entropy, str_entropy


def test_string_entropy_golden(spark):
    df = spark.createDataFrame([("g", v) for v in "aabc"] + [("one", "a"), ("same", "a"), ("same", "a")], "g string, v string")
    got = {r["g"]: r["entropy"] for r in str_entropy(df, ["g"], "v").collect()}
    assert got == {"g": 1.5, "one": 0.0, "same": 0.0}


def test_int_entropy_golden(spark):
    rows = [("g", v) for v in (2, 1, 1, 0, -3)] + [("none", 0), ("none", -1), ("one", 7)]
    got = {r["g"]: round(r["entropy"], 6) for r in int_entropy(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    assert got == {"g": 1.039721, "none": 0.0, "one": 0.0}


def test_entropies_against_definition(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice("abcdef"), rng.randrange(-5, 50)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, s string, w int").repartition(5)
    bits = {r["g"]: r["entropy"] for r in str_entropy(df, ["g"], "s").collect()}
    nats = {r["g"]: r["entropy"] for r in int_entropy(df, ["g"], "w").collect()}
    for g in range(4):
        counts = Counter(s for h, s, _ in rows if h == g)
        n = sum(counts.values())
        assert math.isclose(bits[g], -sum(c / n * math.log2(c / n) for c in counts.values()), rel_tol=1e-9)
        weights = [w for h, _, w in rows if h == g and w > 0]
        total = sum(weights)
        assert math.isclose(nats[g], -sum(w / total * math.log(w / total) for w in weights), rel_tol=1e-9)


def test_no_groups(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    assert str_entropy(df, [], "v").first()["entropy"] == 1.0
