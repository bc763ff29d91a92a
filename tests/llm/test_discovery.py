import math
import random

import pytest

from tidewise.llm.secret_scan import BIN, discovered


def brute(tokens, alpha):
    """Benjamini and Hochberg over each class: the largest rank whose p-value is within its share; all bins from there on are findings."""
    out = set()
    for c in {x for x, _ in tokens}:
        ps = sorted(math.exp(-b * BIN) for x, b in tokens if x == c)
        cut = max((p for p in ps if p <= alpha * sum(q <= p for q in ps) / len(ps)), default=None)
        out |= {(c, b) for x, b in tokens if x == c and cut is not None and math.exp(-b * BIN) <= cut * (1 + 1e-12)}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_discovered_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    tokens = [(c, min(2000, int(rnd.expovariate(1 if rnd.random() < 0.8 else 0.05) / BIN))) for c in range(5) for _ in range(rnd.randrange(1, 120))]
    got = {(r.length_class, r.bin) for r in discovered(spark.createDataFrame(tokens, "length_class int, bin int"), 0.05).collect()}
    assert got == brute(tokens, 0.05)


def test_nothing_is_discovered_in_nothing(spark):
    assert discovered(spark.createDataFrame([], "length_class int, bin int"), 0.05).collect() == []
    assert discovered(spark.createDataFrame([(8, 1)] * 50, "length_class int, bin int"), 0.05).collect() == []
