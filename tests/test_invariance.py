"""Results must not depend on shuffle partitions, chunk size or row order."""

import numpy as np
from pyspark.sql import functions as F

from wavespark.operators import filters, pointwise, stats

SIG = "project string, version int, trace string, i long, x double, y double, domain string"


def _frame(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for v in (1, 2):
        for t, n in (("a", 900), ("b", 700), ("c", 1200)):
            ys = np.cumsum(rng.normal(size=n))
            rows += [("p", v, t, i, float(i), float(y), "TIME") for i, y in enumerate(ys)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SIG)


def _collect(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_results_invariant_to_partitions_and_order(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    outs = []
    try:
        for parts, seed_order in ((3, 0), (17, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            df = _frame(spark, 7).orderBy(F.rand(seed_order)).repartition(parts)
            mul = _collect(pointwise.multiply(df, ["a", "b", "c"]), ["version", "i", "y"])
            st = _collect(stats.trace_stats(df), ["version", "trace", "n", "min", "max"])
            prm = spark.createDataFrame([("p", t, "9", 2) for t in "abc"],
                                        "project string, trace string, window_length string, polyorder int")
            sg = _collect(filters.savgol(df, prm, min_chunk=100 * (1 + seed_order)), ["version", "trace", "i", "y"])
            outs.append((mul, st, sg))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    (m1, s1, g1), (m2, s2, g2) = outs
    assert m1 == m2 and s1 == s2
    assert len(g1) == len(g2) == 2 * (900 + 700 + 1200)
    assert max(abs(a[3] - b[3]) for a, b in zip(g1, g2)) < 1e-9
