"""Property tests (hypothesis): radix decoding round-trips."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavespark.functions import radix as R

WORDS = {16: "HEX", 8: "OCTAL", 2: "BIN", 10: "SIGNED"}


def _text(v: int, base: int, upper: bool) -> str:
    digits = {16: format(abs(v), "x"), 8: format(abs(v), "o"), 2: format(abs(v), "b"), 10: str(abs(v))}[base]
    digits = digits.upper() if upper else digits
    return ("-" if v < 0 else "") + digits


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**63) + 1, 2**63 - 1), st.sampled_from([16, 8, 2, 10]),
                          st.booleans()), min_size=1, max_size=40))
def test_decode_roundtrip(spark, cases):
    rows = [(_text(v, b, up), WORDS[b].lower() if up else WORDS[b], v) for v, b, up in cases]
    df = spark.createDataFrame(rows, "cell string, word string, v long")
    got = df.select(R.decode(F.col("cell"), R.base_of(F.upper(F.trim("word")))).alias("d"), "v").collect()
    assert all(r.d == r.v for r in got)


@pytest.mark.parametrize("cell,word", [("8000000000000000", "HEX"), ("9223372036854775808", "SIGNED"),
                                       ("2", "BIN"), ("8", "OCTAL"), (" 5", "SIGNED"), ("0x1F", "HEX")])
def test_decode_rejects(spark, cell, word):
    df = spark.createDataFrame([(cell, word)], "cell string, word string")
    with pytest.raises(Exception):
        df.select(R.decode(F.col("cell"), R.base_of(F.col("word")))).collect()


SIG = "project string, version int, trace string, i long, x double, y double, domain string"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=0, max_size=12),
                min_size=1, max_size=3),
       st.lists(st.integers(0, 2), min_size=1, max_size=4),
       st.sampled_from(["add", "multiply"]))
def test_pointwise_matches_python_fold(spark, traces, picks, op):
    from functools import reduce

    from wavespark.operators import pointwise
    names = [f"t{k}" for k in range(len(traces))]
    sources = [names[p % len(names)] for p in picks]
    rows = [("p", 1, n, i, float(i), v, "TIME") for n, ys in zip(names, traces) for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, SIG)
    fn = pointwise.add if op == "add" else pointwise.multiply
    got = {r.i: r.y for r in fn(df, sources).collect()}
    n = min(len(traces[names.index(s)]) for s in sources)
    assert set(got) == set(range(n))
    for i in range(n):
        vals = [traces[names.index(s)][i] for s in sources]
        want = None if any(v is None for v in vals) else reduce(
            (lambda a, b: a + b) if op == "add" else (lambda a, b: a * b), vals)
        assert got[i] == want
