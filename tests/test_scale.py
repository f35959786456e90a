"""Steps whose memory, traffic or time must not grow with one trace, document
or project."""

import io
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from wavespark import schemas as SC
from wavespark.functions import radix, units
from wavespark.operators import blocks, spectrum, views
from wavespark.plans import fixtures, viewing
from wavespark.session import qualified
from wavespark.sources import config


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _tables(spark, folder: str) -> str:
    """A few rows of each table that the fixture store is made of."""
    day = datetime(2024, 1, 1)
    events = [(k, day + timedelta(days=k % 30), k, fixtures.EVENT_TYPES[k % 5], float(k % 7), "") for k in range(300)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{folder}/events.parquet")
    lines = [(k, k % 9, k % 4, 1, 1.0 + k % 5, 100.0 + k, 0.01 * (k % 10), 0.02, "RAN"[k % 3], "O", datetime(1995 + k % 7, 3, 1))
             for k in range(140)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, [0.5, 1.5, float(k)], 0) for k in range(4)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_domain_check_counts_materialised_samples(spark, tmpdir_fresh):
    sf = _tables(spark, f"{tmpdir_fresh}/tables")
    got = {(r["view_name"], r["row"], r["column"]): r for r in viewing.q_domain_check(spark, sf).collect()}
    # 20 lines in each of seven years: versions 1 and 7 of the price
    assert got["prices", 0, 0]["n_samples"] == 40 and got["prices", 0, 0]["compatible"]
    assert got["mixed", 0, 1]["n_samples"] > 0 and not got["mixed", 0, 1]["compatible"]


def test_fixture_sink_sorts_a_trace_at_a_time(spark, tmpdir_fresh):
    sf = _tables(spark, f"{tmpdir_fresh}/tables")
    assert "Expand" not in _plan(fixtures.lineitem_samples(spark, sf))  # five rows a line in one sort
    st = fixtures.fixture_store(spark, sf)
    rows = st.samples(spark).where("project = 'embeddings'").orderBy("trace", "i").collect()
    assert [(r["version"], r["trace"], r["i"], r["y_raw"]) for r in rows] == [
        (1, str(k), i, y) for k in range(4) for i, y in enumerate((0.5, 1.5, float(k)))]
    assert st.samples(spark).where("project = 'lineitem'").groupBy("trace").count().where("count = 140").count() == 5


def test_long_documents_go_on(spark, tmpdir_fresh):
    root = f"{tmpdir_fresh}/projects"
    rows = spark.range(8).select(F.lit("p").alias("project"), F.col("id").alias("ord"), F.to_json(
        F.struct(F.format_string("t%d", "id").alias("name"), F.lit("a").alias("label"))).alias("value"))

    def export(df):
        out = config.export_documents(df, root, config.REGISTRY_FILE, '{"before": %d, "traces": [', "]}", items=3).collect()
        back = config.read_registry(spark, root).orderBy("ord").collect()
        return [tuple(r) for r in out], [(r["ord"], r["trace"]) for r in back]

    def documents():
        return sorted(r[0].rsplit("/", 1)[1] for r in spark.read.format("binaryFile").load(f"{root}/p/data").select("path").collect())

    assert export(rows) == ([("p", 8)], [(k, f"t{k}") for k in range(8)])
    assert documents() == ["config.00001.json", "config.00002.json", "config.json"]
    assert export(rows.where("ord < 4")) == ([("p", 4)], [(k, f"t{k}") for k in range(4)])
    assert documents() == ["config.00001.json", "config.json"]


def test_radix_expression_is_small(spark):
    df = spark.createDataFrame([("1F", 16), ("-1f", 16), ("+17", 8), ("101", 2), ("-5", 10), ("+5", 10), ("", 16), (None, 10)],
                               "c string, b int")
    out = df.select(radix.decode(F.col("c"), F.col("b")).alias("v"))
    assert [r["v"] for r in out.collect()] == [31, -31, 15, 5, -5, 5, None, None]
    assert _plan(out).count("conv(") == 3


def test_pieces_of_long_traces(spark):
    assert spectrum._width(2048, 128) == 64 and spectrum._width(8, 64) == 8
    assert spectrum._width(1 << 20, spectrum.BUNDLE) == 1
    import pyarrow as pa
    schema = pa.schema([("k", pa.int64()), ("y", pa.list_(pa.float64()))])
    many = [b.num_rows for b in blocks._batches(({"k": k, "y": np.zeros(1)} for k in range(1000)), schema)]
    long = [b.num_rows for b in blocks._batches(({"k": k, "y": np.zeros(blocks.OUT_VALUES // 2)} for k in range(5)), schema)]
    assert sum(many) == 1000 and max(many) <= blocks.OUT_ROWS and long == [2, 2, 1]


def test_copies_are_made_in_tasks(spark, tmpdir_fresh):
    at = qualified(spark, tmpdir_fresh)
    for k in range(3):
        with open(f"{tmpdir_fresh}/a{k}", "w") as f:
            f.write(f"text {k}")
    fixtures.copy_over(spark.range(3).select(F.format_string(f"{at}/a%d", "id").alias("source"),
                                             F.format_string(f"{at}/b%d", "id").alias("target")))
    assert [open(f"{tmpdir_fresh}/b{k}").read() for k in range(3)] == ["text 0", "text 1", "text 2"]


def test_py_repr_is_small(spark):
    vals = [900.01, -0.0, 0.0, 0.001, 0.00099, -0.00012, 9999999.9, 1e7, -12345678.5, 1e16, 1e-5, -2.5e-300, 1e300,
            float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in [*vals, float("nan"), None]], "v double")
    out = df.select(units.py_repr("v"))
    assert [r[0] for r in out.collect()] == [*map(repr, vals), "nan", None]
    assert _plan(out).count("regexp_extract(") < 20


def test_samples_of_views_are_not_sorted_by_trace(spark):
    v = views.add_spec(views.create_view(spark.createDataFrame([], SC.VIEWS), "p", "v", 1, 1, "v"), "p", "v", 0, 0, "t", 1)
    reg = spark.createDataFrame([("p", "t", "T", "Active", 1.0, 0.0, None, [], None, 0)], SC.REGISTRY)
    cap = spark.createDataFrame([("p", 1, 0)], "project string, version int, t0_index bigint")
    prj = spark.createDataFrame([("p", 1.0, "ms", "")], SC.PROJECTS)
    sig = spark.createDataFrame([("p", 1, "t", i, float(i), float(i), "TIME") for i in range(5)],
                                "project string, version int, trace string, i long, x double, y double, domain string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = views.materialize(v, sig, reg, cap, prj, with_overlay=False)
        joins = [line.split("[")[0].strip() for line in _plan(rows).splitlines() if "Join" in line and "[project" in line and "version" in line]
        assert rows.count() == 5
        assert joins and all("BroadcastHashJoin" in j for j in joins[:2])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
