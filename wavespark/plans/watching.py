"""Registered queries on watched sources, loads at once and version
comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..operators import compare, signal, stats
from ..operators.indexing import dense_index
from ..session import qualified, scratch_path
from ..sources import store as STORE
from ..streaming import changes as CH
from . import fixtures as FX
from . import sqlparts as S
from .catalog import (_CAP_TRACES, _FR, _SEL_SQL, _bucket_of, _compare_sql, _r, _raw_signal, _sym_sql, ingest_orders, register,
                      rnd)
from .fixtures import fixture_store


def _samples_sql(columns: str, source: str) -> str:
    return "\nUNION ALL ".join(f"SELECT {columns}, '{t}' AS trace, idx AS i, CAST({e} AS BIGINT) AS y_raw FROM {source}"
                               for t, e in _CAP_TRACES)


# --------------------------------------------------------------------------
# S14 on paths that are written again, S7 by two loads at once

ROUNDS = 3


@register("watch_overwritten", f"""WITH {_FR},
b AS (SELECT bucket, dense_rank() OVER (ORDER BY bucket) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT bucket FROM fr)),
loads AS (SELECT k, version, (k + turn) % n AS content FROM b, (VALUES (0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 2))
          AS v(odd, version, turn) WHERE k % 2 = odd),
cells AS (SELECT l.k, l.version, fr.* FROM loads l JOIN b ON b.k = l.content JOIN fr ON fr.bucket = b.bucket)
""" + _samples_sql("'source ' || k AS project, CAST(version AS INTEGER) AS version", "cells"))
def q_watch_overwritten(spark, sf):
    """S14 on files written again: every source (a project of its own) is
    written three times; the first change is accepted, the second declined for
    every other source, the third accepted.  Each round is a restart of the
    query from its checkpoint."""
    src = FX.write_order_captures(spark, sf, scratch_path(spark, "captures"))
    held = dense_index(STORE.list_captures(spark, f"{src}/*/*.txt").select("file"), [], ["file"], "k")
    n = held.count()
    landing, said, ckpt = (scratch_path(spark, x) for x in ("watched", "decisions", "watch-ckpt"))
    store = STORE.Store(scratch_path(spark, "watch-store"))
    project = F.concat(F.lit("source "), F.regexp_extract("file", r"/(\d+)\.txt$", 1).cast("int").cast("string"))
    for turn in range(ROUNDS):
        FX.copy_over(held.select(F.col("file").alias("source"), F.format_string(
            f"{qualified(spark, landing)}/%05d.txt", F.pmod(F.col("k") - turn, F.lit(n).cast("bigint"))).alias("target")))
        what = F.when(F.lit(turn == 1) & (F.col("id") % 2 == 1), CH.DECLINE).otherwise(CH.ACCEPT)
        CH.write_decisions(spark, said, spark.range(n).select(
            F.format_string(f"{landing}/%05d.txt", "id").alias("file"), F.lit(str(turn)).alias("at"), what.alias("decision")))
        CH.start_watch(spark, landing, store, project, ckpt, decisions=said).awaitTermination()
    return store.samples(spark).select("project", "version", "trace", "i", "y_raw")


@register("concurrent_loads", f"""WITH {_FR}, n AS (SELECT count(DISTINCT bucket) AS versions FROM fr),
cells AS (SELECT * FROM fr, n)
""" + _samples_sql("'shared' AS project, bucket, versions AS first_to_last", "cells"))
def q_concurrent_loads(spark, sf):
    """S7 by two loads at once into one project: each claims versions of its
    own, so all captures are there and the numbers run from 1 without a gap."""
    src = FX.write_order_captures(spark, sf, scratch_path(spark, "captures"))
    files = STORE.list_captures(spark, f"{src}/*/*.txt")
    halves = [[r[0] for r in files.where(_bucket_of("file") % 2 == half).select("file").collect()] for half in (0, 1)]
    store = STORE.Store(scratch_path(spark, "shared-store"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda paths: paths and STORE.ingest_changed(spark, store, paths, "shared").count(), halves))
    caps = store.captures(spark)
    span = caps.groupBy("project").agg((F.max("version") - F.min("version") + 1).cast("bigint").alias("first_to_last"))
    return store.samples(spark).join(caps.select("project", "version", "source_uri"), ["project", "version"]).join(
        span, "project").select("project", _bucket_of("source_uri").alias("bucket"), "first_to_last", "trace", "i", "y_raw")


# --------------------------------------------------------------------------
# J7 beyond two fixed versions, A7 with two versions in one plot

def _compared(df):
    return df.select("project", "trace", "k", rnd("y_a").alias("y_a"), rnd("y_b").alias("y_b"), rnd("diff").alias("diff"))


@register("version_compare_index", S.with_(S.F2W, S.F2, S.REG, S.T0, _compare_sql("i", "3", "5")))
def q_version_compare_index(spark, sf):
    """J7 by sample number instead of by trigger."""
    sig, st = _raw_signal(spark, sf, "lineitem")
    return _compared(compare.compare_versions(sig, st.captures(spark), 3, 5, align="index"))


@register("version_compare_latest", S.with_(S.F2W, S.F2, S.REG, S.T0, _compare_sql(
    "i - t0_index", "(SELECT max(version) FROM f2w)", "(SELECT max(version) - 1 FROM f2w)")))
def q_version_compare_latest(spark, sf):
    """J7's shortcut: the latest version and the one before."""
    sig, st = _raw_signal(spark, sf, "lineitem")
    a, b = compare.latest_and_previous(sig, st.captures(spark), "lineitem")
    return _compared(compare.compare_versions(sig, st.captures(spark), a, b))


@register("legend_versions", _SEL_SQL + f"""
SELECT l.project, l.version, l.trace,
       g.label || ' # ' || l.version || string_agg(', $' || {_sym_sql()} || '=' || CAST(round_even(l.value, 2) AS VARCHAR) || '$', ''
                                                   ORDER BY r.stat_pos) AS legend
FROM lng l JOIN reg_stats r ON r.project = l.project AND r.trace = l.trace AND r.stat = l.stat
JOIN reg g ON g.project = l.project AND g.trace = l.trace
JOIN (SELECT project, max(version) AS latest FROM st GROUP BY project) m ON m.project = l.project AND l.version >= m.latest - 1
GROUP BY l.project, l.version, l.trace, g.label""")
def q_legend_versions(spark, sf):
    """A7 of a plot with two versions of a trace (latest and previous), whose
    lines tell them apart."""
    st = fixture_store(spark, sf)
    reg, cap = st.registry(spark), st.captures(spark)
    latest = cap.groupBy("project").agg(F.max("version").alias("_latest"))
    smp = st.samples(spark).where(F.col("project").isin("events", "lineitem")).join(latest, "project").where(
        F.col("version") >= F.col("_latest") - 1).drop("_latest")
    s = stats.trace_stats(signal.signal_frame(smp, reg, cap, st.projects(spark)))
    s = s.select("project", "version", "trace", *[rnd(c).alias(c) for c in stats.STAT_FUNCTIONS])
    return stats.legend_text(stats.selected_stats(s, reg), reg, style="plot", show_version=True)


@register("legacy_notes", f"""WITH {_FR}, t(trace, price) AS (VALUES ('TRIGGER', 0), ('orders/key[31:0]', 0), ('orders/price', 1)),
v AS (SELECT bucket, count(*) AS n FROM fr GROUP BY bucket)
SELECT '007' AS project, CAST(bucket + 1 AS INTEGER) AS version, trace,
       CASE WHEN price = 1 THEN '' ELSE n || ' orders' END AS note FROM v, t""")
def q_legacy_notes(spark, sf):
    """S11 from a project folder of the earlier layout: each version's
    ``config.json`` maps traces to their notes (absent: empty)."""
    d = FX.write_legacy_notes(spark, sf, scratch_path(spark, "legacy-notes"))
    return STORE.read_legacy_notes(spark, d, "007")


# --------------------------------------------------------------------------
# A1-A5 of ingested captures

@register("capture_stats", f"WITH {_FR}, cells AS (SELECT * FROM fr), s AS (\n" + _samples_sql("bucket", "cells") + f""")
SELECT bucket, trace, count(y_raw) AS n, CAST(min(y_raw) AS DOUBLE) AS "min", CAST(max(y_raw) AS DOUBLE) AS "max",
       CAST(max(y_raw) - min(y_raw) AS DOUBLE) AS "range", {_r("avg(y_raw)")} AS mean, {_r("stddev_pop(y_raw)")} AS stdev
FROM s GROUP BY bucket, trace""")
def q_capture_stats(spark, sf):
    """The statistics of every trace of every version of an ingested project:
    ingest wrote them by blocks, so no sample is read."""
    store = ingest_orders(spark, sf)
    out = stats.stats_of_blocks(store.block_stats(spark), store.registry(spark))
    caps = store.captures(spark).select("project", "version", _bucket_of("source_uri").alias("bucket"))
    return out.join(caps, ["project", "version"]).select(
        "bucket", "trace", "n", "min", "max", "range", rnd("mean").alias("mean"), rnd("stdev").alias("stdev"))
