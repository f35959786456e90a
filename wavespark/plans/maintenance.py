"""Registered queries on loading, catalogue and view maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions import units as U
from ..operators import registry as REG
from ..operators import views as VW
from ..session import scratch_path
from ..sources import capture as CAP
from ..sources import config as CFG
from ..sources import store as STORE
from . import fixtures as FX
from . import sqlparts as S
from .catalog import _CAP_TRACES, _EMB_REG, _FR, _bucket_of, _emb_registry, _raw_signal, register
from .fixtures import fixture_store

_VALUES = ", ".join("('" + t.replace("'", "''") + f"', {k})" for k, (t, _) in enumerate(_CAP_TRACES))


def _loaded(spark, sf, project):
    src = FX.write_order_captures(spark, sf, scratch_path(spark, "landing"))
    store = STORE.Store(scratch_path(spark, "store"))
    STORE.ingest_changed(spark, store, f"{src}/*/*.txt", project)
    return src, store


@register("second_load", f"""WITH {_FR}, t(trace, ord) AS (VALUES {_VALUES}),
n AS (SELECT count(*) AS rows FROM fr WHERE bucket = 0), v AS (SELECT count(DISTINCT bucket) + 1 AS versions FROM fr)
SELECT '007' AS project, CAST(0 AS BIGINT) AS bucket, trace, CASE WHEN trace = 'TRIGGER' THEN 'checked' ELSE '' END AS note,
       CAST(versions AS INTEGER) AS version, rows AS n_samples, CAST(8 AS BIGINT) AS registry_rows, CAST(0 AS BIGINT) AS idle_load
FROM t, n, v""")
def q_second_load(spark, sf):
    """S6, S7, S10, S11 beyond a first load, in a project called 007: nothing
    changed (no version), then one of the files changed (one version, notes of
    the latest version carried on, registry as it was)."""
    src, store = _loaded(spark, sf, "007")
    idle = STORE.ingest_changed(spark, store, f"{src}/*/*.txt", "007").count()
    caps = store.captures(spark)
    latest = caps.agg(F.max("version")).first()[0]
    notes = scratch_path(spark, "notes")
    STORE.set_note(store.notes(spark), "007", latest, "TRIGGER", "checked").write.mode("overwrite").parquet(notes)
    spark.read.schema(SC.NOTES).parquet(notes).write.mode("overwrite").parquet(store.path("notes"))
    lines = CAP.read_lines(spark, f"{src}/*/*.txt")
    touched = F.when(_bucket_of("file") == 0, F.col("mtime") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("mtime"))
    new = STORE.ingest(spark, store, lines.withColumn("mtime", touched), "007")
    n = store.registry(spark).groupBy("project").agg(F.count("*").alias("registry_rows"))
    return (new.join(store.notes(spark), ["project", "version"]).join(n, "project")
            .select("project", _bucket_of("source_uri").alias("bucket"), "trace", "note", "version", "n_samples",
                    "registry_rows", F.lit(idle).cast("bigint").alias("idle_load")))


@register("registry_bootstrap", f"""WITH {_FR}, t(trace, ord) AS (VALUES {_VALUES})
SELECT '007' AS project, trace, trace AS label, 'Active' AS state, CAST(1.0 AS DOUBLE) AS y_scale,
       CAST(0.0 AS DOUBLE) AS y_offset, ord, (SELECT count(*) FROM fr) AS n_samples FROM t""")
def q_registry_bootstrap(spark, sf):
    """The registry rows of a first load, with each trace's samples over
    all versions (a project name of digits stays a name)."""
    _, store = _loaded(spark, sf, "007")
    n = store.samples(spark).groupBy("project", "trace").agg(F.count("*").alias("n_samples"))
    return store.registry(spark).join(n, ["project", "trace"]).select(
        "project", "trace", "label", "state", "y_scale", "y_offset", "ord", "n_samples")


@register("snapshot_columns", f"WITH {_FR}\n" + "\nUNION ALL ".join(
    f"SELECT '007' AS project, CAST(bucket + 1 AS INTEGER) AS version, '{t}' AS trace, idx AS i, CAST({e} AS BIGINT) AS y_raw, "
    f"CAST(bucket AS BIGINT) AS t0_index FROM fr" + (f" WHERE bucket % 2 = {k}" if k is not None else "")
    for t, e, k in [("TRIGGER", "trig", None), ("orders/key[31:0]", "o_orderkey", None),
                    ("orders/cust[15:0]", "o_custkey", 0), ("orders/price", "price", 1)]))
def q_snapshot_columns(spark, sf):
    """S8 with versions of different columns, and t0 from ``trigger.json``."""
    d = FX.write_legacy_snapshots(spark, sf, scratch_path(spark, "legacy"), alternate=True)
    t0 = STORE.read_legacy_captures(spark, d, "007")
    return STORE.read_legacy_project(spark, d, "007").join(t0, ["project", "version"])


@register("registry_lookup", f"""WITH {_EMB_REG},
r2 AS (SELECT project, trace, CASE WHEN ord % 3 = 0 THEN CAST(ord + 1 AS VARCHAR) ELSE label END AS label, ord FROM ereg),
ref AS (SELECT project, trace AS ref FROM r2 UNION SELECT project, label FROM r2 UNION SELECT project, trace || '?' FROM r2),
hit AS (SELECT f.project, f.ref, r.trace, r.label, r.ord FROM ref f JOIN r2 r
        ON r.project = f.project AND (r.trace = f.ref OR r.label = f.ref))
SELECT *, CAST(row_number() OVER (PARTITION BY project, ref ORDER BY ord) AS INTEGER) AS nth FROM hit""")
def q_registry_lookup(spark, sf):
    """Every name and label looked up, some of which fit two traces."""
    reg = _emb_registry(spark, sf)
    reg = reg.withColumn("label", F.when(F.col("ord") % 3 == 0, (F.col("ord") + 1).cast("string")).otherwise(F.col("label")))
    refs = reg.select("project", F.col("trace").alias("ref")).union(reg.select("project", "label")).union(
        reg.select("project", F.concat("trace", F.lit("?"))))
    return REG.lookup(refs, reg).select("project", "ref", "trace", "label", "ord", "nth")


_DU = ["ps", "ns", "us", "ms", "s"]
_SEC = ["1e-12", "1e-9", "1e-6", "1e-3", "1.0"]


@register("units_compare", f"""
WITH q AS (SELECT p_partkey, p_size, p_retailprice, [{", ".join(_SEC)}][p_partkey % 5 + 1] AS s,
                  ['{"', '".join(_DU)}'][p_partkey % 5 + 1] AS u FROM part)
SELECT p_partkey, CAST(p_retailprice AS VARCHAR) || ' ' || u AS text,
       floor((p_retailprice - CAST(p_size AS DOUBLE) * 1e-3 / s) / greatest(p_retailprice, CAST(p_size AS DOUBLE) * 1e-3 / s) * 1e9 + 0.5) / 1e9 AS minus,
       p_size = p_size AS same, p_size <= p_size AS at_most, p_size < CAST(p_size AS DOUBLE) * s / s AS below,
       p_retailprice < CAST(p_size AS DOUBLE) * 1e-3 / s AS less, (u = 'ms' OR p_size = CAST(p_size AS DOUBLE) * 1e-3 / s) AS is_ms
FROM q""")
def q_units_compare(spark, sf):
    """U7 subtract, U8 <, <= and ==, U9 text, all on durations."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    unit = F.element_at(F.array(*[F.lit(u) for u in _DU]), (F.col("p_partkey") % 5 + 1).cast("int"))
    q = p.select("p_partkey", U.quantity(F.col("p_retailprice").cast("double"), unit).alias("a"),
                 U.quantity(F.col("p_size").cast("double"), F.lit("ms")).alias("b"),
                 U.quantity(F.col("p_size").cast("double"), unit).alias("c"))
    rel = U.sub("a", "b", "duration")["value"] / F.greatest(F.col("a.value"), U.duration_as("b", F.col("a.unit")))
    return q.select("p_partkey", U.format_quantity("a").alias("text"),
                    (F.floor(rel * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("minus"),
                    U.eq("c", "c", "duration").alias("same"), U.le("c", "c", "duration").alias("at_most"),
                    U.lt("c", "c", "duration").alias("below"), U.lt("a", "b", "duration").alias("less"),
                    U.eq("c", "b", "duration").alias("is_ms"))


@register("source_dispatch", f"""WITH {_FR}
SELECT bucket, count(*) * 8 AS cells, CAST(sum(o_orderkey) AS BIGINT) AS keys, 'CSVFile' AS kind, 'kept' AS again, 'refused' AS other
FROM fr GROUP BY bucket""")
def q_source_dispatch(spark, sf):
    """A source set on an empty project, loaded, set again to the same
    path (kept) and to another (refused)."""
    src = FX.write_order_captures(spark, sf, scratch_path(spark, "captures"))
    cfg = CAP.check_source_change(CAP.NULL_SOURCE, f"{src}/*/*.txt", 0)
    again = "kept" if CAP.check_source_change(cfg, cfg["path"], 1) is cfg else "changed"
    try:
        CAP.check_source_change(cfg, "elsewhere", 1)
        other = "accepted"
    except RuntimeError:
        other = "refused"
    data = CAP.load_source(spark, cfg)
    key = F.when(F.col("trace") == "orders/key[31:0]", F.col("y_raw"))
    return data.groupBy(_bucket_of("file").alias("bucket")).agg(F.count("*").alias("cells"), F.sum(key).alias("keys")).select(
        "bucket", "cells", "keys", F.lit(cfg["type"]).alias("kind"), F.lit(again).alias("again"), F.lit(other).alias("other"))


@register("config_layout", f"""WITH {_EMB_REG}
SELECT e.project, trace, label, state, CAST(y_scale AS DOUBLE) AS y_scale, CAST(y_offset AS DOUBLE) AS y_offset, ord,
       CAST(1.0 AS DOUBLE) AS implied_dt, 'ns' AS dt_unit, 'traces ' || ord // 64 AS view_name,
       count(*) OVER (PARTITION BY ord // 64) AS traces_shown
FROM ereg e""")
def q_config_layout(spark, sf):
    """S12, S13 through the layout on disk: ``<project>/project.json``,
    ``<project>/data/config.json`` and ``views.json`` exported, listed and
    scanned again."""
    st = fixture_store(spark, sf)
    reg = _emb_registry(spark, sf)
    root = scratch_path(spark, "projects")
    CFG.export_projects(st.projects(spark).where("project = 'embeddings'"), root)
    CFG.export_registry(reg, root)
    block = F.concat(F.lit("traces "), F.floor(F.col("ord") / 64).cast("string")).alias("view_name")
    spec = F.struct(F.col("trace").alias("name"), F.lit(-1).alias("trace_version"), F.lit("left").alias("on_axis"),
                    F.lit("auto").alias("color"), F.lit(False).alias("show_filtered_trace"), F.lit(False).alias("show_legends"))
    plot = F.struct(F.lit(0).alias("row"), F.lit(0).alias("column"), F.lit("").alias("left_axis_label"),
                    F.lit("").alias("right_axis_label"), F.lit("").alias("x_axis_label"), F.lit(False).alias("show_grid"),
                    F.lit("None").alias("legend_location"), F.collect_list(spec).alias("traces"))
    v = reg.groupBy("project", block).agg(F.lit("Traces").alias("title"), F.lit(1).alias("num_rows"),
                                          F.lit(1).alias("num_columns"), F.array(plot).alias("sub_plots"))
    CFG.export_views(v, root)
    names = CFG.list_project_names(spark, root)
    shown = VW.specs(CFG.read_views(spark, root)).groupBy("project", "view_name").agg(F.count("*").alias("traces_shown"))
    prj = CFG.read_projects(spark, root).select("project", "implied_dt", "dt_unit")
    back = CFG.read_registry(spark, root)
    return (back.withColumn("view_name", block).join(names, "project").join(prj, "project").join(shown, ["project", "view_name"])
            .select("project", "trace", "label", "state", "y_scale", "y_offset", "ord", "implied_dt", "dt_unit",
                    "view_name", "traces_shown"))


@register("view_maintenance", S.with_(*S.BASE) + """
SELECT 'lineitem' AS project, v.view_name, v.title, v.trace, s.version, count(*) AS n_samples
FROM s2 s JOIN (VALUES ('after', 'New title', 'l_tax'), ('Traces', 'Traces', 'l_quantity'), ('Traces', 'Traces', 'l_discount'))
  AS v(view_name, title, trace) ON v.trace = s.trace
WHERE s.version = (SELECT max(version) FROM s2) GROUP BY ALL""")
def q_view_maintenance(spark, sf):
    """R9 rename, title and delete; R14 view of a selection; then R13."""
    sig, st = _raw_signal(spark, sf, "lineitem")
    v = spark.createDataFrame([], SC.VIEWS)
    for name in ("before", "gone"):
        v = VW.create_view(v, "lineitem", name, 1, 1, name)
        v = VW.add_spec(v, "lineitem", name, 0, 0, "Tax")
    v = VW.delete_view(VW.set_title(VW.rename_view(v, "lineitem", "before", "after"), "lineitem", "after", "New title"),
                       "lineitem", "gone")
    v = v.unionByName(VW.adhoc_view(spark, "lineitem", ["l_quantity", "Discount"]))
    v = spark.createDataFrame(v.collect(), SC.VIEWS)  # two rows of metadata
    rows = VW.materialize(v, sig, st.registry(spark), st.captures(spark), st.projects(spark), with_overlay=False)
    return rows.join(F.broadcast(v.select("project", "view_name", "title")), ["project", "view_name"]).groupBy(
        "project", "view_name", "title", "trace", "version").agg(F.count("*").alias("n_samples"))
