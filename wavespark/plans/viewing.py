"""Registered queries on views: every fixture view row by row, and many views
generated from ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as SC
from ..operators import views as VW
from . import sqlparts as S
from .catalog import (ORACLE, _F1_EVT, _TAX6, _VIEW_RAW_SQL, _dft_sql, _r, _savgol_sql, _view_inputs, q_view_cells, register,
                      rnd)
from .fixtures import _REG, fixture_store

# --------------------------------------------------------------------------
# R13 over all views

_SPECTRA = _dft_sql("SELECT version, trace, i, y FROM s1 WHERE trace = 'click' AND version IN (2, 3)",
                    "'click_spectrum'", _F1_EVT, "events").replace(
    "\nSELECT 'events' AS project,", ",\nspc AS (SELECT 'events' AS project,") + ")"
_SAVGOL = _savgol_sql("tax6", "5").replace(
    "\nSELECT a.project, a.version, a.trace, a.i,", ",\nsg AS (SELECT a.project, a.version, a.trace, a.i,") + ")"


@register("view_rows", S.with_(*S.BASE, _TAX6, _SAVGOL, _SPECTRA) + "SELECT v.*, 'us' AS x_unit FROM (" + _VIEW_RAW_SQL + f"""
UNION ALL
SELECT 'lineitem', 'prices', 1, 0, 0, trace, version, 'left', 'overlay', i, x, y_overlay FROM sg) v
UNION ALL
SELECT 'events', 'mixed', 0, 0, 0, trace, version, 'left', 'raw', i, x, y, 'Hz' FROM spc WHERE version = 3
UNION ALL
SELECT 'events', 'mixed', 0, 1, 0, trace, version, 'left', 'raw', i, {_r("x")}, {_r("y")}, 'ms'
FROM s1 WHERE trace = 'click' AND version = 3
UNION ALL
SELECT 'events', 'mixed', 0, 1, 1, trace, version, 'left', 'raw', i, x, y, 'Hz' FROM spc WHERE version = 2""")
def q_view_rows(spark, sf):
    """All rows of all views, among them one that holds time and
    frequency traces, each with x in its own unit."""
    rows = VW.materialize(*_view_inputs(spark, sf))
    return rows.select("project", "view_name", F.col("row"), F.col("column"), "spec_pos", "trace", "version",
                       "on_axis", "series", "i", rnd("x").alias("x"), rnd("y").alias("y"), "x_unit")


# --------------------------------------------------------------------------
# R12, R15 over generated views: one for every 64 customer keys

#: What specs call traces: names, labels and one that is neither.
CALLED = {p: [x for r in _REG if r[0] == p for x in (r[1], r[2])] + ["nothing"] for p in ("events", "lineitem")}
VIEW_KEYS, COLUMNS = 64, 2

_GENERATED = f"""
called(project, n, nth, name) AS (VALUES {", ".join(f"('{p}', {len(c)}, {i}, '{x}')" for p, c in CALLED.items() for i, x in enumerate(c))}),
cust AS (SELECT c_custkey AS key, c_custkey // {VIEW_KEYS} AS view FROM customer),
grid AS (SELECT DISTINCT view, CASE WHEN view % 2 = 0 THEN 'events' ELSE 'lineitem' END AS project, 1 + view % 3 AS rows FROM cust),
cells AS (SELECT view, project, cell, cell // {COLUMNS} AS r, cell % {COLUMNS} AS c
          FROM (SELECT *, unnest(range(rows * {COLUMNS})) AS cell FROM grid)),
spec AS (SELECT g.view, g.project, key, key // 3 % (rows * {COLUMNS} + 2) AS cell, key % 5 - 2 AS version, l.name
         FROM cust JOIN grid g ON g.view = cust.view JOIN called l ON l.project = g.project AND l.nth = key % l.n WHERE key % 3 = 0),
hit AS (SELECT s.view, s.cell, s.key, s.version, s.name, r.label,
               CASE WHEN r.trace IS NULL THEN NULL WHEN r.trace = 'click_spectrum' THEN 'FREQUENCY' ELSE 'TIME' END AS domain,
               row_number() OVER (PARTITION BY s.view, s.cell, s.key ORDER BY r.ord) AS nth
        FROM spec s LEFT JOIN reg r ON r.project = s.project AND (r.trace = s.name OR r.label = s.name)),
one AS (SELECT * FROM hit WHERE nth = 1)"""


def generated_views(spark, sf):
    """Views of up to six cells from ``customer``: some cells are empty, some
    mix domains, some name a trace twice, by name and label, or not at all."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("key"))
    c = c.withColumn("view", F.floor(F.col("key") / VIEW_KEYS))
    project = F.when(F.col("view") % 2 == 0, "events").otherwise("lineitem")
    grid = c.select("view").distinct().select("view", project.alias("project"), (1 + F.col("view") % 3).cast("int").alias("rows"))
    names = F.when(F.col("project") == "events", F.array(*map(F.lit, CALLED["events"]))).otherwise(
        F.array(*map(F.lit, CALLED["lineitem"])))
    s = c.where("key % 3 = 0").join(grid, "view").withColumn("_names", names)
    s = s.withColumn("cell", F.floor(F.col("key") / 3) % (F.col("rows") * COLUMNS + 2)).withColumn(
        "name", F.expr("_names[int(key % size(_names))]"))
    spec = F.struct(F.col("name"), (F.col("key") % 5 - 2).cast("int").alias("trace_version"), F.lit("left").alias("on_axis"),
                    F.lit("auto").alias("color"), F.lit(False).alias("show_filtered_trace"), F.lit(False).alias("show_legends"))
    traces = s.groupBy("view", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", spec.alias("spec")))),
                                                       lambda x: x["spec"]).alias("traces"))
    cells = grid.select("view", "project", "rows", F.explode(F.sequence(F.lit(0), F.col("rows") * COLUMNS - 1)).alias("cell"))
    cells = cells.join(traces, ["view", "cell"], "left")
    none = F.array().cast(f"array<{SC.TRACE_SPEC.simpleString()}>")
    plot = F.struct(F.floor(F.col("cell") / COLUMNS).cast("int").alias("row"), (F.col("cell") % COLUMNS).cast("int").alias("column"),
                    F.lit("").alias("left_axis_label"), F.lit("").alias("right_axis_label"), F.lit("").alias("x_axis_label"),
                    F.lit(False).alias("show_grid"), F.lit("None").alias("legend_location"),
                    F.coalesce("traces", none).alias("traces"))
    return cells.groupBy("project", F.concat(F.lit("view "), F.col("view").cast("string")).alias("view_name")).agg(
        F.lit("customers").alias("title"), F.first("rows").alias("num_rows"), F.lit(COLUMNS).alias("num_columns"),
        F.sort_array(F.collect_list(plot)).alias("sub_plots"))


@register("domain_check", ORACLE["view_cells"].replace(
    "SELECT t.project, t.view_name, t.\"row\", t.\"column\", t.domain, t.compatible, t.summary,",
    "SELECT t.project, t.view_name, t.\"row\", t.\"column\", t.domain, t.compatible,"))
def q_domain_check(spark, sf):
    """R12 per subplot (with the materialised sample count)."""
    return q_view_cells(spark, sf).drop("summary")


@register("domain_check_generated", f"""WITH {S.REG}, {_GENERATED}
SELECT c.project, 'view ' || c.view AS view_name, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "column",
       arg_min(coalesce(o.domain, '?'), o.key) FILTER (o.key IS NOT NULL) AS first_domain, count(DISTINCT o.domain) <= 1 AS compatible
FROM cells c LEFT JOIN one o ON o.view = c.view AND o.cell = c.cell GROUP BY c.project, c.view, c.r, c.c""")
def q_domain_check_generated(spark, sf):
    """R12 on every cell of the generated views ("?": the first spec names no
    trace; null: an empty cell)."""
    views, reg = generated_views(spark, sf), fixture_store(spark, sf).registry(spark)
    cells = VW.subplot_domains(views, reg)
    filled = VW.specs(views).select("project", "view_name", "row", "column").distinct().withColumn("_some", F.lit("?"))
    return cells.join(filled, ["project", "view_name", "row", "column"], "left").select(
        "project", "view_name", "row", "column", F.coalesce("domain", "_some").alias("first_domain"), "compatible")


@register("view_summary", f"""WITH {S.REG}, {_GENERATED}
SELECT c.project, 'view ' || c.view AS view_name, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "column",
       string_agg(coalesce(o.label, o.name) || ' :: ' || o.version, chr(10) ORDER BY o.key) AS summary
FROM cells c JOIN one o ON o.view = c.view AND o.cell = c.cell GROUP BY c.project, c.view, c.r, c.c""")
def q_view_summary(spark, sf):
    """R15 on every cell of the generated views that has specs."""
    return VW.spec_summary(generated_views(spark, sf), fixture_store(spark, sf).registry(spark))
