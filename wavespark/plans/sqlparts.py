"""SQL text of the fixture tables for the DuckDB oracle.

The same definitions as :mod:`wavespark.plans.fixtures`, written as plain SQL
(``row_number`` is fine for a single-node oracle at sf0.01).
"""

from __future__ import annotations

from .fixtures import LINEITEM_ORDER, LINEITEM_VALUES, PROJECTS, _REG


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


F1 = """f1 AS (
  SELECT 'events' AS project, CAST(version AS INTEGER) AS version, event_type AS trace,
         row_number() OVER (PARTITION BY version, event_type ORDER BY event_id) - 1 AS i,
         CAST(value AS DOUBLE) AS y_raw
  FROM (SELECT *, CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END AS version
        FROM events) e)"""

F2W = f"""f2w AS (
  SELECT CAST(year(l_shipdate) - 1994 AS INTEGER) AS version,
         row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY {", ".join(LINEITEM_ORDER)}) - 1 AS i,
         {", ".join(LINEITEM_VALUES)},
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS trig
  FROM lineitem)"""

F2 = "f2 AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT 'lineitem' AS project, version, '{c}' AS trace, i, CAST({c} AS DOUBLE) AS y_raw FROM f2w"
    for c in LINEITEM_VALUES) + \
    "\n  UNION ALL SELECT 'lineitem', version, 'TRIGGER', i, CAST(trig AS DOUBLE) FROM f2w)"

F3 = """f3 AS (
  SELECT 'embeddings' AS project, 1 AS version, CAST(vec_id AS VARCHAR) AS trace,
         CAST(u.pos - 1 AS BIGINT) AS i, CAST(u.v AS DOUBLE) AS y_raw
  FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos))"""

REG = "reg(project, trace, label, state, y_scale, y_offset, ord) AS (VALUES " + ", ".join(
    "(" + ", ".join(_lit(v) for v in (p, t, lab, st, sc, off, o)) + ")"
    for (p, t, lab, st, sc, off, _s, _f, _src, _pa, o) in _REG) + ")"

STATS_LIST = "reg_stats(project, trace, stat_pos, stat) AS (VALUES " + ", ".join(
    f"({_lit(p)}, {_lit(t)}, {k}, {_lit(s)})"
    for (p, t, _l, _st, _sc, _o, stats, *_rest) in _REG for k, s in enumerate(stats)) + ")"

PRJ = "prj(project, implied_dt, dt_unit) AS (VALUES " + ", ".join(
    f"({_lit(p)}, {_lit(dt)}, {_lit(u)})" for (p, dt, u, _d) in PROJECTS) + ")"

T0 = """t0 AS (
  SELECT project, version,
         CAST(CASE WHEN count(*) > 2
              THEN coalesce(min(CASE WHEN i >= 1 AND y_raw <> 0 THEN i - 1 END), 0)
              ELSE 0 END AS BIGINT) AS t0_index
  FROM f2 WHERE trace = 'TRIGGER' GROUP BY project, version)"""


def signal(src: str, name: str) -> str:
    """Signal frame CTE ``name`` over raw CTE ``src`` (needs reg, prj, t0)."""
    return f"""{name} AS (
  SELECT s.project, s.version, s.trace, s.i,
         coalesce(p.implied_dt, 1.0) * CAST(s.i - coalesce(t.t0_index, 0) AS DOUBLE) AS x,
         coalesce(r.y_scale, 1.0) * s.y_raw + coalesce(r.y_offset, 0.0) AS y
  FROM {src} s
  LEFT JOIN reg r ON r.project = s.project AND r.trace = s.trace
  LEFT JOIN t0 t ON t.project = s.project AND t.version = s.version
  LEFT JOIN prj p ON p.project = s.project)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [F1, F2W, F2, REG, PRJ, T0, signal("f1", "s1"), signal("f2", "s2")]
