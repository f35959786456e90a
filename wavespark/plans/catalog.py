"""Registered queries: Spark plans over the driver's tables and their DuckDB
oracle SQL.  Every floating output is rounded to a common grid on both sides
(aggregation order differs between engines), see ``rnd``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, derive, pointwise, signal, stats
from . import sqlparts as S
from .fixtures import fixture_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DEC = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Grid step of the comparison rounding: 1e6 * sqrt(2) as a double.  Engines
# sum in different orders, so results may differ in the last bits; rounding
# both sides to a grid makes them equal unless a value sits on a grid tie.
# A decimal grid has exact ties for decimal data (x.xxxxxx5), a binary grid
# for float32 data; this step is neither, so ties do not occur in practice.
GRID = 1.414213562373095e6


def rnd(c):
    """``floor(x * GRID + 0.5) / GRID`` -- plain IEEE operations, bit-identical
    in Spark and DuckDB (unlike their ``round``).  NaN and infinities pass."""
    x = F.col(c) if isinstance(c, str) else c
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.floor(x * F.lit(GRID) + F.lit(0.5)) / F.lit(GRID)).otherwise(x)


def _r(e: str) -> str:
    return f"(floor(({e}) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6)"


def _raw_signal(spark, sf, project=None):
    st = fixture_store(spark, sf)
    smp = st.samples(spark)
    if project is not None:
        smp = smp.where(F.col("project") == project)
    return signal.signal_frame(smp, st.registry(spark), st.captures(spark), st.projects(spark)), st


# --------------------------------------------------------------------------
# P5 + P6: linear transform and time axis

@register("linear_transform", S.with_(*S.BASE) + f"""
SELECT project, version, trace, i, (floor((x) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS x, (floor((y) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS y, 'TIME' AS domain
FROM s1""")
def q_linear_transform(spark, sf):
    sig, _ = _raw_signal(spark, sf, "events")
    return sig.select("project", "version", "trace", "i", rnd("x").alias("x"),
                      rnd("y").alias("y"), "domain")


@register("time_axis", S.with_(*S.BASE) + f"""
SELECT project, version, trace, i, (floor((x) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS x, (floor((y) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS y
FROM s2""")
def q_time_axis(spark, sf):
    sig, _ = _raw_signal(spark, sf, "lineitem")
    return sig.select("project", "version", "trace", "i", rnd("x").alias("x"), rnd("y").alias("y"))


# --------------------------------------------------------------------------
# Trigger index

@register("trigger_index", S.with_(*S.BASE) + "SELECT project, version, t0_index FROM t0")
def q_trigger_index(spark, sf):
    st = fixture_store(spark, sf)
    smp = st.samples(spark).where(F.col("project") == "lineitem")
    return signal.trigger_index(smp)


# --------------------------------------------------------------------------
# statistics

_STATS_SQL = f"""
SELECT project, version, trace, count(y) AS n, (floor((min(y)) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS "min", (floor((max(y)) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS "max",
       (floor((max(y) - min(y)) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS "range", (floor((avg(y)) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS mean,
       (floor((stddev_pop(y)) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS stdev
FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY project, version, trace"""


@register("trace_stats", S.with_(*S.BASE) + _STATS_SQL)
def q_trace_stats(spark, sf):
    """A1-A5 of raw traces, from the block statistics stored with them."""
    st = fixture_store(spark, sf)
    blocks = st.block_stats(spark).where(F.col("project").isin("events", "lineitem"))
    out = stats.stats_of_blocks(blocks, st.registry(spark))
    return out.select("project", "version", "trace", "n",
                      *[rnd(c).alias(c) for c in stats.STAT_FUNCTIONS])


@register("trace_stats_samples", S.with_(*S.BASE) + _STATS_SQL)
def q_trace_stats_samples(spark, sf):
    """A1-A5 of any signal frame, from its samples."""
    st = fixture_store(spark, sf)
    smp = st.samples(spark).where(F.col("project").isin("events", "lineitem"))
    sig = signal.signal_frame(smp, st.registry(spark), st.captures(spark), st.projects(spark))
    out = stats.trace_stats(sig)
    return out.select("project", "version", "trace", "n",
                      *[rnd(c).alias(c) for c in stats.STAT_FUNCTIONS])


_SEL_SQL = S.with_(*S.BASE, S.STATS_LIST, f"""st AS ({_STATS_SQL})""",
                   """lng AS (
  SELECT project, version, trace, 'min' AS stat, "min" AS value FROM st
  UNION ALL SELECT project, version, trace, 'max', "max" FROM st
  UNION ALL SELECT project, version, trace, 'range', "range" FROM st
  UNION ALL SELECT project, version, trace, 'mean', mean FROM st
  UNION ALL SELECT project, version, trace, 'stdev', stdev FROM st)""")


@register("trace_stats_selected", _SEL_SQL + """
SELECT l.project, l.version, l.trace, CAST(r.stat_pos AS INTEGER) AS stat_pos, l.stat, l.value
FROM lng l JOIN reg_stats r ON r.project = l.project AND r.trace = l.trace AND r.stat = l.stat""")
def q_trace_stats_selected(spark, sf):
    st = fixture_store(spark, sf)
    smp = st.samples(spark).where(F.col("project").isin("events", "lineitem"))
    reg = st.registry(spark)
    sig = signal.signal_frame(smp, reg, st.captures(spark), st.projects(spark))
    s = stats.trace_stats(sig)
    s = s.select("project", "version", "trace", *[rnd(c).alias(c) for c in stats.STAT_FUNCTIONS])
    return stats.selected_stats(s, reg)


def _sym_sql():
    return "CASE l.stat " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in stats.STAT_SYMBOLS.items()) + " END"


@register("legend_text", _SEL_SQL + f"""
SELECT l.project, l.version, l.trace,
       g.label || string_agg(', $' || {_sym_sql()} || '=' || CAST(round_even(l.value, 2) AS VARCHAR) || '$', ''
                             ORDER BY r.stat_pos) AS legend
FROM lng l JOIN reg_stats r ON r.project = l.project AND r.trace = l.trace AND r.stat = l.stat
JOIN reg g ON g.project = l.project AND g.trace = l.trace
GROUP BY l.project, l.version, l.trace, g.label""")
def q_legend_text(spark, sf):
    st = fixture_store(spark, sf)
    smp = st.samples(spark).where(F.col("project").isin("events", "lineitem"))
    reg = st.registry(spark)
    sig = signal.signal_frame(smp, reg, st.captures(spark), st.projects(spark))
    s = stats.trace_stats(sig)
    s = s.select("project", "version", "trace", *[rnd(c).alias(c) for c in stats.STAT_FUNCTIONS])
    return stats.legend_text(stats.selected_stats(s, reg), reg, style="plot")


# --------------------------------------------------------------------------
# J1-J4 pointwise, J6 derivative resolution

def _pair_sql(name: str, src: str, expr: str, traces: list[str], extra_where: str = "") -> str:
    joins = []
    for k, t in enumerate(traces):
        if k == 0:
            joins.append(f"{src} a0")
        else:
            joins.append(f"JOIN {src} a{k} ON a{k}.project = a0.project AND a{k}.version = a0.version "
                         f"AND a{k}.i = a0.i AND a{k}.trace = '{t}'")
    return (f"SELECT a0.project, a0.version, '{name}' AS trace, a0.i, (floor((a0.x) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS x, "
            f"(floor(({expr}) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6) AS y, 'TIME' AS domain\nFROM " + "\n".join(joins) +
            f"\nWHERE a0.trace = '{traces[0]}' {extra_where}")


# lineitem traces are columns of one wide row, so the oracle of a pointwise
# function is an expression over that row: no join of samples.
_WIDE = """w AS (
  SELECT f.version, f.i, 2.0 * CAST(f.i - t.t0 AS DOUBLE) AS x, l_quantity AS q, 0.001 * l_extendedprice AS p,
         100.0 * l_discount AS d, 100.0 * l_tax + 1.0 AS t
  FROM f2w f JOIN (SELECT version, CASE WHEN count(*) > 2 THEN
                   coalesce(min(CASE WHEN i >= 1 AND trig <> 0 THEN i - 1 END), 0) ELSE 0 END AS t0
                   FROM f2w GROUP BY version) t ON t.version = f.version)"""


def _wide_sql(name: str, expr: str) -> str:
    return S.with_(S.F2W, _WIDE) + f"""
SELECT 'lineitem' AS project, version, '{name}' AS trace, i, {_grid("x")} AS x, {_grid(expr)} AS y, 'TIME' AS domain
FROM w"""


def _grid(e: str) -> str:
    return f"(floor(({e}) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6)"


def _pw(df: DataFrame) -> DataFrame:
    return df.select("project", "version", "trace", "i", rnd("x").alias("x"),
                     rnd("y").alias("y"), "domain")


@register("power_multiply", _wide_sql("power", "p * d"))
def q_power_multiply(spark, sf):
    sig, _ = _raw_signal(spark, sf, "lineitem")
    return _pw(pointwise.multiply(sig, ["l_extendedprice", "l_discount"], "power"))


@register("trace_add", S.with_(*S.BASE) + _pair_sql(
    "sum3", "s1", "a0.y + a1.y + a2.y", ["click", "view", "purchase"]))
def q_trace_add(spark, sf):
    sig, _ = _raw_signal(spark, sf, "events")
    return _pw(pointwise.add(sig, ["click", "view", "purchase"], "sum3"))


@register("trace_subtract", _wide_sql("price_minus_tax", "p - t"))
def q_trace_subtract(spark, sf):
    sig, _ = _raw_signal(spark, sf, "lineitem")
    return _pw(pointwise.subtract(sig, ["l_extendedprice", "l_tax"], "price_minus_tax"))


@register("trace_divide", _wide_sql("per_unit", "p / q"))
def q_trace_divide(spark, sf):
    sig, _ = _raw_signal(spark, sf, "lineitem")
    return _pw(pointwise.divide(sig, ["l_extendedprice", "l_quantity"], "per_unit"))


@register("divide_by_zero_null", _wide_sql("per_discount", "p / nullif(d, 0.0)"))
def q_divide_by_zero_null(spark, sf):
    sig, _ = _raw_signal(spark, sf, "lineitem")
    return _pw(pointwise.divide(sig, ["l_extendedprice", "l_discount"], "per_discount",
                                on_zero="null"))


@register("derived_of_derived", _wide_sql("net_price", "2.0 * (p - p * d) + -1.0"))
def q_derived_of_derived(spark, sf):
    sig, st = _raw_signal(spark, sf, "lineitem")
    out = derive.resolve(sig, st.registry(spark), st.projects(spark), "lineitem", ["Net price"])
    return _pw(out)


# --------------------------------------------------------------------------
# versions

_REQ = [-99, -3, -2, -1, 0, 1, 2, 3, 7, 8]


_LATEST = """latest AS (SELECT project, max(version) AS latest FROM
  (SELECT project, version FROM f1 UNION ALL SELECT project, version FROM f2) GROUP BY project)"""


@register("version_resolve", S.with_(*S.BASE, _LATEST) + f"""
SELECT project, requested, CAST(CASE WHEN v BETWEEN 1 AND latest THEN v END AS INTEGER) AS version
FROM (SELECT m.project, r.requested, m.latest,
             CASE WHEN r.requested < 0 THEN m.latest + 1 + r.requested ELSE r.requested END AS v
      FROM latest m CROSS JOIN (VALUES {", ".join(f"({v})" for v in _REQ)}) AS r(requested)) q""")
def q_version_resolve(spark, sf):
    st = fixture_store(spark, sf)
    cap = st.captures(spark).where(F.col("project").isin("events", "lineitem"))
    asked = F.explode(F.array(*[F.lit(v) for v in _REQ])).alias("requested")
    requests = cap.select("project").distinct().select("project", asked)
    return compare.resolve_versions(requests, cap).select("project", "requested", "version")


def _compare_sql(k: str, a: str = "1", b: str = "2") -> str:
    """Two versions side by side without a join of samples: a column each."""
    side = (lambda v: f"max(CASE WHEN version = {v} THEN y END)")
    return f"""cmp AS (SELECT project, trace, {k} AS k, {side(a)} AS y_a, {side(b)} AS y_b
  FROM (SELECT f.project, f.version, f.trace, f.i, r.y_scale * f.y_raw + r.y_offset AS y, t.t0_index
        FROM f2 f JOIN reg r ON r.project = f.project AND r.trace = f.trace
        JOIN t0 t ON t.version = f.version WHERE f.version IN ({a}, {b})) GROUP BY ALL)
SELECT project, trace, k, {_r("y_a")} AS y_a, {_r("y_b")} AS y_b, {_r("y_b - y_a")} AS diff FROM cmp"""


@register("version_compare", S.with_(S.F2W, S.F2, S.REG, S.T0, _compare_sql("i - t0_index")))
def q_version_compare(spark, sf):
    sig, st = _raw_signal(spark, sf, "lineitem")
    out = compare.compare_versions(sig, st.captures(spark), 1, 2)
    return out.select("project", "trace", "k", rnd("y_a").alias("y_a"), rnd("y_b").alias("y_b"),
                      rnd("diff").alias("diff"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Power = price x discount per sample, then statistics per version."""
    sig, _ = _raw_signal(spark, sf, "lineitem")
    prod = pointwise.multiply(sig, ["l_extendedprice", "l_discount"], "power")
    return stats.trace_stats(prod)


# --------------------------------------------------------------------------
# Capture ingest

from ..functions import radix as RX  # noqa: E402
from ..functions import units as U  # noqa: E402
from ..operators import registry as REG  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import capture as CAP  # noqa: E402
from ..sources import store as STORE  # noqa: E402
from . import fixtures as FX  # noqa: E402


@register("radix_decode", """
SELECT o_orderkey, o_orderkey AS from_hex, o_orderkey AS from_hex_lower, o_custkey AS from_oct,
       o_custkey AS from_bin, o_custkey AS from_dec, -o_custkey AS from_neg_hex,
       o_custkey AS from_plus_dec
FROM orders""")
def q_radix_decode(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    enc = o.select("o_orderkey", F.hex("o_orderkey").alias("h"),
                   F.lower(F.hex("o_orderkey")).alias("hl"),
                   F.conv(F.col("o_custkey").cast("string"), 10, 8).alias("oc"),
                   F.bin("o_custkey").alias("b"), F.col("o_custkey").cast("string").alias("d"),
                   F.concat(F.lit("-"), F.hex("o_custkey")).alias("nh"),
                   F.concat(F.lit("+"), F.col("o_custkey").cast("string")).alias("pd"))

    def dec(c, word):
        return RX.decode(F.col(c), RX.base_of(F.upper(F.trim(F.lit(word)))))
    return enc.select("o_orderkey", dec("h", "HEX").alias("from_hex"),
                      dec("hl", "hex").alias("from_hex_lower"), dec("oc", "OCTAL").alias("from_oct"),
                      dec("b", "BIN").alias("from_bin"), dec("d", "SIGNED").alias("from_dec"),
                      dec("nh", "HEX").alias("from_neg_hex"), dec("pd", "UNSIGNED").alias("from_plus_dec"))


_ORDER_STORES: dict = {}


def ingest_orders(spark: SparkSession, sf: str, fresh: bool = False) -> STORE.Store:
    """Generate the F4 capture files from ``orders`` and ingest them."""
    key = (spark.sparkContext.applicationId, sf)
    if not fresh and key in _ORDER_STORES:
        return _ORDER_STORES[key]
    src = FX.write_order_captures(spark, sf, scratch_path(spark, "order-captures"))
    store = STORE.Store(scratch_path(spark, "order-store"))
    STORE.ingest(spark, store, CAP.read_lines(spark, src), "orders")
    _ORDER_STORES[key] = store
    return store


def _bucket_of(c):
    return F.regexp_extract(F.col(c), r"bucket=(\d+)", 1).cast("bigint")


_FR = f"""fr AS (
  SELECT CAST(floor(o_orderkey / {FX.CAPTURE_ROWS_PER_FILE}) AS BIGINT) AS bucket,
         row_number() OVER (PARTITION BY floor(o_orderkey / {FX.CAPTURE_ROWS_PER_FILE}) ORDER BY o_orderkey) - 1 AS idx,
         o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS price,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS trig
  FROM orders)"""

_CAP_TRACES = [("Sample in Buffer", "idx"), ("Sample in Window", "idx"), ("TRIGGER", "trig"),
               ("orders/key[31:0]", "o_orderkey"), ("orders/cust[15:0]", "o_custkey"),
               ("orders/price", "price"), ("orders/neg_cust", "-o_custkey"),
               ("orders/cust,copy", "o_custkey")]


@register("capture_ingest", f"WITH {_FR}\n" + "\nUNION ALL ".join(
    f"SELECT bucket, '{t}' AS trace, idx AS i, CAST({e} AS BIGINT) AS y_raw FROM fr"
    for t, e in _CAP_TRACES))
def q_capture_ingest(spark, sf):
    store = ingest_orders(spark, sf)
    cap = store.captures(spark).select("project", "version", "source_uri")
    return (store.samples(spark).join(cap, ["project", "version"])
            .select(_bucket_of("source_uri").alias("bucket"), "trace", "i", "y_raw"))


@register("capture_catalog", f"""WITH {_FR}
SELECT bucket, CAST(count(*) AS BIGINT) AS n_samples,
       CAST(CASE WHEN count(*) > 2 THEN coalesce(min(CASE WHEN idx >= 1 AND trig <> 0 THEN idx - 1 END), 0)
            ELSE 0 END AS BIGINT) AS t0_index,
       8 AS n_columns, 'orders' AS project
FROM fr GROUP BY bucket""")
def q_capture_catalog(spark, sf):
    store = ingest_orders(spark, sf)
    return store.captures(spark).select(
        _bucket_of("source_uri").alias("bucket"), "n_samples", "t0_index",
        F.size("columns").alias("n_columns"), "project")


# --------------------------------------------------------------------------
# Units over literals built from ``part``

_FUNITS = ["THz", "ghz", " MHz", "KHz", "hz"]
_TUNITS = ["ps", "NS", "us", " ms", "s"]
_FPER = {"thz": 1e-12, "ghz": 1e-9, "mhz": 1e-6, "khz": 0.001, "hz": 1.0}
_TSEC = {"ps": 1e-12, "ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0}


def _pick(units):
    return F.element_at(F.array(*[F.lit(u) for u in units]),
                        (F.col("p_partkey") % len(units) + 1).cast("int"))


def _case_sql(values: list[str]) -> str:
    return "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@register("units_parse", f"""
SELECT p_partkey, CAST(p_size AS DOUBLE) AS f_value,
       {_case_sql([repr(u) for u in U.FREQUENCY_UNITS])} AS f_unit,
       CAST(p_size AS DOUBLE) * 1.0 / {_case_sql([repr(_FPER[u.strip().lower()]) for u in _FUNITS])} AS f_hz,
       CAST(p_size AS DOUBLE) AS d_value,
       {_case_sql([repr(u) for u in ['ps','ns','us','ms','s']])} AS d_unit,
       CAST(p_size AS DOUBLE) * {_case_sql([repr(_TSEC[u.strip().lower()]) for u in _TUNITS])} / 1.0 AS d_seconds
FROM part""")
def q_units_parse(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    ftxt = F.concat(F.col("p_size").cast("string"), F.lit(" "), _pick(_FUNITS))
    dtxt = F.concat(F.lit(" "), F.col("p_size").cast("string"), _pick(_TUNITS))
    q = p.select("p_partkey", U.parse_frequency(ftxt).alias("f"), U.parse_duration(dtxt).alias("d"))
    return q.select("p_partkey", F.col("f.value").alias("f_value"), F.col("f.unit").alias("f_unit"),
                    U.frequency_as("f", "Hz").alias("f_hz"), F.col("d.value").alias("d_value"),
                    F.col("d.unit").alias("d_unit"), U.duration_as("d", "s").alias("d_seconds"))


def _r6(e: str) -> str:
    return f"(floor(({e}) * 1.414213562373095e6 + 0.5) / 1.414213562373095e6)"


_FP = _case_sql([repr(_FPER[u.strip().lower()]) for u in _FUNITS])


@register("units_convert", f"""
SELECT p_partkey,
       {_r6(f"p_retailprice * 0.001 / {_FP}")} AS in_khz,
       (floor((1.0 / p_retailprice) * 1e9 + 0.5) / 1e9) AS period_value,
       {_case_sql([repr(u) for u in ['ps','ns','us','ms','s']])} AS period_unit,
       {_r6(f"p_retailprice + CAST(p_size AS DOUBLE) * {_FP} / 1.0")} AS plus_size_hz,
       p_retailprice < CAST(p_size AS DOUBLE) * {_FP} / 1.0 AS below_size_hz,
       {_r6("p_retailprice * 3.0 / 2.0")} AS scaled
FROM part""")
def q_units_convert(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    f = U.quantity(F.col("p_retailprice"), U.frequency_unit(_pick(_FUNITS)))
    hz = U.quantity(F.col("p_size"), F.lit("Hz"))
    q = p.select("p_partkey", f.alias("f"), hz.alias("hz"))
    per = U.period_of(F.col("f"))
    return q.select("p_partkey", rnd(U.frequency_as("f", "KHz")).alias("in_khz"),
                    rnd9(per["value"]).alias("period_value"), per["unit"].alias("period_unit"),
                    rnd(U.add("f", "hz")["value"]).alias("plus_size_hz"),
                    U.lt("f", "hz").alias("below_size_hz"),
                    rnd(U.divide(U.scale("f", 3.0), 2.0)["value"]).alias("scaled"))


def rnd9(c):
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


@register("dt_from_rate", f"""
SELECT p_partkey, 1.0 / CAST(p_size AS DOUBLE) AS dt_value,
       {_case_sql([repr(u) for u in ['ps','ns','us','ms','s']])} AS dt_unit,
       1.0 / (1.0 / CAST(p_size AS DOUBLE)) AS rate_back
FROM part""")
def q_dt_from_rate(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    rate = U.quantity(F.col("p_size"), U.frequency_unit(_pick(_FUNITS)))
    dt = U.dt_from_rate(rate)
    back = U.rate_from_dt(dt["value"], dt["unit"])
    return p.select("p_partkey", dt["value"].alias("dt_value"), dt["unit"].alias("dt_unit"),
                    back["value"].alias("rate_back"))


# --------------------------------------------------------------------------
# P2-P4, P8-P11, A9, R1-R4 over the registry derived from ``embeddings``

_EMB_REG = """ereg AS (
  SELECT 'embeddings' AS project, CAST(vec_id AS VARCHAR) AS trace, 'vec ' || CAST(vec_id AS VARCHAR) AS label,
         'Active' AS state, 1.0 AS y_scale, 0.0 AS y_offset, CAST(vec_id AS INTEGER) AS ord
  FROM embeddings)"""


def _emb_registry(spark, sf):
    st = fixture_store(spark, sf)
    return st.registry(spark).where(F.col("project") == "embeddings")


@register("registry_search", f"""WITH {_EMB_REG}
SELECT project, trace, label, state FROM ereg
WHERE instr(lower(label), 'vec 1') > 0 AND state = 'Active'""")
def q_registry_search(spark, sf):
    reg = REG.by_state(REG.label_search(_emb_registry(spark, sf), "  VEC 1 "), "Active")
    return reg.select("project", "trace", "label", "state")


def _updated_registry(spark, sf):
    reg = _emb_registry(spark, sf)
    reg = REG.rename_label(reg, "embeddings", "0", "first")
    reg = REG.set_state(reg, "embeddings", F.instr(F.col("label"), "vec 2") > 0, "Inactive")
    reg = REG.set_scale_offset(reg, "embeddings", F.instr(F.col("label"), "vec 1") > 0, 2.0, -0.5)
    reg = REG.add_stat_function(reg, "embeddings", F.instr(F.col("label"), "vec 3") > 0, "mean")
    return reg


_UPD = f"""upd AS (
  SELECT project, trace, CASE WHEN trace = '0' THEN 'first' ELSE label END AS label,
         CASE WHEN instr(label, 'vec 2') > 0 THEN 'Inactive' ELSE state END AS state,
         CASE WHEN instr(label, 'vec 1') > 0 THEN 2.0 ELSE y_scale END AS y_scale,
         CASE WHEN instr(label, 'vec 1') > 0 THEN -0.5 ELSE y_offset END AS y_offset,
         CASE WHEN instr(label, 'vec 3') > 0 THEN 'stdev,mean' ELSE 'mean,stdev' END AS stat_functions,
         ord
  FROM ereg)"""


@register("registry_update", f"""WITH {_EMB_REG}, {_UPD}
SELECT project, trace, label, state, CAST(y_scale AS DOUBLE) AS y_scale, CAST(y_offset AS DOUBLE) AS y_offset,
       stat_functions FROM upd""")
def q_registry_update(spark, sf):
    reg = _updated_registry(spark, sf)
    return reg.select("project", "trace", "label", "state", "y_scale", "y_offset",
                      F.array_join("stat_functions", ",").alias("stat_functions"))


@register("scale_consensus", f"""WITH {_EMB_REG}, {_UPD}
SELECT 'vec 1' AS selection, CAST(CASE WHEN count(DISTINCT y_scale) = 1 THEN min(y_scale) ELSE 1.0 END AS DOUBLE) AS y_scale,
       CAST(CASE WHEN count(DISTINCT y_offset) = 1 THEN min(y_offset) ELSE 0.0 END AS DOUBLE) AS y_offset
FROM upd WHERE instr(lower(label), 'vec 1') > 0
UNION ALL
SELECT 'all', CAST(CASE WHEN count(DISTINCT y_scale) = 1 THEN min(y_scale) ELSE 1.0 END AS DOUBLE),
       CAST(CASE WHEN count(DISTINCT y_offset) = 1 THEN min(y_offset) ELSE 0.0 END AS DOUBLE)
FROM upd""")
def q_scale_consensus(spark, sf):
    reg = _updated_registry(spark, sf)
    a = REG.consensus(REG.label_search(reg, "vec 1")).select(F.lit("vec 1").alias("selection"), "y_scale", "y_offset")
    b = REG.consensus(reg).select(F.lit("all").alias("selection"), "y_scale", "y_offset")
    return a.unionByName(b)


@register("registry_summary", f"""WITH {_EMB_REG}, {_UPD}
SELECT project, state, ord, label, count(*) OVER (PARTITION BY project, state) AS n FROM upd""")
def q_registry_summary(spark, sf):
    """A9 as rows: a label and its place per trace, with its state's count."""
    reg = _updated_registry(spark, sf)
    return REG.state_labels(reg).join(REG.state_summary(reg), ["project", "state"])


@register("version_list", S.with_(*S.BASE, S.F3) + """
SELECT project, version, CAST(dense_rank() OVER (PARTITION BY project ORDER BY version DESC) AS INTEGER) AS rank
FROM (SELECT DISTINCT project, version FROM (SELECT project, version FROM f1 UNION ALL
      SELECT project, version FROM f2 UNION ALL SELECT project, version FROM f3))""")
def q_version_list(spark, sf):
    return compare.version_list(fixture_store(spark, sf).captures(spark))


# --------------------------------------------------------------------------
# Filters and spectra

from ..operators import filters as FL  # noqa: E402
from ..operators import spectrum as SP  # noqa: E402


def _sig_out(df, ycol="y"):
    return df.select("project", "version", "trace", "i", rnd("x").alias("x"), rnd(ycol).alias(ycol),
                     *[c for c in df.columns if c in ("domain", "filter")])


def _dft_sql(src: str, out_trace: str, f1_expr: str, project: str) -> str:
    return f"""src AS ({src}),
nn AS (SELECT version, trace, count(*) AS n FROM src GROUP BY version, trace),
bins AS (SELECT version, trace, n, unnest(range(1, n // 2)) AS k FROM nn),
dft AS (SELECT b.version, b.trace, b.k, b.n,
               sum(s.y * cos(2 * pi() * ((b.k * s.i) % b.n) / b.n)) AS re,
               sum(s.y * sin(2 * pi() * ((b.k * s.i) % b.n) / b.n)) AS im
        FROM bins b JOIN src s ON s.version = b.version AND s.trace = b.trace
        GROUP BY b.version, b.trace, b.k, b.n),
mag AS (SELECT *, sqrt(re * re + im * im) AS m FROM dft),
tot AS (SELECT version, trace, sum(m) AS s FROM mag GROUP BY version, trace)
SELECT '{project}' AS project, mag.version, {out_trace} AS trace, CAST(mag.k - 1 AS BIGINT) AS i,
       {_r(f"({f1_expr}) * CAST(mag.k AS DOUBLE)")} AS x,
       {_r("mag.m / tot.s")} AS y, 'FREQUENCY' AS domain
FROM mag JOIN tot ON tot.version = mag.version AND tot.trace = mag.trace"""


_F1_EMB = "(CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) * CAST(mag.n AS DOUBLE))) * 1e-06 / 1e-09"
_F1_EVT = "(CAST(1.0 AS DOUBLE) / (CAST(0.5 AS DOUBLE) * CAST(mag.n AS DOUBLE))) * 1.0 / 0.001"


def _emb_signal(spark, sf):
    return _raw_signal(spark, sf, "embeddings")


@register("spectrum", S.with_(*S.BASE[:-2], S.F3, S.signal("f3", "s3"),
                               _dft_sql("SELECT version, trace, i, y FROM s3", "mag.trace", _F1_EMB,
                                        "embeddings")))
def q_spectrum(spark, sf):
    sig, _ = _emb_signal(spark, sf)
    return _sig_out(SP.spectrum(sig, 1.0, "ns", display_unit="MHz"))


@register("spectrum_four_step", ORACLE["spectrum"])
def q_spectrum_four_step(spark, sf):
    """Same spectrum with the distributed four-step FFT forced (N=64 = 8 x 8)."""
    sig, _ = _emb_signal(spark, sf)
    return _sig_out(SP.spectrum(sig, 1.0, "ns", display_unit="MHz", max_single=16))


@register("add_of_spectra", S.with_(*S.BASE, """one AS (
  SELECT a.version, a.trace, a.i, a.y, b.n FROM s1 a JOIN (SELECT version, trace, count(*) AS n FROM s1
  WHERE trace IN ('click', 'view') GROUP BY version, trace) b ON b.version = a.version AND b.trace = a.trace),
bin AS (SELECT version, trace, n, unnest(range(1, n // 2)) AS k FROM (SELECT DISTINCT version, trace, n FROM one)),
mg AS (SELECT b.version, b.trace, b.k, sqrt(pow(sum(o.y * cos(2 * pi() * ((b.k * o.i) % b.n) / b.n)), 2)
              + pow(sum(o.y * sin(2 * pi() * ((b.k * o.i) % b.n) / b.n)), 2)) AS m
       FROM bin b JOIN one o ON o.version = b.version AND o.trace = b.trace GROUP BY b.version, b.trace, b.k),
nm AS (SELECT version, trace, k, m / sum(m) OVER (PARTITION BY version, trace) AS y FROM mg)""") + f"""
SELECT 'events' AS project, a.version, 'spectra' AS trace, CAST(a.k - 1 AS BIGINT) AS i,
       {_r("0.5 * CAST(a.k - 1 AS DOUBLE)")} AS x, {_r("a.y + b.y")} AS y, 'TIME' AS domain
FROM nm a JOIN nm b ON b.version = a.version AND b.k = a.k AND b.trace = 'view' WHERE a.trace = 'click'""")
def q_add_of_spectra(spark, sf):
    """J1 over two L5 traces: a function of spectra has a time axis of its own."""
    sig, st = _raw_signal(spark, sf, "events")
    reg = st.registry(spark)
    unit = {"display_frequency_unit": "Hz"}
    reg = REG.add_derivative(reg, "events", "view_spectrum", "fourier_transform", ["view"], unit)
    reg = REG.add_derivative(reg, "events", "spectra", "add", ["click_spectrum", "view_spectrum"])
    out = derive.resolve(sig, reg, st.projects(spark), "events", ["spectra"], st.captures(spark))
    return _sig_out(out)


@register("spectrum_derivative", S.with_(*S.BASE, _dft_sql(
    "SELECT version, trace, i, y FROM s1 WHERE trace = 'click'", "'click_spectrum'", _F1_EVT, "events")))
def q_spectrum_derivative(spark, sf):
    sig, st = _raw_signal(spark, sf, "events")
    out = derive.resolve(sig, st.registry(spark), st.projects(spark), "events", ["click_spectrum"])
    return _sig_out(out)


def _savgol_sql(src: str, window_expr: str) -> str:
    return f"""tw AS (SELECT project, version, trace, count(*) AS n, CAST({window_expr} AS BIGINT) AS w
       FROM {src} GROUP BY project, version, trace),
offs AS (SELECT project, version, trace, n, w, d,
                CAST(d AS DOUBLE) - CASE WHEN w % 2 = 0 THEN 0.5 ELSE 0.0 END AS xp
         FROM (SELECT *, unnest(range(-((w - 1) // 2), w // 2 + 1)) AS d FROM tw)),
mom AS (SELECT project, version, trace, count(*) AS s0, sum(xp * xp) AS s2, sum(xp * xp * xp * xp) AS s4
        FROM offs GROUP BY project, version, trace),
coef AS (SELECT o.*, (m.s4 - m.s2 * o.xp * o.xp) / (m.s0 * m.s4 - m.s2 * m.s2) AS c
         FROM offs o JOIN mom m ON m.project = o.project AND m.version = o.version AND m.trace = o.trace)
SELECT a.project, a.version, a.trace, a.i, {_r("a.x")} AS x, {_r("sum(c.c * b.y)")} AS y_overlay,
       'Savitzky–Golay' AS filter
FROM {src} a
JOIN coef c ON c.project = a.project AND c.version = a.version AND c.trace = a.trace
JOIN {src} b ON b.project = a.project AND b.version = a.version AND b.trace = a.trace
 AND b.i = least(greatest(a.i + c.d, 0), c.n - 1)
GROUP BY a.project, a.version, a.trace, a.i, a.x"""


@register("savgol_odd", S.with_(*S.BASE[:-2], S.F3, S.signal("f3", "s3"), _savgol_sql("s3", "7")))
def q_savgol_odd(spark, sf):
    """L3 through the overlay dispatch (L4): the embeddings registry gives
    every trace a 7-point Savitzky-Golay overlay."""
    sig, st = _emb_signal(spark, sf)
    out = FL.overlay(sig, st.registry(spark).where(F.col("project") == "embeddings"), st.projects(spark))
    return out.select("project", "version", "trace", "i", rnd("x").alias("x"),
                      rnd("y_overlay").alias("y_overlay"), "filter")


@register("savgol_percent", S.with_(*S.BASE, _savgol_sql("s1", "floor(count(*) * 3.0 / 100.0)")))
def q_savgol_percent(spark, sf):
    """L3 with the default "3%" window: the window depends on each trace's
    length (odd and even windows both occur)."""
    sig, st = _raw_signal(spark, sf, "events")
    prm = (st.registry(spark).where((F.col("project") == "events") & F.col("derivative").isNull())
           .select("project", "trace", F.lit(FL.SAVGOL_DEFAULT_WINDOW).alias("window_length"),
                   F.lit(FL.SAVGOL_DEFAULT_POLYORDER).alias("polyorder")))
    out = FL.savgol(sig, prm)
    return out.select("project", "version", "trace", "i", rnd("x").alias("x"),
                      rnd("y").alias("y_overlay"), F.lit(FL.SAVGOL_NAME).alias("filter"))


@register("lowpass")
def q_lowpass(spark, sf):
    """L2: 50 MHz low-pass (Wn 0.1) over every embeddings trace (no SQL
    oracle: checked against an independent recurrence in the unit tests)."""
    sig, _ = _emb_signal(spark, sf)
    return _sig_out(FL.lowpass(sig, "50 MHz", 1.0, "ns"))


@register("lowpass_derivative")
def q_lowpass_derivative(spark, sf):
    """L1 as a registered derivative trace (click low-pass at 100 Hz)."""
    sig, st = _raw_signal(spark, sf, "events")
    out = derive.resolve(sig, st.registry(spark), st.projects(spark), "events", ["Click low-pass"])
    return _sig_out(out)


# --------------------------------------------------------------------------
# Views over the lineitem and events fixtures

from .. import schemas as SC  # noqa: E402
from ..operators import views as VW  # noqa: E402


_VIEWS: dict = {}


def fixture_views(spark: SparkSession) -> DataFrame:
    """Two views built with the maintenance operators (R8, R10, R11); the
    resulting view table (two rows of metadata) is kept as a local relation
    so later plans do not carry the edit history."""
    key = spark.sparkContext.applicationId
    if key not in _VIEWS:
        _VIEWS[key] = spark.createDataFrame(_build_views(spark).collect(), SC.VIEWS)
    return _VIEWS[key]


def _build_views(spark: SparkSession) -> DataFrame:
    v = spark.createDataFrame([], SC.VIEWS)
    v = VW.create_view(v, "lineitem", "prices", 2, 1, "Prices and taxes")
    v = VW.add_spec(v, "lineitem", "prices", 0, 0, "l_extendedprice", -1, show_legends=True)
    v = VW.add_spec(v, "lineitem", "prices", 0, 0, "Price", 1, on_axis="right")
    v = VW.add_spec(v, "lineitem", "prices", 0, 0, "l_quantity", 99)
    v = VW.add_spec(v, "lineitem", "prices", 1, 0, "Tax", -2, show_legends=True)
    v = VW.edit_spec(v, "lineitem", "prices", 1, 0, "Tax", -2, show_filtered_trace=True)
    v = VW.add_spec(v, "lineitem", "prices", 1, 0, "unit_price", -1, on_axis="right", show_legends=True)
    v = VW.add_spec(v, "lineitem", "prices", 1, 0, "missing_trace", -1)
    v = VW.add_spec(v, "lineitem", "prices", 1, 0, "l_discount", -1)
    v = VW.remove_spec(v, "lineitem", "prices", 1, 0, "l_discount", -1)
    v = VW.create_view(v, "events", "mixed", 1, 3, "Time and frequency")
    v = VW.add_spec(v, "events", "mixed", 0, 0, "click_spectrum", -1)
    v = VW.add_spec(v, "events", "mixed", 0, 1, "Click", -1)
    v = VW.add_spec(v, "events", "mixed", 0, 1, "click_spectrum", -2)
    return v


def _view_inputs(spark, sf):
    st = fixture_store(spark, sf)
    smp = st.samples(spark).where(F.col("project").isin("lineitem", "events"))
    reg = st.registry(spark)
    reg = REG.set_overlay(reg, "lineitem", "l_tax", FL.SAVGOL_NAME, window_length="5", polyorder=2)
    sig = signal.signal_frame(smp, reg, st.captures(spark), st.projects(spark))
    return fixture_views(spark), sig, reg, st.captures(spark), st.projects(spark)


_VIEW_RAW_SQL = f"""
SELECT 'lineitem' AS project, 'prices' AS view_name, 0 AS "row", 0 AS "column", 0 AS spec_pos,
       trace, version, 'left' AS on_axis, 'raw' AS series, i, {_r("x")} AS x, {_r("y")} AS y
FROM s2 WHERE trace = 'l_extendedprice' AND version = 7
UNION ALL
SELECT 'lineitem', 'prices', 0, 0, 1, trace, version, 'right', 'raw', i, {_r("x")}, {_r("y")}
FROM s2 WHERE trace = 'l_extendedprice' AND version = 1
UNION ALL
SELECT 'lineitem', 'prices', 1, 0, 0, trace, version, 'left', 'raw', i, {_r("x")}, {_r("y")}
FROM s2 WHERE trace = 'l_tax' AND version = 6
UNION ALL
SELECT 'lineitem', 'prices', 1, 0, 1, 'unit_price', a.version, 'right', 'raw', a.i, {_r("a.x")}, {_r("a.y / b.y")}
FROM s2 a JOIN s2 b ON b.version = a.version AND b.i = a.i AND b.trace = 'l_quantity'
WHERE a.trace = 'l_extendedprice' AND a.version = 7"""


_TAX6 = "tax6 AS (SELECT * FROM s2 WHERE trace = 'l_tax' AND version = 6)"


def _fmt2g(e: str) -> str:
    return f"CAST(CAST(printf('%.1e', {e}) AS DOUBLE) AS VARCHAR)"


_LEG_STATS = """ls AS (
  SELECT 0 AS r, 0 AS spec_pos, 'l_extendedprice' AS trace, 7 AS version, 'Price' AS label FROM (VALUES (1))
  UNION ALL SELECT 1, 0, 'l_tax', 6, 'Tax' FROM (VALUES (1))
  UNION ALL SELECT 1, 1, 'unit_price', 7, 'Unit price' FROM (VALUES (1))),
up AS (SELECT 'unit_price' AS trace, a.version, a.y / b.y AS y FROM s2 a
       JOIN s2 b ON b.version = a.version AND b.i = a.i AND b.trace = 'l_quantity'
       WHERE a.trace = 'l_extendedprice'),
allsig AS (SELECT trace, version, y FROM s2 UNION ALL SELECT trace, version, y FROM up),
agg AS (SELECT trace, version, min(y) AS mn, max(y) AS mx, avg(y) AS av FROM allsig GROUP BY trace, version)"""


@register("view_legend", S.with_(*S.BASE, _LEG_STATS) + f"""
SELECT 'lineitem' AS project, 'prices' AS view_name, ls.r AS "row", 0 AS "column", ls.spec_pos, ls.trace,
       ls.version,
       ls.label || ' V:' || CAST(ls.version AS VARCHAR) ||
       CASE ls.trace
         WHEN 'l_extendedprice' THEN ', $Y_{{-}}=' || {_fmt2g(_r("agg.mn"))} || '$, $Y^{{+}}=' || {_fmt2g(_r("agg.mx"))} || '$'
         WHEN 'l_tax' THEN ', $\\Delta=' || {_fmt2g(_r("agg.mx - agg.mn"))} || '$'
         ELSE ', $\\overline{{Y}}=' || {_fmt2g(_r("agg.av"))} || '$' END AS legend
FROM ls JOIN agg ON agg.trace = ls.trace AND agg.version = ls.version""")
def q_view_legend(spark, sf):
    views, sig, reg, cap, prj = _view_inputs(spark, sf)
    return VW.legends(views, sig, reg, cap, prj).select(
        "project", "view_name", F.col("row"), F.col("column"), "spec_pos", "trace", "version", "legend")


@register("view_extent", S.with_(*S.BASE) + f"""
SELECT 'lineitem' AS project, 'prices' AS view_name, 'TIME' AS domain, {_r("min(x)")} AS x_min, {_r("max(x)")} AS x_max
FROM s2 WHERE (trace = 'l_extendedprice' AND version IN (1, 7)) OR (trace = 'l_tax' AND version = 6)
   OR (trace = 'l_quantity' AND version = 7)
UNION ALL
SELECT 'events', 'mixed', 'FREQUENCY', {_r("min(k) / (0.0005 * n)")}, {_r("max(k) / (0.0005 * n)")}
FROM (SELECT n, unnest(range(1, n // 2)) AS k FROM (SELECT count(*) AS n FROM s1 WHERE trace = 'click' AND version = 3)) GROUP BY n
UNION ALL
SELECT 'events', 'mixed', 'TIME', {_r("min(x)")}, {_r("max(x)")} FROM (
  SELECT x FROM s1 WHERE trace = 'click' AND version = 3
  UNION ALL SELECT CAST(unnest(range(1, n // 2)) AS DOUBLE) / (0.0005 * n) FROM (
    SELECT count(*) AS n FROM s1 WHERE trace = 'click' AND version = 2))""")
def q_view_extent(spark, sf):
    """A8 over all views: the cell of ``mixed`` that holds a TIME and a
    FREQUENCY trace counts for the domain of its first spec only."""
    views, sig, reg, cap, prj = _view_inputs(spark, sf)
    rows = VW.materialize(views, sig, reg, cap, prj, with_overlay=False)
    out = VW.shared_extent(rows, VW.subplot_domains(views, reg))
    return out.select("project", "view_name", "domain", rnd("x_min").alias("x_min"), rnd("x_max").alias("x_max"))


_CELL_COUNTS = """cnt AS (
  SELECT 'lineitem' AS project, 'prices' AS view_name, 0 AS r, 0 AS c,
         (SELECT count(*) FROM s2 WHERE trace = 'l_extendedprice' AND version IN (1, 7)) AS n_samples
  UNION ALL SELECT 'lineitem', 'prices', 1, 0,
         (SELECT count(*) FROM s2 WHERE trace = 'l_tax' AND version = 6)
       + (SELECT count(*) FROM s2 WHERE trace = 'l_quantity' AND version = 7)
  UNION ALL SELECT 'events', 'mixed', 0, 0,
         (SELECT count(*) FROM (SELECT version, count(*) AS n FROM s1 WHERE trace = 'click' AND version = 3
                                GROUP BY version) q, range(1, q.n // 2) t(k))
  UNION ALL SELECT 'events', 'mixed', 0, 1,
         (SELECT count(*) FROM s1 WHERE trace = 'click' AND version = 3)
       + (SELECT count(*) FROM (SELECT version, count(*) AS n FROM s1 WHERE trace = 'click' AND version = 2
                                GROUP BY version) q, range(1, q.n // 2) t(k))
  UNION ALL SELECT 'events', 'mixed', 0, 2, 0)"""


@register("view_cells", S.with_(*S.BASE, _CELL_COUNTS) + """
SELECT t.project, t.view_name, t."row", t."column", t.domain, t.compatible, t.summary,
       CAST(cnt.n_samples AS BIGINT) AS n_samples
FROM (VALUES
  ('lineitem', 'prices', 0, 0, 'TIME', true, 'Price :: -1' || chr(10) || 'Price :: 1' || chr(10) || 'Quantity :: 99'),
  ('lineitem', 'prices', 1, 0, 'TIME', true, 'Tax :: -2' || chr(10) || 'Unit price :: -1' || chr(10) || 'missing_trace :: -1'),
  ('events', 'mixed', 0, 0, 'FREQUENCY', true, 'Click spectrum :: -1'),
  ('events', 'mixed', 0, 1, 'TIME', false, 'Click :: -1' || chr(10) || 'Click spectrum :: -2'),
  ('events', 'mixed', 0, 2, NULL, true, NULL))
  AS t(project, view_name, "row", "column", domain, compatible, summary)
JOIN cnt ON cnt.project = t.project AND cnt.view_name = t.view_name AND cnt.r = t."row" AND cnt.c = t."column"
""")
def q_view_cells(spark, sf):
    """R12 + R15 + R13 per subplot: domain, compatibility, spec summary and
    the number of raw samples the subplot materialises."""
    views, sig, reg, cap, prj = _view_inputs(spark, sf)
    rows = VW.materialize(views, sig, reg, cap, prj, with_overlay=False)
    n = rows.groupBy("project", "view_name", "row", "column").agg(F.count(F.lit(1)).alias("n_samples"))
    cells = VW.subplot_domains(views, reg).join(VW.spec_summary(views, reg),
                                                ["project", "view_name", "row", "column"], "left")
    return (cells.join(n, ["project", "view_name", "row", "column"], "left")
            .select("project", "view_name", F.col("row"), F.col("column"), "domain", "compatible", "summary",
                    F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples")))


# --------------------------------------------------------------------------
# Configs, catalogue, snapshots, notes, streaming

from ..sources import config as CFG  # noqa: E402
from ..streaming import ingest as STREAM  # noqa: E402


@register("config_roundtrip", f"""WITH {_EMB_REG}
SELECT project, trace, label, state, CAST(y_scale AS DOUBLE) AS y_scale, CAST(y_offset AS DOUBLE) AS y_offset,
       'Savitzky–Golay' AS filter_name, '7' AS window_length, 2 AS polyorder, 'mean,stdev' AS stat_functions,
       false AS is_derivative, ord
FROM ereg""")
def q_config_roundtrip(spark, sf):
    """The registry derived from ``embeddings`` written as JSON documents
    (one per project) and read back with defaults applied."""
    reg = _emb_registry(spark, sf)
    root = scratch_path(spark, "registry-json")
    CFG.write_registry(reg, root)
    back = CFG.read_registry_written(spark, root)
    return back.select("project", "trace", "label", "state", "y_scale", "y_offset",
                       F.col("overlay.filter_name").alias("filter_name"),
                       F.col("overlay.window_length").alias("window_length"),
                       F.col("overlay.polyorder").alias("polyorder"),
                       F.array_join("stat_functions", ",").alias("stat_functions"),
                       F.col("derivative").isNotNull().alias("is_derivative"), "ord")


_NATION_UNITS = ["s", "ms", "us", "ns", "ps"]


@register("project_catalogue", f"""
SELECT lower(n_name) AS project, CAST(n_nationkey + 1 AS DOUBLE) * 0.5 AS implied_dt,
       CASE n_regionkey % 5 {" ".join(f"WHEN {k} THEN '{u}'" for k, u in enumerate(_NATION_UNITS))} END AS dt_unit,
       'nation ' || n_name AS description,
       1.0 / (CAST(n_nationkey + 1 AS DOUBLE) * 0.5) AS rate_value,
       CASE n_regionkey % 5 {" ".join(f"WHEN {k} THEN '{u}'" for k, u in enumerate(['Hz', 'KHz', 'MHz', 'GHz', 'THz']))} END AS rate_unit
FROM nation""")
def q_project_catalogue(spark, sf):
    """Projects created from ``nation`` names, settings updated, written
    as JSON, listed and read back; U10 rate from the step."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    prj = STORE.create_projects(spark.createDataFrame([], SC.PROJECTS),
                                n.select(F.lower("n_name").alias("project")))
    upd = n.select(F.lower("n_name").alias("_p"),
                   ((F.col("n_nationkey") + 1).cast("double") * F.lit(0.5)).alias("_dt"),
                   F.element_at(F.array(*[F.lit(u) for u in _NATION_UNITS]),
                                (F.col("n_regionkey") % 5 + 1).cast("int")).alias("_u"),
                   F.concat(F.lit("nation "), F.col("n_name")).alias("_d"))
    prj = (prj.join(upd, F.col("project") == F.col("_p"))
           .select("project", F.col("_dt").alias("implied_dt"), F.col("_u").alias("dt_unit"),
                   F.col("_d").alias("description")))
    root = scratch_path(spark, "projects-json")
    CFG.write_projects(prj, root)
    schema = "project_version int, name string, implied_dt double, dt_unit string, description string"
    back = (spark.read.schema(schema).json(f"{root}/project=*/*.txt")
            .select(F.col("name").alias("project"), "implied_dt", "dt_unit", "description"))
    rate = U.rate_from_dt(F.col("implied_dt"), F.col("dt_unit"))
    return back.select("project", "implied_dt", "dt_unit", "description",
                       rate["value"].alias("rate_value"), rate["unit"].alias("rate_unit"))


_SNAP_TRACES = [("TRIGGER", "trig"), ("orders/key[31:0]", "o_orderkey"),
                ("orders/cust[15:0]", "o_custkey"), ("orders/price", "price")]


@register("snapshot_read", f"WITH {_FR}\n" + "\nUNION ALL ".join(
    f"SELECT 'legacy' AS project, CAST(bucket + 1 AS INTEGER) AS version, '{t}' AS trace, idx AS i, "
    f"CAST({e} AS BIGINT) AS y_raw FROM fr" for t, e in _SNAP_TRACES))
def q_snapshot_read(spark, sf):
    """A legacy project folder of wide per-version lz4 Parquet files,
    read as long samples (index = Parquet row index)."""
    d = FX.write_legacy_snapshots(spark, sf, scratch_path(spark, "legacy-project"))
    return STORE.read_legacy_project(spark, d, "legacy")


@register("capture_notes", f"""WITH {_FR}
SELECT DISTINCT bucket, t.trace, '' AS note FROM fr,
  (VALUES {", ".join("('" + t.replace("'", "''") + "')" for t, _ in _CAP_TRACES)}) AS t(trace)""")
def q_capture_notes(spark, sf):
    """Empty notes at the first load, carried to later versions."""
    store = ingest_orders(spark, sf)
    cap = store.captures(spark).select("project", "version", "source_uri")
    return (store.notes(spark).join(cap, ["project", "version"])
            .select(_bucket_of("source_uri").alias("bucket"), "trace", "note"))


@register("stream_ingest", ORACLE["capture_ingest"])
def q_stream_ingest(spark, sf):
    """The capture files dropped in a landing folder, ingested by a
    file-source stream (``availableNow``) through ``foreachBatch``."""
    landing = FX.write_order_captures(spark, sf, scratch_path(spark, "landing"))
    store = STORE.Store(scratch_path(spark, "stream-store"))
    q = STREAM.start_ingest(spark, f"{landing}/*/*.txt", store, "orders",
                            checkpoint=scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    cap = store.captures(spark).select("project", "version", "source_uri")
    return (store.samples(spark).join(cap, ["project", "version"])
            .select(_bucket_of("source_uri").alias("bucket"), "trace", "i", "y_raw"))


# --------------------------------------------------------------------------
# P9 label validity, R5-R7 derivative maintenance over table-derived registries

@register("label_check", f"""WITH {_EMB_REG},
cand AS (
  SELECT project, trace, ord, 'vec ' || CAST(ord + 1 AS VARCHAR) AS new_label FROM ereg
  UNION ALL SELECT project, trace, ord, 'v-' || trace || ' ok' FROM ereg
  UNION ALL SELECT project, trace, ord, '  ' FROM ereg
  UNION ALL SELECT project, trace, ord, 'bad/' || trace FROM ereg),
used AS (SELECT project, trace AS owner, trace AS u FROM ereg UNION ALL SELECT project, trace, label FROM ereg)
SELECT c.project, c.trace, c.new_label,
       CASE WHEN trim(c.new_label) = '' THEN 'empty'
            WHEN NOT regexp_matches(c.new_label, '^[a-zA-Z0-9\\[\\]_\\-+. ]+$') THEN 'invalid characters'
            WHEN EXISTS (SELECT 1 FROM used WHERE used.project = c.project AND used.u = c.new_label
                                              AND used.owner <> c.trace) THEN 'already used' END AS reason
FROM cand c""")
def q_label_check(spark, sf):
    """P9 for four candidate labels per embeddings trace (one clashes with
    the next vector's label, one is valid, one blank, one with '/')."""
    reg = _emb_registry(spark, sf)
    base = reg.select("project", "trace", "ord")
    cand = (base.select("project", "trace", F.concat(F.lit("vec "), (F.col("ord") + 1).cast("string")).alias("new_label"))
            .unionByName(base.select("project", "trace", F.concat(F.lit("v-"), "trace", F.lit(" ok")).alias("new_label")))
            .unionByName(base.select("project", "trace", F.lit("  ").alias("new_label")))
            .unionByName(base.select("project", "trace", F.concat(F.lit("bad/"), "trace").alias("new_label"))))
    return REG.label_check(cand, reg).select("project", "trace", "new_label", "reason")


@register("registry_derivative", S.with_(*S.BASE[:-2], S.F3, S.signal("f3", "s3")) + f"""
SELECT a.project, a.version, 'd01' AS trace, a.i, {_r("a.x")} AS x, {_r("0.5 * (a.y - b.y) + 1.0")} AS y,
       'TIME' AS domain
FROM s3 a JOIN s3 b ON b.version = a.version AND b.i = a.i AND b.trace = '1'
WHERE a.trace = '0'""")
def q_registry_derivative(spark, sf):
    """R5 add (sources given by label), R6 update by label, R3 scale/offset,
    R7 delete of another derivative, then J6 evaluation over the data."""
    sig, st = _emb_signal(spark, sf)
    reg = _emb_registry(spark, sf)
    reg = REG.add_derivative(reg, "embeddings", "d01", "add", ["vec 0", "vec 1"])
    reg = REG.add_derivative(reg, "embeddings", "tmp", "multiply", ["vec 2", "vec 3"])
    reg = REG.update_derivative(reg, "embeddings", "d01", "subtract", ["vec 0", "vec 1"])
    reg = REG.set_scale_offset(reg, "embeddings", ["d01"], 0.5, 1.0)
    reg = REG.delete_derivative(reg, "embeddings", "tmp")
    out = derive.resolve(sig, reg, st.projects(spark), "embeddings", ["d01"])
    return _sig_out(out)


@register("lowpass_overlay")
def q_lowpass_overlay(spark, sf):
    """L2 through the overlay dispatch (L4): every raw events trace gets a
    100 Hz low-pass overlay (Wn 0.1 at the project's 0.5 ms step)."""
    sig, st = _raw_signal(spark, sf, "events")
    reg = st.registry(spark).where(F.col("project") == "events")
    reg = REG.set_overlay(reg, "events", F.col("derivative").isNull(), FL.LOWPASS_NAME, frequency="100 Hz")
    out = FL.overlay(sig, reg, st.projects(spark))
    return out.select("project", "version", "trace", "i", rnd("x").alias("x"),
                      rnd("y_overlay").alias("y_overlay"), "filter")


# --------------------------------------------------------------------------
# SQL oracle for the zero-phase low-pass: the cascade recurrence, sample by
# sample, in a recursive CTE (independent of the FFT path of the library).

def _sections(wn: float) -> list[tuple]:
    """Order-10 Butterworth biquads from the real form of the bilinear map,
    for the oracle only: with t = tan(pi wn / 2) and pole angle q,
    b0 = t^2 / d, a1 = 2 (t^2 - 1) / d, a2 = (1 + 2 t cos q + t^2) / d,
    d = 1 - 2 t cos q + t^2 (b1 = 2 b0, b2 = b0)."""
    import math
    t, out = math.tan(math.pi * wn / 2), []
    for k in range(5):
        cos = math.cos(math.pi * (11 + 2 * k) / 20)
        d = 1 - 2 * t * cos + t * t
        b0 = t * t / d
        out.append((b0, 2 * b0, b0, 1.0, 2 * (t * t - 1) / d, (1 + 2 * t * cos + t * t) / d))
    return out


def _lowpass_sql(src: str, wn: float, out_trace: str | None = None, ycol: str = "y") -> str:
    """CTEs + final SELECT: filtfilt of every trace of CTE ``src``
    (project, version, trace, i, x, y).  Needs ``WITH RECURSIVE``."""
    sos = _sections(wn)
    pad = 33
    lit = lambda v: f"CAST({float(v)!r} AS DOUBLE)"

    def step(prev: str, inp: str) -> tuple[list[str], str]:
        # transposed direct form II, 5 sections; returns (new state exprs, output expr)
        v = inp
        states = []
        for k, (b0, b1, b2, _a0, a1, a2) in enumerate(sos):
            y = f"({lit(b0)} * {v} + {prev}.z1_{k})"
            states.append(f"({lit(b1)} * {v} - {lit(a1)} * {y} + {prev}.z2_{k})")
            states.append(f"({lit(b2)} * {v} - {lit(a2)} * {y})")
            v = y
        return states, v

    def init(u: str) -> list[str]:
        out = []
        for b0, b1, b2, _a0, a1, a2 in sos:
            out.append(f"{u} * (1.0 - {lit(b0)})")
            out.append(f"{u} * ({lit(b2)} - {lit(a2)})")
        return out

    zcols = [f"z{w}_{k}" for k in range(len(sos)) for w in (1, 2)]

    def recursion(name: str, inp: str) -> str:
        st, outexpr = step("f", "x.e")
        first = ", ".join(f"{e} AS {c}" for e, c in zip(init("e"), zcols))
        nxt = ", ".join(f"{e} AS {c}" for e, c in zip(st, zcols))
        return f"""{name} AS (
  SELECT project, version, trace, j, e AS yo, {first} FROM {inp} WHERE j = 0
  UNION ALL
  SELECT f.project, f.version, f.trace, f.j + 1, {outexpr}, {nxt}
  FROM {name} f JOIN {inp} x ON x.project = f.project AND x.version = f.version AND x.trace = f.trace
   AND x.j = f.j + 1)"""

    tr = f"'{out_trace}'" if out_trace else "s.trace"
    return f"""lpx AS (SELECT project, version, trace, i, x, y,
                count(*) OVER (PARTITION BY project, version, trace) AS n FROM {src}),
lpe AS (
  SELECT project, version, trace, {pad} + i AS j, y AS e, n FROM lpx
  UNION ALL
  SELECT a.project, a.version, a.trace, {pad} - b.i, 2 * a.y - b.y, a.n
  FROM lpx a JOIN lpx b ON b.project = a.project AND b.version = a.version AND b.trace = a.trace
   AND a.i = 0 AND b.i BETWEEN 1 AND {pad}
  UNION ALL
  SELECT a.project, a.version, a.trace, {pad} + a.n + (a.n - 2 - b.i), 2 * a.y - b.y, a.n
  FROM lpx a JOIN lpx b ON b.project = a.project AND b.version = a.version AND b.trace = a.trace
   AND a.i = a.n - 1 AND b.i BETWEEN a.n - {pad + 1} AND a.n - 2),
{recursion("lpf", "lpe")},
lpr AS (SELECT f.project, f.version, f.trace, (e.n + {2 * pad} - 1) - f.j AS j, f.yo AS e, e.n
        FROM lpf f JOIN (SELECT DISTINCT project, version, trace, n FROM lpe) e
          ON e.project = f.project AND e.version = f.version AND e.trace = f.trace),
{recursion("lpb", "lpr")}
SELECT s.project, s.version, {tr} AS trace, s.i, {_r("s.x")} AS x, {_r("b.yo")} AS {ycol}
FROM lpb b JOIN lpx s ON s.project = b.project AND s.version = b.version AND s.trace = b.trace
 AND s.i = (s.n + {2 * pad} - 1 - b.j) - {pad}"""


ORACLE["lowpass"] = "WITH RECURSIVE " + ",\n".join(S.BASE[:-2] + [S.F3, S.signal("f3", "s3")]) + ",\n" + \
    _lowpass_sql("s3", 0.1).replace(
        " AS y\nFROM lpb b", " AS y, 'TIME' AS domain\nFROM lpb b")
ORACLE["lowpass_derivative"] = "WITH RECURSIVE " + ",\n".join(S.BASE) + ",\n" + \
    "clk AS (SELECT * FROM s1 WHERE trace = 'click'),\n" + \
    _lowpass_sql("clk", 0.1, out_trace="click_lp").replace(
        " AS y\nFROM lpb b", " AS y, 'TIME' AS domain\nFROM lpb b")
ORACLE["lowpass_overlay"] = "WITH RECURSIVE " + ",\n".join(S.BASE) + ",\n" + \
    _lowpass_sql("s1", 0.1, ycol="y_overlay").replace(
        " AS y_overlay\nFROM lpb b", " AS y_overlay, 'Lowpass' AS filter\nFROM lpb b")


@register("spectrum_long_paths", S.with_(*S.BASE, _dft_sql(
    "SELECT version, trace, i, y FROM s1", "mag.trace", _F1_EVT, "events")))
def q_spectrum_long_paths(spark, sf):
    """L5 with the long-trace paths forced (max_single=32) on every events
    trace: lengths with a balanced split take the four-step FFT, the others
    (primes, 2 x prime, ...) Bluestein's chirp-z transform."""
    sig, _ = _raw_signal(spark, sf, "events")
    return _sig_out(SP.spectrum(sig, 0.5, "ms", display_unit="Hz", max_single=32))


@register("savgol_wide", ORACLE["savgol_percent"])
def q_savgol_wide(spark, sf):
    """L3 "3%" windows over blocks of 16 samples, so that windows span many
    blocks and their middle comes from block moments."""
    sig, st = _raw_signal(spark, sf, "events")
    prm = (st.registry(spark).where((F.col("project") == "events") & F.col("derivative").isNull())
           .select("project", "trace", F.lit(FL.SAVGOL_DEFAULT_WINDOW).alias("window_length"),
                   F.lit(FL.SAVGOL_DEFAULT_POLYORDER).alias("polyorder")))
    out = FL.savgol(sig, prm, min_chunk=16)
    return out.select("project", "version", "trace", "i", rnd("x").alias("x"),
                      rnd("y").alias("y_overlay"), F.lit(FL.SAVGOL_NAME).alias("filter"))


@register("lowpass_low", "WITH RECURSIVE " + ",\n".join(S.BASE) + ",\n" + _lowpass_sql("s1", 1e-3).replace(
    _r("b.yo"), "floor(b.yo * 1.414213562373095e3 + 0.5) / 1.414213562373095e3"))
def q_lowpass_low(spark, sf):
    """L2 at Wn 1e-3 (1 Hz at the project's 0.5 ms step) on every raw events
    trace: a response far longer than a block.  Compared on a grid of 1e-3,
    as the textbook recurrence itself loses digits at this cutoff."""
    sig, _ = _raw_signal(spark, sf, "events")
    out = FL.lowpass(sig, "1 Hz", 0.5, "ms", min_chunk=256)
    return out.select("project", "version", "trace", "i", rnd("x").alias("x"),
                      (F.floor(F.col("y") * F.lit(1.414213562373095e3) + F.lit(0.5)) / F.lit(1.414213562373095e3)).alias("y"))
