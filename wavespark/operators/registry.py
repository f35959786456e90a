"""Trace registry queries and maintenance.

The registry is a small table (one row per trace per project).  Updates are
expressed as DataFrame -> DataFrame rewrites (``when`` / anti-join /
``unionByName``); guards that must fail fast are checked with bounded
queries before the rewrite is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

LABEL_PATTERN = r"^[a-zA-Z0-9\[\]_\-+. ]+$"


def normalized_state(c: Column | str = "state") -> Column:
    """Anything but "Active" reads as Inactive."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "Active", F.lit("Active")).otherwise(F.lit("Inactive"))


def by_state(registry: DataFrame, state: str) -> DataFrame:
    """P2."""
    return registry.where(normalized_state() == state)


def by_ref(registry: DataFrame, ref: str) -> DataFrame:
    """Name or label equals ``ref`` (several may match)."""
    return registry.where((F.col("trace") == ref) | (F.col("label") == ref))


def first_match(registry: DataFrame, ref: str, by: str = "either") -> DataFrame:
    """First entry (registry order) per project matching by name, label
    or either."""
    cond = {"name": F.col("trace") == ref, "label": F.col("label") == ref,
            "either": (F.col("trace") == ref) | (F.col("label") == ref)}[by]
    w = Window.partitionBy("project").orderBy("ord")
    return (registry.where(cond).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn"))


def label_search(registry: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive substring on the trimmed pattern."""
    p = pattern.strip().lower()
    return registry.where(F.instr(F.lower(F.col("label")), p) > 0)


def label_check(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """(project, trace, new_label) -> adds ``valid`` and ``reason``.

    Valid: non-empty after trim, matches the allowed characters, and not used
    as a label or name by another trace of the project."""
    taken = registry.select(F.col("project").alias("_tp"), F.col("trace").alias("_owner"),
                            F.explode(F.array("trace", "label")).alias("_used"))
    clash = (candidates.join(taken, (F.col("project") == F.col("_tp"))
                             & (F.col("new_label") == F.col("_used"))
                             & (F.col("trace") != F.col("_owner")), "left_semi")
             .select("project", "trace", "new_label").distinct().withColumn("_clash", F.lit(True)))
    t = F.trim(F.col("new_label"))
    reason = (F.when(t == "", F.lit("empty"))
              .when(~F.col("new_label").rlike(LABEL_PATTERN), F.lit("invalid characters"))
              .when(F.coalesce(F.col("_clash"), F.lit(False)), F.lit("already used")))
    return (candidates.join(clash, ["project", "trace", "new_label"], "left")
            .withColumn("reason", reason)
            .withColumn("valid", F.col("reason").isNull()).drop("_clash"))


def consensus(registry: DataFrame) -> DataFrame:
    """P10: per project, the scale (offset) shared by all selected traces,
    else 1.0 (0.0)."""
    return registry.groupBy("project").agg(
        F.when(F.count_distinct("y_scale") == 1, F.first("y_scale")).otherwise(F.lit(1.0)).alias("y_scale"),
        F.when(F.count_distinct("y_offset") == 1, F.first("y_offset")).otherwise(F.lit(0.0)).alias("y_offset"))


def state_summary(registry: DataFrame) -> DataFrame:
    """Per (project, state) the number of traces; their labels in registry
    order are :func:`state_labels` (rows, as a project may hold any number)."""
    return (registry.withColumn("state", normalized_state())
            .groupBy("project", "state").agg(F.count(F.lit(1)).alias("n")))


def state_labels(registry: DataFrame) -> DataFrame:
    """(project, state, ord, label), to be read in the order of ``ord``."""
    return registry.select("project", normalized_state().alias("state"), "ord", "label")


def lookup(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """P3 in bulk: ``refs`` (project, ref) -> every entry whose name or label
    it is, with ``nth`` = 1 for the first in registry order (P4).  An equi-join
    on (project, ref)."""
    both = registry.select("project", F.explode(F.array_distinct(F.array("trace", "label"))).alias("ref"),
                           "trace", "label", "ord")
    w = Window.partitionBy("project", "ref").orderBy("ord")
    return refs.distinct().join(both, ["project", "ref"]).withColumn("nth", F.row_number().over(w))


# --------------------------------------------------------------------------
# Maintenance

def _one(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _is(project: str, trace: str | list[str] | Column) -> Column:
    """Selection: one name, a list of names, or any condition on the row."""
    if isinstance(trace, Column):
        t = trace
    elif isinstance(trace, list):
        t = F.col("trace").isin(trace)
    else:
        t = F.col("trace") == trace
    return (F.col("project") == project) & t


def rename_label(registry: DataFrame, project: str, trace: str, label: str) -> DataFrame:
    """No-op if equal; error if another trace uses it as label or name."""
    cur = registry.where(_is(project, trace))
    if _one(cur.where(F.col("label") == label)):
        return registry
    other = registry.where((F.col("project") == project) & (F.col("trace") != trace)
                           & ((F.col("label") == label) | (F.col("trace") == label)))
    if _one(other):
        raise RuntimeError(f"label {label!r} is taken in project {project!r}")
    return registry.withColumn("label", F.when(_is(project, trace), F.lit(label))
                               .otherwise(F.col("label")))


def set_state(registry: DataFrame, project: str, traces: list[str] | Column, state: str) -> DataFrame:
    """R2."""
    return registry.withColumn("state", F.when(_is(project, traces), F.lit(state))
                               .otherwise(F.col("state")))


def set_scale_offset(registry: DataFrame, project: str, traces: list[str] | Column,
                     y_scale: float | None = None, y_offset: float | None = None) -> DataFrame:
    """For one or many traces."""
    out = registry
    if y_scale is not None:
        out = out.withColumn("y_scale", F.when(_is(project, traces), F.lit(float(y_scale)))
                             .otherwise(F.col("y_scale")))
    if y_offset is not None:
        out = out.withColumn("y_offset", F.when(_is(project, traces), F.lit(float(y_offset)))
                             .otherwise(F.col("y_offset")))
    return out


def set_overlay(registry: DataFrame, project: str, trace: str | list[str] | Column, filter_name: str,
                frequency: str | None = None, window_length: str | None = None,
                polyorder: int | None = None) -> DataFrame:
    """Overlay of one trace (or a selection)."""
    ov = F.struct(F.lit(filter_name).alias("filter_name"), F.lit(frequency).cast("string").alias("frequency"),
                  F.lit(window_length).cast("string").alias("window_length"),
                  F.lit(polyorder).cast("int").alias("polyorder"))
    return registry.withColumn("overlay", F.when(_is(project, trace), ov).otherwise(F.col("overlay")))


def add_stat_function(registry: DataFrame, project: str, traces: list[str], fn: str) -> DataFrame:
    """Adding a listed statistic again moves it to the end."""
    from .stats import check_stat_names
    check_stat_names([fn])
    cur = F.coalesce(F.col("stat_functions"), F.array().cast("array<string>"))
    return registry.withColumn("stat_functions", F.when(
        _is(project, traces), F.array_append(F.array_remove(cur, fn), F.lit(fn)))
        .otherwise(F.col("stat_functions")))


def set_stat_functions(registry: DataFrame, project: str, traces: list[str], fns: list[str]) -> DataFrame:
    from .stats import check_stat_names
    check_stat_names(fns)
    arr = F.array(*[F.lit(f) for f in fns]).cast("array<string>")
    return registry.withColumn("stat_functions", F.when(_is(project, traces), arr)
                               .otherwise(F.col("stat_functions")))


def _canonical_sources(registry: DataFrame, project: str, sources: list[str]) -> list[str]:
    rows = (registry.where((F.col("project") == project)
                           & (F.col("trace").isin(sources) | F.col("label").isin(sources)))
            .select("trace", "label", "ord").orderBy("ord").collect())
    out = []
    for s in sources:
        hit = next((r["trace"] for r in rows if r["trace"] == s or r["label"] == s), None)
        if hit is None:
            raise KeyError(f"source trace [{s}] not found")
        out.append(hit)
    return out


def _derivative(function: str, sources: list[str], params: dict | None):
    from .derive import function_builder
    function_builder(function)  # validates the name
    if function in ("subtract", "divide") and len(sources) != 2:
        raise ValueError(f"{function} takes two sources, got {len(sources)}")
    if function in ("lowpass_filter", "fourier_transform") and len(sources) != 1:
        raise ValueError(f"{function} takes one source, got {len(sources)}")
    p = F.create_map(*[x for k, v in (params or {}).items() for x in (F.lit(k), F.lit(str(v)))]) \
        if params else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(function).alias("function"), p.alias("params"),
                    F.array(*[F.lit(s) for s in sources]).cast("array<string>").alias("sources"))


def add_derivative(registry: DataFrame, project: str, name: str, function: str,
                   sources: list[str], params: dict | None = None) -> DataFrame:
    """The name must not equal any name or label of the project; sources
    are stored by name (labels are resolved now)."""
    if _one(registry.where((F.col("project") == project)
                           & ((F.col("trace") == name) | (F.col("label") == name)))):
        raise RuntimeError(f"project {project!r} has a trace {name!r} already")
    srcs = _canonical_sources(registry, project, sources)
    nxt = registry.where(F.col("project") == project).agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    row = registry.sparkSession.range(1).select(
        F.lit(project).alias("project"), F.lit(name).alias("trace"), F.lit(name).alias("label"),
        F.lit("Active").alias("state"), F.lit(1.0).alias("y_scale"), F.lit(0.0).alias("y_offset"),
        F.lit(None).cast(schemas.OVERLAY).alias("overlay"),
        F.array().cast("array<string>").alias("stat_functions"),
        _derivative(function, srcs, params).alias("derivative"), F.lit(int(nxt)).alias("ord"))
    return registry.unionByName(row.select(*registry.columns))


def _dependency_cycle(registry: DataFrame, project: str, name: str, new_sources: list[str]) -> bool:
    """Level by level; only the derivatives reached are collected."""
    seen, frontier = set(), set(new_sources)
    while frontier:
        if name in frontier:
            return True
        seen |= frontier
        rows = registry.where((F.col("project") == project) & F.col("derivative").isNotNull()
                              & F.col("trace").isin(sorted(frontier))).select("derivative.sources").collect()
        frontier = {t for r in rows for t in r["sources"] or []} - seen
    return False


def update_derivative(registry: DataFrame, project: str, ref: str, function: str,
                      sources: list[str], params: dict | None = None) -> DataFrame:
    """By name, or by label of a derivative; cycles are rejected."""
    target = registry.where((F.col("project") == project) & F.col("derivative").isNotNull()
                            & ((F.col("trace") == ref) | (F.col("label") == ref)))
    hit = target.orderBy("ord").select("trace").limit(1).collect()
    if not hit:
        raise KeyError(f"derivative trace [{ref}] not found")
    name = hit[0][0]
    srcs = _canonical_sources(registry, project, sources)
    if _dependency_cycle(registry, project, name, srcs):
        raise ValueError(f"cyclic derivative definition through [{name}]")
    return registry.withColumn("derivative", F.when(_is(project, name), _derivative(function, srcs, params))
                               .otherwise(F.col("derivative")))


def delete_derivative(registry: DataFrame, project: str, name: str) -> DataFrame:
    """Raw traces are never deleted; a trace used by another derivative
    cannot be deleted."""
    if not _one(registry.where(_is(project, name) & F.col("derivative").isNotNull())):
        return registry  # raw or unknown: nothing to delete
    users = registry.where((F.col("project") == project)
                           & F.array_contains(F.col("derivative.sources"), name))
    if _one(users):
        raise ValueError(f"trace [{name}] is a source of another derivative trace")
    return registry.where(~(_is(project, name) & F.col("derivative").isNotNull()))
