"""Function dispatch (J5) and derivative-trace resolution.

A derivative trace is a registry entry with a function, its parameters and an
ordered list of source names; it is computed on read, never stored, and its
sources may themselves be derivative.  Resolution walks the (small) registry
of one project on the driver, fetching only the entries it references (one
small query per DAG level) -- it is the plan, not the data -- and composes
one lazy DataFrame per trace; a source shared by several traces is
the same DataFrame, so Spark reuses its exchange.  Sources are looked up at
the version being computed: the frame carries all versions at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pointwise
from .signal import KEY, apply_scale_offset, time_axis
from .util import fail

# Configuration names of the functions and their display names.
FUNCTION_NAMES = {
    "add": "Add",
    "subtract": "Subtract",
    "multiply": "Multiply",
    "divide": "Divide",
    "lowpass_filter": "Lowpass Filter",
    "fourier_transform": "Fourier Transform",
}


@dataclass(frozen=True)
class ProjectContext:
    project: str
    implied_dt: float = 1.0
    dt_unit: str = "ms"


def _lowpass(df, sources, name, params, ctx):
    from .filters import lowpass
    if len(sources) != 1:
        raise ValueError(f"the low-pass takes one source, got {sources}")
    return lowpass(df, params["cutoff_frequency"], ctx.implied_dt, ctx.dt_unit, out_trace=name)


def _fourier(df, sources, name, params, ctx):
    from .spectrum import spectrum
    if len(sources) != 1:
        raise ValueError(f"the spectrum takes one source, got {sources}")
    return spectrum(df, ctx.implied_dt, ctx.dt_unit,
                    display_unit=params.get("display_frequency_unit", "Hz"),
                    out_trace=name)


def function_builder(function_name: str):
    """Config name -> builder(df, sources, out_name, params, ctx)."""
    table = {
        "add": lambda df, s, n, p, c: pointwise.add(df, s, n),
        "subtract": lambda df, s, n, p, c: pointwise.subtract(df, s, n),
        "multiply": lambda df, s, n, p, c: pointwise.multiply(df, s, n),
        "divide": lambda df, s, n, p, c: pointwise.divide(df, s, n),
        "lowpass_filter": _lowpass,
        "fourier_transform": _fourier,
    }
    if function_name not in table:
        raise ValueError(f"no derivative function is called {function_name!r}; known: {sorted(table)}")
    return table[function_name]


# The pointwise functions as folds over source columns.
POINTWISE = {
    "add": lambda ys, names: reduce(lambda a, b: a + b, ys),
    "multiply": lambda ys, names: reduce(lambda a, b: a * b, ys),
    "subtract": lambda ys, names: ys[0] - ys[1],
    "divide": lambda ys, names: F.when(ys[1] == 0, fail(
        f"trace {names[1]} is zero where it should divide {names[0]}")).otherwise(ys[0] / ys[1]),
}


@dataclass
class _Resolver:
    raw: DataFrame
    registry: DataFrame  # one project's entries
    ctx: ProjectContext
    captures: DataFrame | None = None
    projects: DataFrame | None = None
    known: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict)

    def fetch(self, refs: list[str]) -> None:
        """Look up names/labels in one small query; only the referenced
        entries reach the driver (bounded by the derivative DAG)."""
        missing = [r for r in dict.fromkeys(refs) if r not in self.known]
        if not missing:
            return
        rows = (self.registry.where(F.col("trace").isin(missing) | F.col("label").isin(missing))
                .select("trace", "label", "y_scale", "y_offset", "derivative", "ord")
                .orderBy("ord").collect())
        for ref in missing:
            self.known[ref] = next((r for r in rows if r["trace"] == ref or r["label"] == ref), None)

    def lookup(self, ref: str):
        """First registry entry (registry order) whose name or label is ``ref``."""
        self.fetch([ref])
        r = self.known[ref]
        if r is None:
            raise KeyError(f"trace [{ref}] not found in project [{self.ctx.project}]")
        return r

    def sources(self, r, visiting: tuple) -> list[str]:
        name = r["trace"]
        if name in visiting:
            raise ValueError(f"derivative trace {name!r} is a source of itself")
        refs = list(r["derivative"]["sources"] or [])
        self.fetch(refs)
        return [self.lookup(s)["trace"] for s in refs]

    def function(self, ref: str) -> str | None:
        d = self.lookup(ref)["derivative"]
        return d["function"] if d is not None else None

    def expression(self, ref: str, leaves: list[str], visiting: tuple):
        """y of a trace as an expression over one column per leaf, a leaf being
        a trace that no pointwise function makes; appends new leaves."""
        r = self.lookup(ref)
        name, fn = r["trace"], self.function(ref)
        if fn not in POINTWISE:
            if name not in leaves:
                leaves.append(name)
            return F.col(f"_y{leaves.index(name)}")
        srcs = self.sources(r, visiting)
        pointwise.check_sources(fn, srcs)
        y = POINTWISE[fn]([self.expression(s, leaves, visiting + (name,)) for s in srcs], srcs)
        return F.lit(float(r["y_scale"])) * y + F.lit(float(r["y_offset"]))

    def first_leaf(self, ref: str) -> str:
        while self.function(ref) in POINTWISE:
            ref = self.sources(self.lookup(ref), ())[0]
        return self.lookup(ref)["trace"]

    def frame(self, ref: str, visiting: tuple = ()) -> DataFrame:
        r = self.lookup(ref)
        name, fn = r["trace"], self.function(ref)
        if name in self.memo:
            return self.memo[name]
        if fn is None:
            out = self.raw.where(F.col("trace") == name)
        elif fn in POINTWISE:
            # a whole tree of pointwise functions is one aggregate by (version, i)
            leaves: list[str] = []
            y = self.expression(ref, leaves, visiting)
            parts = [self.frame(s, visiting + (name,)) for s in leaves]
            every = reduce(DataFrame.unionByName, parts)
            one = [F.max(F.when(F.col("trace") == s, F.col("y"))).alias(f"_y{k}") for k, s in enumerate(leaves)]
            x = F.max(F.when(F.col("trace") == self.first_leaf(ref), F.col("x"))).alias("x")
            agg = every.groupBy("project", "version", "i").agg(x, F.count(F.lit(1)).alias("_n"), *one)
            out = agg.where(F.col("_n") == len(leaves)).select(
                "project", "version", F.lit(name).alias("trace"), "i", "x", y.alias("y"), F.lit("TIME").alias("domain"))
            if self.function(self.first_leaf(ref)) == "fourier_transform":
                out = self.on_time_axis(out)
        else:
            srcs = self.sources(r, visiting)
            parts = [self.frame(s, visiting + (name,)) for s in dict.fromkeys(srcs)]
            union = reduce(DataFrame.unionByName, parts)
            built = function_builder(fn)(union, srcs, name, dict(r["derivative"]["params"] or {}), self.ctx)
            out = apply_scale_offset(built, r["y_scale"], r["y_offset"])
            if fn == "lowpass_filter":  # a function of samples, whatever they stand for
                out = out.withColumn("domain", F.lit("TIME"))
                if self.function(self.first_leaf(srcs[0])) == "fourier_transform":
                    out = self.on_time_axis(out)
        self.memo[name] = out
        return out

    def on_time_axis(self, df: DataFrame) -> DataFrame:
        """x by sample number: a function of spectra has a time axis of its own."""
        cap = self.captures if self.captures is not None else df.sparkSession.createDataFrame(
            [], "project string, version int, t0_index bigint")
        return time_axis(df.drop("x"), cap, self.projects).select(*KEY, "i", "x", "y", "domain")


def resolve(raw_signal: DataFrame, registry: DataFrame, projects: DataFrame,
            project: str, traces: list[str], captures: DataFrame | None = None) -> DataFrame:
    """Signal frame of the named traces (names or labels) of one project.

    ``captures`` gives t0 to functions of spectra, whose time axis is their
    own (without it t0 = 0).

    ``raw_signal`` is the transformed raw signal frame (P5/P6 applied) of that
    project, all versions wanted.  Derivative traces get their function, then
    their own scale/offset.
    """
    prj = projects.where(F.col("project") == project).select("implied_dt", "dt_unit").collect()
    ctx = ProjectContext(project, *(tuple(prj[0]) if prj else ()))
    res = _Resolver(raw_signal.where(F.col("project") == project),
                    registry.where(F.col("project") == project), ctx, captures, projects)
    res.fetch(traces)
    names = list(dict.fromkeys(traces))
    stored = [res.lookup(t)["trace"] for t in names if res.function(t) is None]
    frames = [res.frame(t) for t in names if res.function(t) is not None]
    if stored:  # all raw traces are one scan
        frames.insert(0, res.raw.where(F.col("trace").isin(stored)))
    return reduce(DataFrame.unionByName, frames)


def domain_types(registry: DataFrame) -> DataFrame:
    """P7 per registry entry: (project, trace, domain)."""
    from .signal import domain_of
    return registry.select("project", "trace", domain_of(F.col("derivative.function")).alias("domain"))
