"""JSON configuration scan and sink (S12): trace registry (``data/config.json``),
project settings (``project.json``) and views (``data/views.json``) of
project folders ``<root>/<project>/...``.

Scans read every project of a root in one job (``multiLine`` JSON with an
explicit schema, the project name taken from the path) and fill the
reference's defaults for missing keys.  Sinks write one file per project
(``partitionBy``-free: each project's document is built by a grouped
aggregate of its own small registry and written as text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_OVERLAY_JSON = T.StructType([
    T.StructField("filter_name", T.StringType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("window_length", T.StringType()),
    T.StructField("polyorder", T.LongType()),
])

TRACE_JSON = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("show_legend", T.BooleanType()),
    T.StructField("legend_location", T.StringType()),
    T.StructField("x_label", T.StringType()),
    T.StructField("y_label", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("show_grid", T.BooleanType()),
    T.StructField("y_scale", T.StringType()),   # raw text: an integer literal is rejected
    T.StructField("y_offset", T.StringType()),
    T.StructField("overlay", _OVERLAY_JSON),
    T.StructField("stat_functions", T.ArrayType(T.StringType())),
    T.StructField("derivative", T.BooleanType()),
    T.StructField("derivative_function", T.StringType()),
    T.StructField("derivative_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("derivative_sources", T.ArrayType(T.StringType())),
])

#: ``before``: traces in the documents before this one (absent: none).
REGISTRY_JSON = T.StructType([T.StructField("before", T.LongType()), T.StructField("traces", T.ArrayType(TRACE_JSON))])

REGISTRY_FILE, VIEWS_FILE = "data/config.json", "data/views.json"

PROJECT_JSON = T.StructType([
    T.StructField("project_version", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("dir", T.StringType()),
    T.StructField("implied_dt", T.DoubleType()),
    T.StructField("dt_unit", T.StringType()),
    T.StructField("latest_traces_version", T.LongType()),
    T.StructField("trace_source", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("last_modified", T.DoubleType())])),
    T.StructField("description", T.StringType()),
])

_SPEC_JSON = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("trace_version", T.LongType()),
    T.StructField("on_axis", T.StringType()), T.StructField("color", T.StringType()),
    T.StructField("show_filtered_trace", T.BooleanType()), T.StructField("show_legends", T.BooleanType()),
])
_SUBPLOT_JSON = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("column", T.LongType()),
    T.StructField("left_axis_label", T.StringType()), T.StructField("right_axis_label", T.StringType()),
    T.StructField("x_axis_label", T.StringType()), T.StructField("show_grid", T.BooleanType()),
    T.StructField("legend_location", T.StringType()),
    T.StructField("traces", T.ArrayType(_SPEC_JSON)),
])
VIEW_JSON = T.StructType([
    T.StructField("spec_version", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("view_name", T.StringType()), T.StructField("num_rows", T.LongType()),
    T.StructField("num_columns", T.LongType()), T.StructField("sub_plots", T.ArrayType(_SUBPLOT_JSON)),
])


def _project_of(path_col: str, depth_from_end: int) -> F.Column:
    parts = F.split(F.col(path_col), "/")
    return F.element_at(parts, -depth_from_end)


def _float_text(c: F.Column, key: str, default: float) -> F.Column:
    """A float config value: absent -> default; an integer literal (no '.',
    'e') raises like the reference's type check."""
    ok = c.rlike(r"^-?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][-+]?\d+|nan|inf)$")
    return (F.when(c.isNull(), F.lit(default))
            .when(ok, c.cast("double"))
            .otherwise(F.raise_error(F.concat(F.lit(f"config entry {key} has a value of another kind: "), c))))


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<project>/data/config.json`` and the documents it goes on in
    -> registry rows (defaults: state Active, scale 1.0, offset 0.0, overlay
    None, no statistics)."""
    raw = (spark.read.schema(REGISTRY_JSON).option("multiLine", True)
           .json(_documents(root, REGISTRY_FILE))
           .withColumn("project", _project_of("_metadata.file_path", 3)))
    return _registry_from_raw(raw.select("project", "before", "traces"))


def write_registry(registry: DataFrame, root: str) -> None:
    """Registry -> ``<root>/project=<p>/``: one JSON line per trace with its
    place in the registry, so no task gathers a project."""
    rows = registry.select("project", F.to_json(F.struct("ord", _trace_json().alias("trace")),
                                                {"ignoreNullFields": "true"}).alias("value"))
    rows.write.mode("overwrite").partitionBy("project").text(root)


def _trace_json() -> F.Column:
    d = F.col("derivative")
    return F.struct(F.col("trace").alias("name"), F.col("label"), F.col("state"), F.col("y_scale"), F.col("y_offset"),
                    F.col("overlay"), F.col("stat_functions"), d.isNotNull().alias("derivative"),
                    F.coalesce(d["function"], F.lit("")).alias("derivative_function"),
                    F.coalesce(d["params"], F.create_map().cast("map<string,string>")).alias("derivative_params"),
                    F.coalesce(d["sources"], F.array().cast("array<string>")).alias("derivative_sources"))


#: Items (traces, views) of one document; a longer list goes on in numbered
#: documents beside it, so that no task writes or reads a whole long list.
DOCUMENT_ITEMS = 20_000


def continued(name: str, part: int) -> str:
    """Name of a document's ``part``: ``config.json``, ``config.00001.json``, ..."""
    stem, dot, ending = name.rpartition(".")
    return f"{stem}.{part:05}{dot}{ending}" if part else name


def _documents(root: str, name: str) -> str:
    """Pattern of a document of every project with the documents that go on."""
    stem, _, ending = name.rpartition(".")
    return f"{root}/*/{stem}{{.{ending},.[0-9]*.{ending}}}"


def export_documents(rows: DataFrame, root: str, name: str, opening: str, closing: str,
                     items: int | None = None) -> DataFrame:
    """Write ``<root>/<project>/<name>`` for every project, the layout that
    :func:`read_registry` and :func:`read_views` scan: ``rows`` (project, ord,
    value), sorted by (project, ord), are streamed into the document between
    ``opening`` (where ``%d`` stands for the number of items before) and
    ``closing``; after ``items`` of them the next document begins
    (:func:`continued`), so a long list is spread over tasks.  Documents of an
    earlier, longer list are deleted.  Returns (project, items), after the
    files are written."""
    from ..operators.indexing import dense_index
    from ..operators.util import bounded_broadcast
    from ..session import qualified, remove, scratch_path
    spark = rows.sparkSession
    uri = qualified(spark, root)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = items or DOCUMENT_ITEMS
    numbered = dense_index(rows.select("project", "ord", "value"), ["project"], ["ord"], "_nth")
    ranked = numbered.scratch
    numbered = numbered.withColumn("_part", F.floor(F.col("_nth") / size))
    last = numbered.groupBy("project").agg(F.max("_part").alias("_last"))
    part = (numbered.join(bounded_broadcast(last), "project").select("project", "_part", "_last", "_nth", "value")
            .repartition(n, "project", "_part").sortWithinPartitions("project", "_part", "_nth"))

    def run(batches):
        import pandas as pd
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(uri)
        at, out, count = None, None, 0

        def clear(folder, document, last):
            stem, _, ending = document.rpartition(".")
            for f in store.get_file_info(fs.FileSelector(folder)):
                middle = f.base_name[len(stem) + 1:-len(ending) - 1]
                if f.base_name == f"{stem}.{middle}.{ending}" and middle.isdecimal() and int(middle) > last:
                    store.delete_file(f.path)

        def close():
            out.write(closing.encode())
            out.close()
            return pd.DataFrame({"project": [at[0]], "items": [count]})

        for pdf in batches:
            for p, k, last, v in zip(pdf["project"], pdf["_part"], pdf["_last"], pdf["value"]):
                if (p, k) != at:
                    if out is not None:
                        yield close()
                    path = f"{base}/{p}/{continued(name, k)}"
                    folder, _, document = path.rpartition("/")
                    store.create_dir(folder, recursive=True)
                    if k == 0:
                        clear(folder, document, last)
                    at, out, count = (p, k), store.open_output_stream(path), 0
                    out.write(opening.replace("%d", str(k * size)).encode())
                out.write((("," if count else "") + v).encode())
                count += 1
        if out is not None:
            yield close()

    done = scratch_path(spark, "documents")
    part.mapInPandas(run, "project string, items bigint").write.mode("overwrite").parquet(done)
    remove(spark, ranked)
    return spark.read.parquet(done).groupBy("project").agg(F.sum("items").alias("items"))


def export_registry(registry: DataFrame, root: str) -> DataFrame:
    """``<root>/<project>/data/config.json`` of every project."""
    rows = registry.select("project", "ord", F.to_json(_trace_json(), {"ignoreNullFields": "true"}).alias("value"))
    return export_documents(rows, root, REGISTRY_FILE, '{"before": %d, "traces": [', "]}")


def export_views(views: DataFrame, root: str) -> DataFrame:
    """``<root>/<project>/data/views.json`` of every project."""
    doc = F.struct(F.lit(1).alias("spec_version"), "title", "view_name", "num_rows", "num_columns", "sub_plots")
    rows = views.select("project", F.col("view_name").alias("ord"), F.to_json(doc).alias("value"))
    return export_documents(rows, root, VIEWS_FILE, "[", "]", DOCUMENT_ITEMS // 32)


def export_projects(projects: DataFrame, root: str) -> DataFrame:
    """``<root>/<project>/project.json`` of every project."""
    doc = F.struct(F.lit(1).alias("project_version"), F.col("project").alias("name"), "implied_dt", "dt_unit", "description")
    return export_documents(projects.select("project", F.lit(0).alias("ord"), F.to_json(doc).alias("value")),
                            root, "project.json", "", "")


def read_registry_written(spark: SparkSession, root: str) -> DataFrame:
    """Read back what :func:`write_registry` wrote (project from the folder)."""
    line = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("trace", TRACE_JSON)])
    raw = spark.read.schema(line).json(f"{root}/project=*/*.txt")
    return _registry_entries(raw.select(
        F.regexp_extract("_metadata.file_path", r"project=([^/]+)/", 1).alias("project"), "ord", F.col("trace").alias("t")))


def _registry_from_raw(raw: DataFrame) -> DataFrame:
    each = raw.select("project", "before", F.posexplode("traces").alias("pos", "t"))
    return _registry_entries(each.select("project", (F.coalesce("before", F.lit(0)) + F.col("pos")).alias("ord"), "t"))


def _registry_entries(t: DataFrame) -> DataFrame:
    st = F.coalesce(F.col("t.state"), F.lit("Active"))
    is_der = F.coalesce(F.col("t.derivative"), F.lit(False))
    ov = F.col("t.overlay")
    return t.select(
        "project", F.coalesce("t.name", F.lit("Unknown")).alias("trace"),
        F.coalesce("t.label", F.lit("Unknown")).alias("label"),
        F.when(st == "Active", st).otherwise(F.lit("Inactive")).alias("state"),
        _float_text(F.col("t.y_scale"), "y_scale", 1.0).alias("y_scale"),
        _float_text(F.col("t.y_offset"), "y_offset", 0.0).alias("y_offset"),
        F.struct(F.coalesce(ov["filter_name"], F.lit("None")).alias("filter_name"),
                 ov["frequency"].alias("frequency"), ov["window_length"].alias("window_length"),
                 ov["polyorder"].cast("int").alias("polyorder")).alias("overlay"),
        F.coalesce("t.stat_functions", F.array().cast("array<string>")).alias("stat_functions"),
        F.when(is_der, F.struct(F.col("t.derivative_function").alias("function"),
                                F.coalesce("t.derivative_params", F.create_map().cast("map<string,string>"))
                                .alias("params"),
                                F.coalesce("t.derivative_sources", F.array().cast("array<string>"))
                                .alias("sources"))).alias("derivative"),
        F.col("ord").cast("int").alias("ord"))


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<project>/project.json`` -> projects rows (+ latest version,
    trace source); dt unit defaults to "ms"."""
    raw = spark.read.schema(PROJECT_JSON).option("multiLine", True).json(f"{root}/*/project.json")
    return raw.select(F.col("name").alias("project"), F.col("implied_dt"),
                      F.coalesce("dt_unit", F.lit("ms")).alias("dt_unit"),
                      F.coalesce("description", F.lit("")).alias("description"),
                      F.coalesce("latest_traces_version", F.lit(0)).cast("int").alias("latest_traces_version"),
                      "trace_source")


def list_project_names(spark: SparkSession, root: str) -> DataFrame:
    """Project folder names holding a ``project.json``, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "project.json") \
        .option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(_project_of("path", 2).alias("project")).distinct().orderBy("project")


def write_projects(projects: DataFrame, root: str) -> None:
    """Projects -> ``<root>/project=<p>/*.txt`` holding the project.json document."""
    doc = projects.select("project", F.to_json(F.struct(
        F.lit(1).alias("project_version"), F.col("project").alias("name"),
        F.col("implied_dt"), F.col("dt_unit"), F.col("description"))).alias("value"))
    doc.write.mode("overwrite").partitionBy("project").text(root)


def read_views(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<project>/data/views.json`` (a JSON array of view specs) and
    the documents it goes on in -> views rows; optional keys default to "", false or "None"; a spec version
    other than 1 raises."""
    raw = (spark.read.schema(VIEW_JSON).option("multiLine", True).json(_documents(root, VIEWS_FILE))
           .withColumn("project", _project_of("_metadata.file_path", 3)))
    return views_from_raw(raw)


def views_from_raw(raw: DataFrame) -> DataFrame:
    sv = F.col("spec_version")
    checked = F.when(sv == 1, F.col("view_name")).otherwise(
        F.raise_error(F.concat(F.lit("no reader for views of spec version "), sv.cast("string"))))

    def spec(t):
        return F.struct(t["name"].alias("name"), t["trace_version"].cast("int").alias("trace_version"),
                        t["on_axis"].alias("on_axis"), t["color"].alias("color"),
                        F.coalesce(t["show_filtered_trace"], F.lit(False)).alias("show_filtered_trace"),
                        F.coalesce(t["show_legends"], F.lit(False)).alias("show_legends"))

    def sub(sp):
        return F.struct(sp["row"].cast("int").alias("row"), sp["column"].cast("int").alias("column"),
                        F.coalesce(sp["left_axis_label"], F.lit("")).alias("left_axis_label"),
                        F.coalesce(sp["right_axis_label"], F.lit("")).alias("right_axis_label"),
                        F.coalesce(sp["x_axis_label"], F.lit("")).alias("x_axis_label"),
                        F.coalesce(sp["show_grid"], F.lit(False)).alias("show_grid"),
                        F.coalesce(sp["legend_location"], F.lit("None")).alias("legend_location"),
                        F.transform(F.coalesce(sp["traces"], F.array()), spec).alias("traces"))
    return raw.select("project", checked.alias("view_name"), F.col("title"),
                      F.col("num_rows").cast("int").alias("num_rows"),
                      F.col("num_columns").cast("int").alias("num_columns"),
                      F.transform("sub_plots", sub).alias("sub_plots"))


def write_views(views: DataFrame, root: str) -> None:
    """Views -> ``<root>/project=<p>/*.txt``: one JSON array per project."""
    doc = F.struct(F.lit(1).alias("spec_version"), F.col("title"), F.col("view_name"),
                   F.col("num_rows"), F.col("num_columns"), F.col("sub_plots"))
    out = views.groupBy("project").agg(F.to_json(F.collect_list(doc)).alias("value"))
    out.write.mode("overwrite").partitionBy("project").text(root)


def read_views_written(spark: SparkSession, root: str) -> DataFrame:
    arr = T.ArrayType(VIEW_JSON)
    raw = (spark.read.text(f"{root}/project=*/*.txt")
           .select(F.regexp_extract("_metadata.file_path", r"project=([^/]+)/", 1).alias("project"),
                   F.explode(F.from_json("value", arr)).alias("v"))
           .select("project", "v.*"))
    return views_from_raw(raw)
