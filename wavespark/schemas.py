"""Table schemas (long layout: one row per sample)."""

from pyspark.sql import types as T

SAMPLES = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("trace", T.StringType(), False),
    T.StructField("i", T.LongType(), False),
    T.StructField("y_raw", T.LongType(), True),
])

# Signal frame: input/output contract of every operator.
SIGNAL_COLS = ["project", "version", "trace", "i", "x", "y", "domain"]

COLUMN_SPEC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("radix", T.StringType()),
])

CAPTURES = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("source_uri", T.StringType(), True),
    T.StructField("change_id", T.TimestampType(), True),
    T.StructField("t0_index", T.LongType(), True),
    T.StructField("n_samples", T.LongType(), True),
    T.StructField("columns", T.ArrayType(COLUMN_SPEC), True),
])

BLOCK_STATS = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("trace", T.StringType(), False),
    T.StructField("block", T.LongType(), False),
    T.StructField("rows", T.LongType(), False),
    T.StructField("n", T.LongType(), False),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("mean", T.DoubleType(), True),
    T.StructField("m2", T.DoubleType(), True),
    T.StructField("first_set", T.LongType(), True),
])

PROJECTS = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("implied_dt", T.DoubleType(), False),
    T.StructField("dt_unit", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
])

OVERLAY = T.StructType([
    T.StructField("filter_name", T.StringType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("window_length", T.StringType()),
    T.StructField("polyorder", T.IntegerType()),
])

DERIVATIVE = T.StructType([
    T.StructField("function", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("sources", T.ArrayType(T.StringType())),
])

REGISTRY = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("trace", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("y_scale", T.DoubleType(), False),
    T.StructField("y_offset", T.DoubleType(), False),
    T.StructField("overlay", OVERLAY, True),
    T.StructField("stat_functions", T.ArrayType(T.StringType()), True),
    T.StructField("derivative", DERIVATIVE, True),
    T.StructField("ord", T.IntegerType(), False),
])

NOTES = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("trace", T.StringType(), False),
    T.StructField("note", T.StringType(), True),
])

TRACE_SPEC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("trace_version", T.IntegerType()),
    T.StructField("on_axis", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("show_filtered_trace", T.BooleanType()),
    T.StructField("show_legends", T.BooleanType()),
])

SUB_PLOT = T.StructType([
    T.StructField("row", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("left_axis_label", T.StringType()),
    T.StructField("right_axis_label", T.StringType()),
    T.StructField("x_axis_label", T.StringType()),
    T.StructField("show_grid", T.BooleanType()),
    T.StructField("legend_location", T.StringType()),
    T.StructField("traces", T.ArrayType(TRACE_SPEC)),
])

VIEWS = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("view_name", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("num_rows", T.IntegerType(), False),
    T.StructField("num_columns", T.IntegerType(), False),
    T.StructField("sub_plots", T.ArrayType(SUB_PLOT), False),
])
