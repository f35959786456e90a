"""Block rows: a trace as rows of ``MIN_CHUNK`` samples (arrays), and maps over
block rows and over bounded groups of them.

A trace can hold a third of all samples, and a grouped-map task cannot be
split; so operators that need neighbouring samples work on blocks and exchange
only what crosses a block's border.  Requires a dense index ``i`` = 0..n-1 per
trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["project", "version", "trace"]
MIN_CHUNK = 1 << 16
#: Rows, and values in their arrays, that a map hands on at a time.
OUT_ROWS, OUT_VALUES = 256, 1 << 21


def grouped_map(df: DataFrame, keys: list[str], order: str, fn, schema: str) -> DataFrame:
    """Apply ``fn(pdf) -> pdf`` to every ``keys`` group, groups sorted by
    ``order``.

    Same shuffle as ``groupBy(keys).applyInPandas`` (hash on the keys), but
    the rows are then sorted within partitions and streamed through
    ``mapInPandas``.  Groups are told apart by one hash of the keys that Spark
    computes; parts of a group that spans batches are kept in a list and
    joined once at its end, so the work is linear in the group's size.  Memory
    holds one group at a time (plus a batch); callers keep groups bounded.
    """
    part = df.withColumn("_gid", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions("_gid", *keys, order)

    def run(batches):
        import numpy as np
        import pandas as pd
        held, gid = [], None

        def done():
            out = fn(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
            return [out] if out is not None and len(out) else []

        for pdf in batches:
            if not len(pdf):
                continue
            g = pdf.pop("_gid").to_numpy()
            cut = np.flatnonzero(g[1:] != g[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, len(g)]):
                if held and g[a] != gid:
                    yield from done()
                    held = []
                gid = g[a]
                held.append(pdf.iloc[a:b].reset_index(drop=True))
        if held:
            yield from done()
    return part.mapInPandas(run, schema)


def to_blocks(sig: DataFrame, size: int, carry: list[str] | None = None) -> DataFrame:
    """One row per block of ``size`` samples: (KEY, block, x, y, domain) with
    x and y as arrays in sample order, and the per-trace columns ``carry``."""
    one = F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("_s")
    return (sig.groupBy(*KEY, F.floor(F.col("i") / size).cast("bigint").alias("block"))
            .agg(one, F.max("domain").alias("domain"), *[F.first(c).alias(c) for c in carry or []])
            .select(*KEY, "block", F.col("_s.x").alias("x"), F.col("_s.y").alias("y"), "domain", *(carry or [])))


def from_blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows (KEY, i, x, y, domain) of block rows."""
    return (df.select(*KEY, "block", "domain", F.posexplode(F.arrays_zip("x", "y")).alias("_k", "_v"))
            .select(*KEY, (F.col("block") * size + F.col("_k")).alias("i"), F.col("_v.x").alias("x"),
                    F.col("_v.y").alias("y"), "domain"))


def block_rows(batch) -> list[dict]:
    """Rows of an Arrow batch; list columns as numpy arrays (null: NaN)."""
    import numpy as np
    import pyarrow as pa
    cols = {}
    for name in batch.schema.names:
        col = batch.column(name)
        if pa.types.is_list(col.type):
            values, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            gone = col.is_null().to_numpy(zero_copy_only=False)
            cols[name] = [None if gone[k] else np.asarray(values[off[k]:off[k + 1]]) for k in range(len(col))]
        else:
            cols[name] = col.to_pylist()
    return [dict(zip(cols, r)) for r in zip(*cols.values())]


def _batches(rows, schema):
    """Row dicts as Arrow batches of bounded size, however many a function of
    one row or group gives."""
    import numpy as np
    import pyarrow as pa
    out, values = [], 0
    for r in rows:
        out.append(r)
        values += sum(len(v) for v in r.values() if isinstance(v, np.ndarray))
        if len(out) >= OUT_ROWS or values >= OUT_VALUES:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, values = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(row dict) -> iterable of dicts`` over block rows (arrays as numpy)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def run(batches):
        yield from _batches((o for b in batches for at in range(0, b.num_rows, 32)
                             for r in block_rows(b.slice(at, 32)) for o in fn(r)), arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], order: str, fn, schema: str) -> DataFrame:
    """``fn(list of row dicts) -> iterable of dicts`` over the groups of a
    small table (one row per block), sorted by ``order``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    part = df.repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches):
        yield from _batches((o for rows in groups(batches) for o in fn(rows)), arrow)

    def groups(batches):
        held, key = [], None
        for b in batches:
            for r in block_rows(b):
                k = tuple(r[c] for c in keys)
                if held and k != key:
                    yield held
                    held = []
                key = k
                held.append(r)
        if held:
            yield held

    return part.mapInArrow(run, schema)
