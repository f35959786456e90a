import os
import time

from pyspark.sql import functions as F

from wavespark.sources import capture, config, store


def _capture(d, name, rows, trig=None, extra=None):
    cols = ["TRIGGER", "a"] + ([extra] if extra else [])
    lines = [",".join(cols), "Radix - " + ",".join(["UNSIGNED"] * len(cols))]
    for k, v in enumerate(rows):
        t = (trig[k] if trig else 0)
        lines.append(",".join([str(t), str(v)] + (["7"] if extra else [])))
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_ingest_versions_change_detection_and_bootstrap(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    os.makedirs(src)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    p = _capture(src, "cap.csv", [1, 2, 3, 4], trig=[0, 0, 1, 1])
    os.utime(p, (1_000_000, 1_000_000))
    new = store.ingest(spark, st, capture.read_lines(spark, src), "p1").collect()
    assert [(r.version, r.t0_index, r.n_samples) for r in new] == [(1, 1, 4)]
    # unchanged source: nothing new
    assert store.ingest(spark, st, capture.read_lines(spark, src), "p1").count() == 0
    # changed (other content, a column added; mtime differs) -> version 2
    _capture(src, "cap.csv", [9, 8, 7], trig=[1, 0, 0], extra="b")
    os.utime(p, (2_000_000, 2_000_000))
    new = store.ingest(spark, st, capture.read_lines(spark, src), "p1").collect()
    assert [(r.version, r.t0_index) for r in new] == [(2, 0)]
    # registry written once, from the first version's columns
    reg = st.registry(spark).orderBy("ord").collect()
    assert [r.trace for r in reg] == ["TRIGGER", "a"]
    assert all(r.state == "Active" and r.label == r.trace for r in reg)
    # notes: empty at the first load, carried to version 2 (only first-load columns)
    notes = st.notes(spark).orderBy("version", "trace").collect()
    assert [(n.version, n.trace, n.note) for n in notes] == [
        (1, "TRIGGER", ""), (1, "a", ""), (2, "TRIGGER", ""), (2, "a", "")]
    smp = store.read_version(spark, st, "p1", 2, ["a", "b"]).orderBy("trace", "i").collect()
    assert [(r.trace, r.y_raw) for r in smp] == [("a", 9), ("a", 8), ("a", 7), ("b", 7), ("b", 7), ("b", 7)]


def test_versions_follow_mtime_order(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    os.makedirs(src)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    for name, mt in [("z.csv", 100), ("a.csv", 300), ("m.csv", 200)]:
        os.utime(_capture(src, name, [1, 2, 3]), (mt, mt))
    new = store.ingest(spark, st, capture.read_lines(spark, src), "p").collect()
    order = sorted((r.version, os.path.basename(r.source_uri)) for r in new)
    assert order == [(1, "z.csv"), (2, "m.csv"), (3, "a.csv")]


def test_trigger_rules(spark, tmpdir_fresh):
    from wavespark.operators.signal import trigger_index
    rows = []
    cases = {1: [0, 0, 1, 1], 2: [1, 0, 0], 3: [0, 0, 0], 4: [1, 1]}
    for v, ys in cases.items():
        rows += [("p", v, "TRIGGER", i, y) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "project string, version int, trace string, i long, y_raw long")
    got = {r.version: r.t0_index for r in trigger_index(df).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}
    exact = {r.version: r.t0_index for r in trigger_index(df, exact=True).collect()}
    assert exact[1] == 2


def test_project_catalogue(spark):
    from wavespark import schemas
    import pytest
    p = store.create_project(spark.createDataFrame([], schemas.PROJECTS), "b")
    p = store.create_project(p, "a")
    with pytest.raises(RuntimeError):
        store.create_project(p, "a")
    p = store.set_project(p, "a", implied_dt=0.25, dt_unit="US", description="x")
    with pytest.raises(ValueError):
        store.set_project(p, "a", implied_dt=0.0)
    assert [r.project for r in store.list_projects(p).collect()] == ["a", "b"]
    row = p.where("project = 'a'").first()
    assert (row.implied_dt, row.dt_unit, row.description) == (0.25, "us", "x")


def test_reference_layout_json(spark, tmpdir_fresh):
    import json
    import pytest
    d = os.path.join(tmpdir_fresh, "proj1", "data")
    os.makedirs(d)
    with open(os.path.join(tmpdir_fresh, "proj1", "project.json"), "w") as f:
        json.dump({"project_version": 1, "name": "proj1", "dir": "x", "implied_dt": 2.0,
                   "latest_traces_version": 3, "trace_source": {"type": "NullTraceSource"},
                   "description": "d"}, f, indent=2)
    with open(os.path.join(d, "config.json"), "w") as f:
        json.dump({"traces": [{"name": "a", "label": "A", "state": "Active"},
                              {"name": "b", "label": "b", "state": "weird", "y_scale": 2.5,
                               "overlay": {"filter_name": "Lowpass", "frequency": "1.0 KHz"},
                               "stat_functions": ["max"]},
                              {"name": "s", "label": "s", "derivative": True,
                               "derivative_function": "add", "derivative_sources": ["a", "b"],
                               "derivative_params": {}}]}, f, indent=2)
    with open(os.path.join(d, "views.json"), "w") as f:
        json.dump([{"spec_version": 1, "title": "T", "view_name": "v", "num_rows": 1, "num_columns": 1,
                    "sub_plots": [{"row": 0, "column": 0,
                                   "traces": [{"name": "a", "trace_version": -1, "on_axis": "left",
                                               "color": "auto"}]}]}], f, indent=2)
    prj = config.read_projects(spark, tmpdir_fresh).first()
    assert (prj.project, prj.implied_dt, prj.dt_unit, prj.latest_traces_version) == ("proj1", 2.0, "ms", 3)
    reg = config.read_registry(spark, tmpdir_fresh).orderBy("ord").collect()
    assert [(r.trace, r.label, r.state, r.y_scale) for r in reg] == [
        ("a", "A", "Active", 1.0), ("b", "b", "Inactive", 2.5), ("s", "s", "Active", 1.0)]
    assert reg[2].derivative.function == "add" and list(reg[2].derivative.sources) == ["a", "b"]
    v = config.read_views(spark, tmpdir_fresh).first()
    sp = v.sub_plots[0]
    assert (v.view_name, sp.legend_location, sp.traces[0].show_legends) == ("v", "None", False)
    assert [r.project for r in config.list_project_names(spark, tmpdir_fresh).collect()] == ["proj1"]
    # integer literal for a float setting is rejected, as in the reference
    with open(os.path.join(d, "config.json"), "w") as f:
        json.dump({"traces": [{"name": "a", "label": "a", "y_scale": 1}]}, f)
    with pytest.raises(Exception):
        config.read_registry(spark, tmpdir_fresh).collect()


def test_stream_ingest_restart_is_idempotent(spark, tmpdir_fresh):
    from wavespark.streaming.ingest import start_ingest
    landing = os.path.join(tmpdir_fresh, "landing")
    os.makedirs(landing)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    ck = os.path.join(tmpdir_fresh, "ckpt")
    _capture(landing, "c1.csv", [1, 2, 3])
    start_ingest(spark, landing, st, "s", ck).awaitTermination()
    assert st.captures(spark).count() == 1
    time.sleep(1)
    _capture(landing, "c2.csv", [4, 5, 6, 7])
    start_ingest(spark, landing, st, "s", ck).awaitTermination()
    caps = st.captures(spark).orderBy("version").collect()
    assert [(c.version, c.n_samples) for c in caps] == [(1, 3), (2, 4)]
    # a fresh checkpoint replays every file: change detection keeps it a no-op
    start_ingest(spark, landing, st, "s", os.path.join(tmpdir_fresh, "ckpt2")).awaitTermination()
    assert st.captures(spark).count() == 2
    assert st.samples(spark).where(F.col("version") == 2).count() == 8


def test_retry_after_a_crash_and_digit_names(spark, tmpdir_fresh):
    """The captures table is written last.  Without it (a crash before) the
    version is not visible, and a retry writes nothing twice; a project called
    007 keeps its name in every table."""
    src = os.path.join(tmpdir_fresh, "src")
    os.makedirs(src)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    p = _capture(src, "cap.csv", [1, 2, 3, 4], trig=[0, 0, 1, 1])
    os.utime(p, (1_000_000, 1_000_000))
    assert store.ingest_changed(spark, st, src, "007").count() == 1
    os.rename(os.path.join(st.root, "captures"), os.path.join(tmpdir_fresh, "lost"))
    assert st.samples(spark).count() == 0 and st.samples(spark, committed=False).count() == 8
    assert store.ingest_changed(spark, st, src, "007").count() == 1
    assert store.ingest_changed(spark, st, src, "007").count() == 0
    for df in (st.samples(spark), st.captures(spark), st.registry(spark), st.notes(spark)):
        assert {r.project for r in df.select("project").distinct().collect()} == {"007"}
    assert st.notes(spark).count() == 2 and st.registry(spark).count() == 2 and st.samples(spark).count() == 8


def test_legacy_versions_of_different_columns(spark, tmpdir_fresh):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq
    d = os.path.join(tmpdir_fresh, "legacy")
    for version, cols in ((1, {"a": [1, 2], "b": [3, None]}), (2, {"a": [4, 5, 6], "c": [7, 8, 9]})):
        path = os.path.join(d, "data", f"{version:05}")
        os.makedirs(path)
        pq.write_table(pa.table({k: pa.array(v, pa.int64()) for k, v in cols.items()}),
                       os.path.join(path, "traces.parquet.lz4"), compression="lz4")
        with open(os.path.join(path, "trigger.json"), "w") as f:
            json.dump({"t0_index": version}, f)
        with open(os.path.join(path, "config.json"), "w") as f:
            json.dump({"a": {"note": f"note {version}"}}, f)
    rows = store.read_legacy_project(spark, d, "007").collect()
    got = {(r.version, r.trace): [] for r in rows}
    for r in sorted(rows, key=lambda r: r.i):
        got[r.version, r.trace].append(r.y_raw)
    assert got == {(1, "a"): [1, 2], (1, "b"): [3, None], (2, "a"): [4, 5, 6], (2, "c"): [7, 8, 9]}
    assert {(r.version, r.t0_index) for r in store.read_legacy_captures(spark, d, "007").collect()} == {(1, 1), (2, 2)}
    assert {(r.version, r.trace, r.note) for r in store.read_legacy_notes(spark, d, "007").collect()} == {
        (1, "a", "note 1"), (2, "a", "note 2")}


def _two_sources(d):
    a, b = (os.path.join(d, x) for x in "ab")
    for p in (a, b):
        os.makedirs(p)
    for p, name, rows, t in ((a, "1.csv", [1, 2, 3], 100), (a, "2.csv", [4, 5], 200), (b, "3.csv", [6, 7, 8, 9], 300)):
        f = _capture(p, name, rows)
        os.utime(f, (t, t))
    return a, b


def test_two_loads_at_once_keep_both(spark, tmpdir_fresh, monkeypatch):
    """The second load runs from start to end after the first has numbered its
    versions and before it writes."""
    a, b = _two_sources(tmpdir_fresh)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    write, inner = store.write_samples, []

    def slow(df, path):
        if not inner:
            inner.append(None)
            inner[0] = store.ingest_changed(spark, st, b, "p").collect()
        write(df, path)

    monkeypatch.setattr(store, "write_samples", slow)
    outer = store.ingest_changed(spark, st, a, "p").collect()
    got = {r.version: [] for r in outer + inner[0]}
    assert sorted(got) == [1, 2, 3] and [r.version for r in inner[0]] == [3]
    for r in st.samples(spark).where("trace = 'a'").orderBy("i").collect():
        got[r.version].append(r.y_raw)
    assert got == {1: [1, 2, 3], 2: [4, 5], 3: [6, 7, 8, 9]}
    assert st.captures(spark).count() == 3
    assert [(r.trace, r.ord) for r in st.registry(spark).orderBy("ord").collect()] == [("TRIGGER", 0), ("a", 1)]
    assert store.ingest_changed(spark, st, [a, b], "p").count() == 0


def test_the_same_change_twice_at_once_is_one_version(spark, tmpdir_fresh, monkeypatch):
    a, _ = _two_sources(tmpdir_fresh)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    write, inner = store.write_samples, []

    def slow(df, path):
        if not inner:
            inner.append(None)
            inner[0] = store.ingest_changed(spark, st, a, "p").collect()
        write(df, path)

    monkeypatch.setattr(store, "write_samples", slow)
    assert [r.version for r in store.ingest_changed(spark, st, a, "p").orderBy("version").collect()] == [1, 2]
    assert inner == [[]] and st.captures(spark).count() == 2


def test_claims_of_many_threads_do_not_overlap(spark, tmpdir_fresh):
    from concurrent.futures import ThreadPoolExecutor

    from wavespark.sources import claims
    folder = os.path.join(tmpdir_fresh, "claims")
    with ThreadPoolExecutor(8) as pool:
        first = list(pool.map(lambda n: claims.claim(spark, folder, f"load {n}", f"change {n}", 0, n % 5 + 1), range(40)))
    taken = [v for n, f in enumerate(first) for v in range(f, f + n % 5 + 1)]
    assert sorted(taken) == list(range(1, len(taken) + 1))


def test_claims_are_taken_over_once(spark, tmpdir_fresh, monkeypatch):
    from wavespark.sources import claims
    folder = os.path.join(tmpdir_fresh, "claims")
    with claims.load() as mine:
        assert claims.claim(spark, folder, mine, "x", 4, 2) == 5
        assert claims.claim(spark, folder, "other", "x", 4, 2) is None    # running
        assert claims.claim(spark, folder, "other", "y", 4, 3) == 7
    with claims.load() as again:                                          # the first one died
        assert claims.claim(spark, folder, again, "x", 4, 2) == 5
        assert claims.claim(spark, folder, "third", "x", 4, 2) is None
    far = {"application": "elsewhere", "load": "l", "change": "z", "count": 1, "at": time.time()}
    import json

    from wavespark.session import create_exclusive
    assert create_exclusive(spark, f"{folder}/0000000010.0", json.dumps(far))
    assert not create_exclusive(spark, f"{folder}/0000000010.0", "no")
    assert claims.claim(spark, folder, "l2", "z", 9, 1) is None
    monkeypatch.setattr(claims, "STALE_SECONDS", -1.0)
    assert claims.claim(spark, folder, "l2", "z", 9, 1) == 10
    assert not [f for f in os.listdir(folder) if f.startswith(".")]


def test_a_capture_written_while_it_is_loaded_raises(spark, tmpdir_fresh):
    import pytest
    a, _ = _two_sources(tmpdir_fresh)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    lines = capture.read_lines(spark, a)
    moving = lines.withColumn("mtime", F.when(F.col("line_no") < 2, F.col("mtime")).otherwise(F.col("mtime") + F.expr("INTERVAL 1 SECOND")))
    heads = capture.capture_heads(lines)
    real, capture.capture_heads = capture.capture_heads, lambda _: heads
    try:
        with pytest.raises(Exception, match="written again while"):
            store.ingest(spark, st, moving, "p")
    finally:
        capture.capture_heads = real
    assert st.captures(spark).count() == 0


def test_statistics_read_no_sample(spark, tmpdir_fresh):
    from wavespark.operators import stats
    a, _ = _two_sources(tmpdir_fresh)
    st = store.Store(os.path.join(tmpdir_fresh, "store"))
    store.ingest_changed(spark, st, a, "p").collect()
    out = stats.stats_of_blocks(st.block_stats(spark), st.registry(spark))
    assert not [f for f in out.inputFiles() if "/samples/" in f] and out.inputFiles()
    assert {(r.version, r.n, r["max"]) for r in out.where("trace = 'a'").collect()} == {(1, 3, 3.0), (2, 2, 5.0)}
