import os
import time

import pytest
from pyspark.sql import functions as F

from wavespark.sources import store
from wavespark.streaming import changes


def write(path, values):
    with open(path, "w") as f:
        f.write("TRIGGER,a\nRadix - UNSIGNED,UNSIGNED\n" + "".join(f"0,{v}\n" for v in values))
    return path


def decide(spark, folder, path, what):
    changes.write_decisions(spark, folder, spark.createDataFrame(
        [(path, str(time.time_ns()), what)], "file string, at string, decision string"))


def versions(spark, st):
    rows = st.samples(spark).where("trace = 'a'").orderBy("version", "i").collect()
    out = {}
    for r in rows:
        out.setdefault(r.version, []).append(r.y_raw)
    return out


def test_listing(tmpdir_fresh):
    for name in ("d1/a.txt", "d1/.a.crc", "d2/b.txt", "d2/_x/c.txt", "d2/c.csv", "e/d.txt"):
        os.makedirs(os.path.dirname(f"{tmpdir_fresh}/{name}"), exist_ok=True)
        write(f"{tmpdir_fresh}/{name}", [1])
    def names(p):
        return sorted(k.removeprefix(f"file://{tmpdir_fresh}/") for k in changes.listed(f"file://{tmpdir_fresh}{p}"))
    assert names("/d?/*.txt") == ["d1/a.txt", "d2/b.txt"]
    assert names("/d1") == ["d1/a.txt"] == names("/d1/a.txt")
    assert names("/*") == ["d1/a.txt", "d2/b.txt", "d2/c.csv", "e/d.txt"]
    assert names("/none") == [] == names("/none/*.txt")
    assert list(changes.listed(f"{tmpdir_fresh}/d1")) == [f"{tmpdir_fresh}/d1/a.txt"]
    assert all(v == os.stat(k.removeprefix("file://")).st_mtime_ns for k, v in changes.listed(f"file://{tmpdir_fresh}/*").items())


def test_rows_between_offsets():
    r = changes.ChangeReader("")
    start, end = {"files": {"a": 1, "b": 2, "gone": 3}}, {"files": {"a": 1, "b": 5, "c": 4}}
    assert [x for p in r.partitions(start, end) for x in r.read(p)] == [("b", 5), ("c", 4)]
    assert r.partitions(end, end) == [] and len(r.partitions(r.initialOffset(), end)) == 1


def test_decisions():
    def run(steps, reference=None, pending=None):
        out = []
        for seen, said in steps:
            load, reference, pending = changes.resolve(reference, pending, seen, said)
            out.append(load)
        return out, reference, pending
    y, n = changes.ACCEPT, changes.DECLINE
    assert run([([1], [y]), ([2], [n]), ([3], [y])]) == ([[1], [], [3]], 3, None)
    assert run([([1], []), ([2], []), ([], [y])]) == ([[], [], [2]], 2, None)   # the newest change waits
    assert run([([], [y]), ([1], [])]) == ([[], []], None, 1)                    # nothing to decide yet
    assert run([([1], [y]), ([2], []), ([1], []), ([], [y])]) == ([[1], [], [], []], 1, None)  # written back
    assert run([([1], [n, y])]) == ([[]], 1, None)
    with pytest.raises(ValueError):
        run([([1], ["maybe"])])


def test_the_same_path_again(spark, tmpdir_fresh):
    """Versions 1, 2 and 3 from one path, the last one after a restart from
    another checkpoint-compatible query; nothing new: no version."""
    src = f"{tmpdir_fresh}/src"
    os.makedirs(src)
    st = store.Store(f"{tmpdir_fresh}/store")
    def drain():
        changes.start_watch(spark, src, st, "p", f"{tmpdir_fresh}/ck").awaitTermination()
    for n in range(3):
        write(f"{src}/cap.csv", [n, n + 1])
        drain()
        assert versions(spark, st) == {k + 1: [k, k + 1] for k in range(n + 1)}
    drain()
    assert len(versions(spark, st)) == 3
    # a lost checkpoint lists everything again; the recorded change ids keep that a no-op
    changes.start_watch(spark, src, st, "p", f"{tmpdir_fresh}/ck2").awaitTermination()
    assert len(versions(spark, st)) == 3


def test_accept_decline_accept(spark, tmpdir_fresh):
    src, said = f"{tmpdir_fresh}/src", f"{tmpdir_fresh}/said"
    os.makedirs(src)
    os.makedirs(said)
    st = store.Store(f"{tmpdir_fresh}/store")
    def drain():
        changes.start_watch(spark, src, st, "p", f"{tmpdir_fresh}/ck", decisions=said).awaitTermination()
    path = write(f"{src}/cap.csv", [1])
    drain()
    assert versions(spark, st) == {}                       # waits
    decide(spark, said, path, "accept")
    drain()
    assert versions(spark, st) == {1: [1]}
    write(path, [2])
    decide(spark, said, f"file:{path}", "decline")         # change and decision in one batch
    drain()
    decide(spark, said, path, "accept")                    # declined already: nothing waits
    drain()
    assert versions(spark, st) == {1: [1]}
    write(path, [3])
    drain()
    decide(spark, said, f"file://{path}", "accept")
    drain()
    assert versions(spark, st) == {1: [1], 2: [3]}


def test_polling_sees_a_path_written_while_it_runs(spark, tmpdir_fresh):
    src = f"{tmpdir_fresh}/src"
    os.makedirs(src)
    st = store.Store(f"{tmpdir_fresh}/store")
    path = write(f"{src}/cap.csv", [1])
    q = changes.start_watch(spark, src, st, "p", f"{tmpdir_fresh}/ck", available_now=False)
    try:
        for n in (1, 2):
            end = time.time() + 90
            while len(versions(spark, st)) < n and time.time() < end:
                time.sleep(0.5)
            assert versions(spark, st)[n] == [n]
            write(path, [n + 1])
    finally:
        q.stop()
    assert st.captures(spark).where(F.col("version") <= 2).count() == 2
