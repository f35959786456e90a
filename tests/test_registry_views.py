import pytest
from pyspark.sql import functions as F

from wavespark import schemas
from wavespark.operators import registry as R
from wavespark.operators import views as V


def _reg(spark):
    rows = [("p", "a", "A", "Active", 1.0, 0.0, None, ["min"], None, 0),
            ("p", "b", "B", "Inactive", 2.0, 0.0, None, [], None, 1),
            ("p", "c", "C", "Active", 2.0, 1.0, None, ["max", "min"], None, 2)]
    return spark.createDataFrame(rows, schemas.REGISTRY)


def test_queries_and_updates(spark):
    reg = _reg(spark)
    assert [r.trace for r in R.by_state(reg, "Active").orderBy("ord").collect()] == ["a", "c"]
    assert [r.trace for r in R.first_match(reg, "B", by="label").collect()] == ["b"]
    assert [r.trace for r in R.label_search(reg, "  c ").collect()] == ["c"]
    cons = R.consensus(reg.where("trace in ('b','c')")).first()
    assert (cons.y_scale, cons.y_offset) == (2.0, 0.0)
    with pytest.raises(RuntimeError):
        R.rename_label(reg, "p", "a", "B")
    with pytest.raises(RuntimeError):
        R.rename_label(reg, "p", "a", "c")  # a name counts as taken too
    assert R.rename_label(reg, "p", "a", "A") is reg
    r2 = R.add_stat_function(reg, "p", ["c"], "max")
    assert list(r2.where("trace = 'c'").first().stat_functions) == ["min", "max"]
    labels = {}
    for r in R.state_labels(reg).orderBy("ord").collect():
        labels.setdefault(r.state, []).append(r.label)
    summ = {r.state: (r.n, labels[r.state]) for r in R.state_summary(reg).collect()}
    assert summ == {"Active": (2, ["A", "C"]), "Inactive": (1, ["B"])}


def test_label_check(spark):
    reg = _reg(spark)
    cand = spark.createDataFrame([("p", "a", "ok label"), ("p", "a", "  "), ("p", "a", "bad/label"),
                                  ("p", "a", "C"), ("p", "a", "A")], "project string, trace string, new_label string")
    got = {r.new_label: r.reason for r in R.label_check(cand, reg).collect()}
    assert got == {"ok label": None, "  ": "empty", "bad/label": "invalid characters",
                   "C": "already used", "A": None}


def test_derivative_maintenance(spark):
    reg = _reg(spark)
    r2 = R.add_derivative(reg, "p", "s", "add", ["A", "b"])  # label resolved to name
    d = r2.where("trace = 's'").first()
    assert list(d.derivative.sources) == ["a", "b"] and d.ord == 3
    with pytest.raises(RuntimeError):
        R.add_derivative(r2, "p", "C", "add", ["a"])
    with pytest.raises(ValueError):
        R.add_derivative(reg, "p", "z", "divide", ["a"])
    with pytest.raises(ValueError):
        R.add_derivative(reg, "p", "z", "nonsense", ["a"])
    r3 = R.add_derivative(r2, "p", "t", "multiply", ["s", "c"])
    with pytest.raises(ValueError):
        R.update_derivative(r3, "p", "s", "add", ["t"])  # cycle
    with pytest.raises(ValueError):
        R.delete_derivative(r3, "p", "s")  # t depends on s
    r4 = R.delete_derivative(r3, "p", "t")
    assert r4.where("trace = 't'").count() == 0
    assert R.delete_derivative(r4, "p", "a").where("trace = 'a'").count() == 1  # raw kept


def test_cycle_check_collects_reachable_entries_only(spark, monkeypatch):
    reg = R.add_derivative(_reg(spark), "p", "s", "add", ["a", "c"])
    reg = R.add_derivative(reg, "p", "t", "multiply", ["s", "c"])
    reg = R.add_derivative(reg, "p", "u", "multiply", ["t", "c"])
    got, collect = [], type(reg).collect
    monkeypatch.setattr(type(reg), "collect", lambda self: got.append(collect(self)) or got[-1])
    assert not R._dependency_cycle(reg, "p", "u", ["s", "c"])
    assert sum(map(len, got)) == 1  # s; neither raw traces nor t and u
    assert R._dependency_cycle(reg, "p", "s", ["u"])


def test_view_maintenance(spark):
    v = spark.createDataFrame([], schemas.VIEWS)
    with pytest.raises(ValueError):
        V.create_view(v, "p", " ", 1, 1, "t")
    with pytest.raises(ValueError):
        V.create_view(v, "p", "v", 0, 1, "t")
    v = V.create_view(v, "p", "v", 2, 3, "Title")
    cells = [(s.row, s.column) for s in v.first().sub_plots]
    assert cells == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    with pytest.raises(RuntimeError):
        V.create_view(v, "p", "v", 1, 1, "x")
    v = V.add_spec(v, "p", "v", 1, 2, "a", -1)
    with pytest.raises(ValueError):
        V.add_spec(v, "p", "v", 1, 2, "a", -1)
    with pytest.raises(ValueError):
        V.add_spec(v, "p", "v", 2, 0, "a", -1)
    v = V.add_spec(v, "p", "v", 1, 2, "a", 1, on_axis="right")
    v = V.edit_spec(v, "p", "v", 1, 2, "a", 1, show_legends=True)
    v = V.remove_spec(v, "p", "v", 1, 2, "a", -1)
    sp = V.specs(v).collect()
    assert [(s.name, s.trace_version, s.on_axis, s.show_legends) for s in sp] == [("a", 1, "right", True)]
    v = V.rename_view(v, "p", "v", "w")
    assert V.get_view(v, "p", "w").count() == 1
    assert V.delete_view(v, "p", "w").count() == 0
    adhoc = V.adhoc_view(spark, "p", ["a", "c"])
    assert [s.name for s in V.specs(adhoc).orderBy("spec_pos").collect()] == ["a", "c"]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40
