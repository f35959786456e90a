import os

import pytest
from pyspark.sql import functions as F

from wavespark.sources import capture


def _write(d, name, text, newline="\n"):
    p = os.path.join(d, name)
    with open(p, "w", newline="") as f:
        f.write(text.replace("\n", newline))
    return p


def _decode(spark, path):
    return capture.decode_captures(capture.read_lines(spark, path))


def _wide(pdf):
    return {t: list(g.sort_values("i")["y_raw"]) for t, g in pdf.groupby("trace")}


BASIC = """Sample in Buffer,Sample in Window,TRIGGER,aCore/Gen/foo[15:0],aCore/Gen/xyz[15:0]
Radix - UNSIGNED,UNSIGNED,UNSIGNED,SIGNED,HEX
0,0,0,83,39417
1,1,0,96,394A7
2,2,0,102,39410
"""


def test_basic_hex(spark, tmpdir_fresh):
    w = _wide(_decode(spark, _write(tmpdir_fresh, "a.csv", BASIC)).toPandas())
    assert w["aCore/Gen/xyz[15:0]"] == [234519, 234663, 234512]
    assert w["aCore/Gen/foo[15:0]"] == [83, 96, 102]
    assert w["Sample in Buffer"] == [0, 1, 2]


def test_docs_raw_form_signed_hex_value_raises(spark, tmpdir_fresh):
    text = BASIC.replace("SIGNED,HEX", "SIGNED,SIGNED").replace("394A7", "394A4")
    with pytest.raises(Exception):
        _decode(spark, _write(tmpdir_fresh, "a.csv", text)).collect()


def test_no_radix_row_keeps_first_data_row(spark, tmpdir_fresh):
    text = "a,b\n5,6\n7,8\n"
    w = _wide(_decode(spark, _write(tmpdir_fresh, "a.csv", text)).toPandas())
    assert w == {"a": [5, 7], "b": [6, 8]}


def test_radix_words_case_and_unknown(spark, tmpdir_fresh):
    text = "h,o,b,s,u,x\nRadix - hex,Octal,BIN,signed,UNSIGNED,WHATEVER\n1F,17,101,-5,12,99\n"
    w = _wide(_decode(spark, _write(tmpdir_fresh, "a.csv", text)).toPandas())
    assert w == {"h": [31], "o": [15], "b": [5], "s": [-5], "u": [12], "x": [99]}


def test_negative_hex(spark, tmpdir_fresh):
    text = "h\nRadix - HEX\n-1F\n"
    assert _wide(_decode(spark, _write(tmpdir_fresh, "a.csv", text)).toPandas()) == {"h": [-31]}


@pytest.mark.parametrize("cell,radix", [("FFFFFFFFFFFFFFFF", "HEX"), ("12G4", "HEX"),
                                        ("1.5", "SIGNED"), ("394A4", "UNSIGNED")])
def test_bad_values_raise(spark, tmpdir_fresh, cell, radix):
    text = f"h\nRadix - {radix}\n{cell}\n"
    with pytest.raises(Exception):
        _decode(spark, _write(tmpdir_fresh, "a.csv", text)).collect()


def test_blank_lines_and_crlf(spark, tmpdir_fresh):
    text = "a,b\n\nRadix - HEX,BIN\n\n1,1\n\n2,10\n3,11\n\n"
    w = _wide(_decode(spark, _write(tmpdir_fresh, "a.csv", text, newline="\r\n")).toPandas())
    assert w == {"a": [1, 2, 3], "b": [1, 2, 3]}


def test_quoted_header_with_comma_and_empty_cell(spark, tmpdir_fresh):
    text = '"foo,x[15:0]",b,c\n1,,3\n'
    pdf = _decode(spark, _write(tmpdir_fresh, "a.csv", text)).toPandas()
    assert set(pdf["trace"]) == {"foo,x[15:0]", "b", "c"}
    assert pdf[pdf.trace == "b"]["y_raw"].isna().all()


def test_radix_count_mismatch_and_header_only_raise(spark, tmpdir_fresh):
    with pytest.raises(Exception):
        _decode(spark, _write(tmpdir_fresh, "a.csv", "a,b\nRadix - HEX\n1,2\n")).collect()
    d2 = os.path.join(tmpdir_fresh, "h")
    os.makedirs(d2)
    with pytest.raises(Exception):
        _decode(spark, _write(d2, "b.csv", "a,b\n")).collect()


def test_large_file_split_numbering(spark, tmpdir_fresh):
    n = 300_000
    p = os.path.join(tmpdir_fresh, "big.csv")
    with open(p, "w") as f:
        f.write("k,v\nRadix - UNSIGNED,HEX\n")
        for k in range(n):
            if k % 50_000 == 7:
                f.write("\n")
            f.write(f"{k},{k:X}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(512 * 1024))
    try:
        lines = spark.read.text(p)
        assert lines.rdd.getNumPartitions() >= 4
        df = _decode(spark, p).where(F.col("trace") == "v")
        bad = df.where(F.col("i") != F.col("y_raw")).count()
        assert df.count() == n and bad == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_source_config_rules():
    assert capture.source_from_config({"type": "NullTraceSource"}) == {"type": "NullTraceSource"}
    with pytest.raises(RuntimeError):
        capture.source_from_config({"type": "Other"})
    cur = capture.check_source_change({"type": "NullTraceSource"}, "/a.csv", 0)
    assert cur["path"] == "/a.csv"
    assert capture.check_source_change(cur, "/a.csv", 3) == cur
    with pytest.raises(RuntimeError):
        capture.check_source_change(cur, "/b.csv", 3)


def test_null_source_load_raises(spark):
    with pytest.raises(RuntimeError):
        capture.load_source(spark, {"type": "NullTraceSource"})
