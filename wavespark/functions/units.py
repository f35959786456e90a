"""Frequency and duration quantities as Column expressions.

A quantity is ``struct<value double, unit string>``.  Everything here builds
JVM-side expressions (whole-stage codegen), usable in any select/where.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, seconds per period / per unit, and the matching
# pairs between frequency and time units.
FREQUENCY_UNITS = ["THz", "GHz", "MHz", "KHz", "Hz"]
FREQUENCY_PERIOD_S = {"Hz": 1.0, "KHz": 0.001, "MHz": 1e-6, "GHz": 1e-9, "THz": 1e-12}
TIME_UNITS = ["s", "ms", "us", "ns", "ps"]
TIME_SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "ps": 1e-12}
FREQ_TO_TIME = {"Hz": "s", "KHz": "ms", "MHz": "us", "GHz": "ns", "THz": "ps"}
TIME_TO_FREQ = {v: k for k, v in FREQ_TO_TIME.items()}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _canon(units: list[str]) -> Column:
    return _map({u.lower(): u for u in units})


def quantity(value, unit) -> Column:
    return F.struct(_col(value).cast("double").alias("value"), _col(unit).alias("unit"))


def _number(text: Column, what: Column) -> Column:
    v = text.try_cast("double")
    return F.when(v.isNotNull(), v).otherwise(
        F.raise_error(F.concat(F.lit("not a number with a unit: ["), what, F.lit("]"))))


def _parse(c, units: list[str], suffix_order: list[str]) -> Column:
    src = _col(c)
    clean = F.lower(F.trim(src))
    pat = "^(.*?)(" + "|".join(suffix_order) + ")$"
    suffix = F.regexp_extract(clean, pat, 2)
    number = F.regexp_replace(clean, suffix, "")  # removes every occurrence, as the reference
    unit = _canon(units)[suffix]
    return F.when(suffix == F.lit(""), F.raise_error(F.concat(F.lit("not a number with a unit: ["),
                                                              F.coalesce(src, F.lit("null")),
                                                              F.lit("]")))) \
        .otherwise(quantity(_number(F.trim(number), src), unit))


def parse_frequency(c) -> Column:
    """U1: "1.5 MHz" -> {1.5, MHz}; trimmed, case-insensitive; else raises."""
    # thz/ghz/mhz/khz are tried before hz
    q = _parse(c, FREQUENCY_UNITS, ["thz", "ghz", "mhz", "khz", "hz"])
    return q


def parse_duration(c) -> Column:
    """U2: "10 us" -> {10.0, us}; ps/ns/us/ms are tried before s."""
    return _parse(c, TIME_UNITS, ["ps", "ns", "us", "ms", "s"])


def frequency_unit(c) -> Column:
    """Unit name (trimmed, case-insensitive) -> canonical name; raises."""
    u = _canon(FREQUENCY_UNITS)[F.lower(F.trim(_col(c)))]
    return F.coalesce(u, F.raise_error(F.concat(F.lit("no frequency unit: "), _col(c))))


def time_unit(c) -> Column:
    u = _canon(TIME_UNITS)[F.lower(F.trim(_col(c)))]
    return F.coalesce(u, F.raise_error(F.concat(F.lit("no time unit: "), _col(c))))


def frequency_as(q, unit: str | Column | None = None) -> Column:
    """U4: value in ``unit``: v * period(target) / period(own)."""
    q = _col(q)
    if unit is None:
        return q["value"]
    target = F.lit(unit) if isinstance(unit, str) else unit
    per = _map(FREQUENCY_PERIOD_S)
    return q["value"] * per[frequency_unit(target)] / per[q["unit"]]


def duration_as(q, unit: str | Column | None = None) -> Column:
    """U4: value in ``unit``: v * seconds(own) / seconds(target)."""
    q = _col(q)
    if unit is None:
        return q["value"]
    target = F.lit(unit) if isinstance(unit, str) else unit
    sec = _map(TIME_SECONDS)
    return q["value"] * sec[q["unit"]] / sec[time_unit(target)]


def frequency_in(q, unit: str) -> Column:
    return quantity(frequency_as(q, unit), frequency_unit(F.lit(unit)))


def duration_in(q, unit: str) -> Column:
    return quantity(duration_as(q, unit), time_unit(F.lit(unit)))


def matching_time_unit(unit) -> Column:
    """Hz->s, KHz->ms, MHz->us, GHz->ns, THz->ps."""
    return _map(FREQ_TO_TIME)[_col(unit)]


def matching_frequency_unit(unit) -> Column:
    return _map(TIME_TO_FREQ)[_col(unit)]


def period_of(freq) -> Column:
    """``n / Frequency`` -- the numerator is ignored: 1/value in the
    matching time unit."""
    q = _col(freq)
    return quantity(F.lit(1.0) / q["value"], matching_time_unit(q["unit"]))


def rate_of(duration) -> Column:
    """``n / Duration`` -> 1/value in the matching frequency unit."""
    q = _col(duration)
    return quantity(F.lit(1.0) / q["value"], matching_frequency_unit(q["unit"]))


def add(a, b, kind: str = "frequency") -> Column:
    """A + b in a's unit."""
    a = _col(a)
    conv = frequency_as if kind == "frequency" else duration_as
    return quantity(a["value"] + conv(b, a["unit"]), a["unit"])


def sub(a, b, kind: str = "frequency") -> Column:
    a = _col(a)
    conv = frequency_as if kind == "frequency" else duration_as
    return quantity(a["value"] - conv(b, a["unit"]), a["unit"])


def scale(a, k) -> Column:
    """A * k (either side)."""
    a = _col(a)
    return quantity(a["value"] * _col(k) if not isinstance(k, (int, float)) else a["value"] * F.lit(float(k)),
                    a["unit"])


def divide(a, k) -> Column:
    a = _col(a)
    kk = F.lit(float(k)) if isinstance(k, (int, float)) else _col(k)
    return quantity(a["value"] / kk, a["unit"])


def lt(a, b, kind: str = "frequency") -> Column:
    """U8: compare after converting b to a's unit."""
    a = _col(a)
    conv = frequency_as if kind == "frequency" else duration_as
    return a["value"] < conv(b, a["unit"])


def eq(a, b, kind: str = "frequency") -> Column:
    a, bq = _col(a), _col(b)
    conv = frequency_as if kind == "frequency" else duration_as
    return F.when(a["unit"] == bq["unit"], a["value"] == bq["value"]) \
        .otherwise(a["value"] == conv(bq, a["unit"]))


def le(a, b, kind: str = "frequency") -> Column:
    return eq(a, b, kind) | lt(a, b, kind)


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _two_digits(exp: Column) -> Column:
    """|exp| with at least two digits (lpad would truncate 300 to 30)."""
    a = F.abs(exp).cast("string")
    return F.when(F.abs(exp) < 10, F.concat(F.lit("0"), a)).otherwise(a)


def _notation(p: Column) -> Column:
    """Text of a value from ``sign``, ``digits`` (all significant ones), their
    number ``nd`` and the decimal exponent ``exp`` of the first."""
    sign, digits, nd, exp = p["sign"], p["digits"], p["nd"], p["exp"]
    pos_big = F.when(nd <= exp + 1, F.concat(digits, F.repeat(F.lit("0"), exp + 1 - nd), F.lit(".0"))) \
        .otherwise(F.concat(digits.substr(F.lit(1), exp + 1), F.lit("."), digits.substr(exp + 2, F.lit(400))))
    pos_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    mant = F.when(nd == 1, digits).otherwise(F.concat(digits.substr(F.lit(1), F.lit(1)), F.lit("."), digits.substr(F.lit(2), nd)))
    sci = F.concat(mant, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), _two_digits(exp))
    return F.concat(sign, F.when((exp >= 0) & (exp < 16), pos_big).when((exp < 0) & (exp >= -4), pos_small).otherwise(sci))


def py_repr(value) -> Column:
    """Text of a DOUBLE as Python prints it (repr): positional for
    1e-4 <= |v| < 1e16 ("12345000.0", "0.00012"), otherwise "1.5e-05" /
    "1e+16".  Built from Spark's own shortest digits (its double-to-string
    cast), so only the notation is rewritten; from 1e-3 to 1e7 that cast has
    Python's notation already."""
    v = _col(value)
    pat = r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$"

    def parts(s: Column) -> Column:
        sign, ip, fp = (F.regexp_extract(s, pat, k) for k in (1, 2, 3))
        e10 = F.coalesce(F.nullif(F.regexp_extract(s, pat, 4), F.lit("")), F.lit("0")).cast("int")
        return F.struct(sign.alias("sign"), F.concat(ip, fp).alias("raw"), (F.length(ip) - 1 + e10).alias("exp"))

    def stripped(p: Column) -> Column:
        tail = F.regexp_replace(p["raw"], "^0+", "")
        digits = F.coalesce(F.nullif(F.regexp_replace(tail, "0+$", ""), F.lit("")), F.lit("0"))
        return F.struct(p["sign"].alias("sign"), digits.alias("digits"),
                        (p["exp"] - F.length(p["raw"]) + F.length(tail)).alias("exp"))

    def counted(p: Column) -> Column:
        return F.struct(p["sign"].alias("sign"), p["digits"].alias("digits"), F.length(p["digits"]).alias("nd"), p["exp"].alias("exp"))

    rewritten = _let(_let(_let(_let(v.cast("string"), parts), stripped), counted), _notation)
    size = F.abs(v)
    return (F.when((size >= 1e-3) & (size < 1e7), v.cast("string"))
            .when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf"))
            .when(v == float("-inf"), F.lit("-inf"))
            .when(v == 0, F.when(v.cast("string").startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
            .otherwise(rewritten))


def format_quantity(q) -> Column:
    """U9: "value unit", the value printed as Python prints a float."""
    q = _col(q)
    return F.concat_ws(" ", py_repr(q["value"]), q["unit"])


def dt_from_rate(rate) -> Column:
    """Time step from a sampling frequency (> 0, else raises)."""
    q = _col(rate)
    return F.when(q["value"] > 0, period_of(q)).otherwise(
        F.raise_error(F.lit("sampling frequency must be positive")))


def rate_from_dt(dt_value, dt_unit) -> Column:
    """Sampling frequency of a project step."""
    return rate_of(quantity(dt_value, dt_unit))


def normalized_cutoff(cutoff_hz, implied_dt, dt_unit) -> Column:
    """Wn = fc / (fs / 2), fs = 1/dt in Hz; must lie in (0, 1)."""
    fs = frequency_as(rate_from_dt(implied_dt, dt_unit), "Hz")
    w = _col(cutoff_hz) / (fs / F.lit(2.0))
    return F.when((w > 0) & (w < 1), w).otherwise(
        F.raise_error(F.lit("the cutoff lies outside (0, fs / 2)")))


# Driver-side (scalar) counterparts for plan parameters -------------------------

def parse_frequency_value(text: str) -> tuple[float, str]:
    s = text.strip().lower()
    for suf in ["thz", "ghz", "mhz", "khz", "hz"]:
        if s.endswith(suf):
            return float(s.replace(suf, "")), {u.lower(): u for u in FREQUENCY_UNITS}[suf]
    raise RuntimeError(f"{text!r} is not a number with a frequency unit")


def frequency_hz(text: str) -> float:
    v, u = parse_frequency_value(text)
    return v * FREQUENCY_PERIOD_S["Hz"] / FREQUENCY_PERIOD_S[u]


def sampling_rate_hz(implied_dt: float, dt_unit: str) -> float:
    """fs in Hz of a step ``implied_dt`` ``dt_unit`` (1/dt in the matching unit)."""
    unit = {u.lower(): u for u in TIME_UNITS}[dt_unit.strip().lower()]
    f_unit = TIME_TO_FREQ[unit]
    return (1 / implied_dt) * FREQUENCY_PERIOD_S["Hz"] / FREQUENCY_PERIOD_S[f_unit]
