"""Radix handling of capture files (S2, S3) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radix words of the capture format and their bases; any other
# word (SIGNED, UNSIGNED, unknown) means base 10.
RADIX_BASE = {"HEX": 16, "OCTAL": 8, "BIN": 2}
RADIX_MARK = "Radix"
RADIX_PREFIX = "Radix - "

_DIGITS = {16: "[0-9a-fA-F]", 8: "[0-7]", 2: "[01]", 10: "[0-9]"}


def base_of(radix: Column) -> Column:
    """Base for an (upper-cased, trimmed) radix word."""
    out = F.lit(10)
    for word, base in RADIX_BASE.items():
        out = F.when(radix == word, F.lit(base)).otherwise(out)
    return out


def decode(cell: Column, base: Column, what: Column | None = None) -> Column:
    """Text cell in ``base`` -> BIGINT.

    Empty cell -> null.  Anything but an optional sign and digits of the base
    raises (``conv`` alone would read '12G4' as 0x12); values outside the
    64-bit range raise.  No two's-complement sign extension by bus width.
    Base 10 is a plain cast; other bases go through ``conv`` on the unsigned
    digits.
    """
    what = what if what is not None else cell
    err = F.raise_error(F.concat(F.lit("invalid integer ["), F.coalesce(what, F.lit("null")),
                                 F.lit("] for base "), base.cast("string")))
    # base 10: the cast itself validates (sign + digits, 64-bit range); it
    # trims blanks and accepts a trailing "L"-free integer only, so blanks and
    # '.' are rejected explicitly.
    dec_ok = (F.length(F.trim(cell)) == F.length(cell)) & (F.instr(cell, ".") == 0)
    ok = F.lit(False)
    for b, d in _DIGITS.items():
        if b != 10:
            ok = F.when(base == b, cell.rlike(f"^[+-]?{d}+$")).otherwise(ok)
    # each part stands once in the expression: it runs for every cell, and a
    # larger one would be too long for the JIT compiler
    signed = cell.startswith("-") | cell.startswith("+")
    digits = F.when(signed, cell.substr(F.lit(2), F.length(cell))).otherwise(cell)
    other = F.concat(F.when(cell.startswith("-"), F.lit("-")).otherwise(F.lit("")), _conv(digits, base))
    decimal = F.when(base == 10, F.when(dec_ok, cell)).otherwise(F.when(ok, other))
    return (F.when(cell.isNull() | (cell == ""), F.lit(None).cast("bigint"))
            .otherwise(F.coalesce(decimal.try_cast("bigint"), err)))


def _conv(digits: Column, base: Column) -> Column:
    # F.conv needs literal bases: one branch per non-decimal base.
    out = F.lit(None).cast("string")
    for b in (16, 8, 2):
        out = F.when(base == b, F.conv(digits, b, 10)).otherwise(out)
    return out


def split_csv_line(line: Column) -> Column:
    """Quote-aware split of one CSV line; quotes are removed and doubled
    quotes unescaped.  Lines without quotes take the plain split (no
    per-cell lambda)."""
    plain = F.split(line, ",", -1)
    quoted = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    unquoted = F.transform(quoted, lambda c: F.when(
        c.startswith('"') & c.endswith('"') & (F.length(c) >= 2),
        F.regexp_replace(c.substr(F.lit(2), F.length(c) - 2), '""', '"'))
        .otherwise(c))
    return F.when(F.instr(line, '"') == 0, plain).otherwise(unquoted)


def radix_words(line1: Column) -> Column:
    """Radix row -> upper-cased, trimmed words (``Radix - `` removed)."""
    return F.transform(F.split(F.replace(line1, F.lit(RADIX_PREFIX), F.lit("")), ",", -1),
                       lambda r: F.upper(F.trim(r)))


def is_radix_row(line1: Column) -> Column:
    return F.instr(line1, RADIX_MARK) > 0
