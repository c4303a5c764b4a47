"""Scalar column helpers. All of them compile to built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Change operations and their labels.
OP_LABELS = {"c": "Create", "u": "Update", "r": "Read (snapshot)", "d": "Delete"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_list() -> Column:
    return F.array().cast("array<string>")


def split_list(text: str | Column, empty: str = "one_blank") -> Column:
    """Comma-joined text to a list. Blank text gives ``['']`` or, with ``empty="empty"``, ``[]``."""
    text = _col(text)
    parts = F.split(text, ",", -1)
    if empty == "one_blank":
        return parts
    if empty == "empty":
        return F.when(text == "", empty_list()).otherwise(parts)
    raise ValueError(f"unknown empty-list policy {empty!r}")


def join_list(items: str | Column) -> Column:
    return F.array_join(_col(items), ",")


def narrow(value: str | Column, modulus: int | None, stored: T.DataType, overflow: str = "wrap") -> Column:
    """Fit a 64-bit number into an unsigned type of ``modulus`` values.

    ``wrap`` keeps the low bits, ``null`` drops what does not fit, ``fail`` raises.
    """
    value = _col(value)
    if modulus is None:
        return value.cast(stored) if overflow == "fail" else value.try_cast(stored)
    fits = (value >= 0) & (value < modulus)
    if overflow == "wrap":
        return F.pmod(value, F.lit(modulus)).cast(stored)
    if overflow == "null":
        return F.when(fits, value).cast(stored)
    if overflow == "fail":
        message = F.concat(F.lit("value out of range: "), value.cast("string"))
        return F.when(fits | value.isNull(), value).otherwise(F.raise_error(message).cast("bigint")).cast(stored)
    raise ValueError(f"unknown overflow policy {overflow!r}")


#: Milliseconds since 1970 of the first and the last moment of the years 1 to 9999.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def time_in_range(ts_ms: str | Column) -> Column:
    """Whether a commit time is missing or lies in the years 1 to 9999."""
    ts_ms = _col(ts_ms)
    return ts_ms.isNull() | ts_ms.between(FIRST_MS, LAST_MS)


def version_time(ts_ms: str | Column, precision: str = "s") -> Column:
    """Commit time in epoch milliseconds to a timestamp, cut to seconds unless ``precision="ms"``. A time out of range counts as missing."""
    ms = F.coalesce(F.when(time_in_range(ts_ms), _col(ts_ms)), F.lit(0)).cast("bigint")
    if precision == "ms":
        return F.timestamp_millis(ms)
    if precision == "s":
        return F.timestamp_seconds(_div(ms, 1000))
    raise ValueError(f"unknown version precision {precision!r}")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def yyyymm(ts: str | Column) -> Column:
    ts = _col(ts)
    return F.year(ts) * 100 + F.month(ts)


def start_of_minute(ts: str | Column) -> Column:
    return F.date_trunc("minute", _col(ts))


def null_if(text: str | Column, marker: str = "\\N") -> Column:
    return F.nullif(_col(text), F.lit(marker))


def has_prefix(text: str | Column, prefix: str, ignore_case: bool = False) -> Column:
    """Prefix match, by bytes or or without regard to case, as the source's collation compares."""
    text = _col(text)
    if not ignore_case:
        return text.startswith(prefix)
    return F.startswith(F.collate(text, "UNICODE_CI"), F.collate(F.lit(prefix), "UNICODE_CI"))


def op_label(op: str | Column) -> Column:
    op = _col(op)
    out = None
    for code, label in OP_LABELS.items():
        out = F.when(op == code, label) if out is None else out.when(op == code, label)
    return out


def percent(part: str | Column, total: str | Column) -> Column:
    """Whole percent, null when the total is zero."""
    part, total = _col(part), _col(total)
    return F.call_function("div", part * 100, F.nullif(total, F.lit(0).cast("bigint")))


def truncated_close(a: str | Column, b: str | Column) -> Column:
    """Equal to about 0.01: hundredths, cut to whole numbers, differ by less than 2. Nulls match nulls, and NaN matches NaN."""
    a, b = _col(a), _col(b)
    cells = [c.cast("double") for c in (a, b)]
    hundredths = [c * 100 - (c * 100) % 1 for c in cells]
    close = (cells[0] == cells[1]) | (F.abs(hundredths[0] - hundredths[1]) < 2)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


# Letters after a backslash in a text export.
ESCAPES = {"0": "\u0000", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\u001a"}


def unescape_text(text: str | Column) -> Column:
    """Undo backslash escapes of a text export.

    Doubled backslashes are cut out first, so what is left of each piece holds only
    single ones and the replacements cannot meet an escaped backslash.
    """

    def piece(part: Column) -> Column:
        for code, char in ESCAPES.items():
            part = F.regexp_replace(part, r"\\" + code, char)
        return F.regexp_replace(part, r"(?s)\\(.)", "$1")

    return F.array_join(F.transform(F.split(_col(text), r"\\\\", -1), piece), "\\")


def escape_text(text: str | Column, marks: bool = False) -> Column:
    """Backslash escapes of a text export; ``unescape_text`` undoes them.

    With ``marks`` a tab or line feed stays as it is behind a backslash, as database exports write it, instead of becoming a letter.
    """
    text = F.replace(_col(text), F.lit("\\"), F.lit("\\\\"))
    for code, char in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit("\\" + (char if marks and char in "\t\n" else code)))
    return text


def escaped_marks_to_letters(text: str | Column) -> Column:
    """Escaped tabs and line feeds as letters, after which a tab ends a cell and a line feed a record."""

    def piece(part: Column) -> Column:
        for code in "tn":
            part = F.replace(part, F.lit("\\" + ESCAPES[code]), F.lit("\\" + code))
        return part

    return F.array_join(F.transform(F.split(_col(text), r"\\\\", -1), piece), "\\\\")
