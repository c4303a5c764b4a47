"""Column expressions shared by the operators."""

from changelake.functions.scalars import (
    empty_list,
    escape_text,
    escaped_marks_to_letters,
    has_prefix,
    join_list,
    narrow,
    null_if,
    op_label,
    percent,
    split_list,
    start_of_minute,
    time_in_range,
    truncated_close,
    unescape_text,
    version_time,
    yyyymm,
)

__all__ = [
    "empty_list",
    "escape_text",
    "escaped_marks_to_letters",
    "has_prefix",
    "join_list",
    "narrow",
    "null_if",
    "op_label",
    "percent",
    "split_list",
    "start_of_minute",
    "time_in_range",
    "truncated_close",
    "unescape_text",
    "version_time",
    "yyyymm",
]
