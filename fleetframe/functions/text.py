"""Column-level helpers.  All are compositions of built-in Spark functions,
so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour):
# safe-mode text fragments that mean the cluster left safe mode, and the
# exact text reported when the status command itself failed.
EXIT_MARKERS = ("OFF", "exited", "out of safe mode")
FAILED_TEXT = "FAILED"
# ANSI colour escape as written by the run-log functions.
ANSI_ESCAPE_RE = "\u001b\\[[0-9;]*m"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_host(col) -> Column:
    """What ``echo "$x" | xargs`` yields for one host token: quotes removed,
    runs of blanks/newlines collapsed to one space, ends trimmed."""
    c = _c(col)
    no_quotes = F.regexp_replace(c, "[\"']", "")
    return F.trim(F.regexp_replace(no_quotes, "[ \\t\\r\\n]+", " "))


def flag(col) -> Column:
    """P5: boolean-string parse - lower-case value equals ``true``; anything
    else, including null, is false."""
    return F.coalesce(F.lower(_c(col)) == F.lit("true"), F.lit(False))


def allow_or(col, allowed: Iterable, default) -> Column:
    """Keep the value when it is in the allow-list, else the default."""
    c = _c(col)
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(default))


def default_if_empty(col, default) -> Column:
    """``${V:-d}``: the default when the value is null or empty."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(col).cast("string"), F.lit("")), d)


def classify_status(col) -> Column:
    """Safe-mode status text -> EXITED / UNKNOWN / WAITING (case-sensitive)."""
    c = _c(col)
    exited = None
    for m in EXIT_MARKERS:
        cond = c.contains(m)
        exited = cond if exited is None else (exited | cond)
    return (F.when(exited, F.lit("EXITED"))
             .when(c == F.lit(FAILED_TEXT), F.lit("UNKNOWN"))
             .otherwise(F.lit("WAITING")))


def fill_template(template, variables: Mapping[str, object]) -> Column:
    """Replace each literal ``${NAME}`` in ``template`` with a column or value."""
    out = template if isinstance(template, Column) else F.lit(template)
    for name, value in variables.items():
        v = value if isinstance(value, Column) else F.lit(str(value))
        out = F.replace(out, F.lit("${" + name + "}"), v.cast("string"))
    return out


def strip_ansi(col) -> Column:
    return F.regexp_replace(_c(col), ANSI_ESCAPE_RE, "")


def nth_field(col, sep: str, n: int) -> Column:
    """``cut -d<sep> -f<n>`` (1-based); missing field -> null."""
    return F.try_element_at(F.split(_c(col), _escape(sep)), F.lit(n))


def first_number(col) -> Column:
    """``grep -oE "[0-9]+" | head -1``; no digits -> null."""
    return F.nullif(F.regexp_extract(_c(col), "([0-9]+)", 1), F.lit(""))


def delete_chars(col, chars: str) -> Column:
    """``tr -d <chars>``."""
    return F.translate(_c(col), chars, "")


def _escape(sep: str) -> str:
    return "".join("\\" + ch if ch in ".^$|?*+()[]{}\\" else ch for ch in sep)


__all__ = ["norm_host", "flag", "allow_or", "default_if_empty", "classify_status",
           "fill_template", "strip_ansi", "nth_field", "first_number",
           "delete_chars", "EXIT_MARKERS", "FAILED_TEXT"]
