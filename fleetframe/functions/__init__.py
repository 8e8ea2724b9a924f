"""Column helpers."""

from fleetframe.functions.text import (allow_or, classify_status, default_if_empty, delete_chars,
                                       fill_template, first_number, flag, norm_host, nth_field,
                                       strip_ansi)
from fleetframe.functions.time import as_instant, as_wall_clock, epoch_micros, epoch_seconds

__all__ = ["allow_or", "classify_status", "default_if_empty", "delete_chars", "fill_template",
           "first_number", "flag", "norm_host", "nth_field", "strip_ansi", "as_instant",
           "as_wall_clock", "epoch_micros", "epoch_seconds"]
