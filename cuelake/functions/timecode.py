"""Time codes: milliseconds are canonical, the timing string is for files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIMING = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"


def parse_timing(c: Column, pad_ms: bool = False) -> Column:
    """struct<start_ms, end_ms>, null where the string is no timing. pad_ms reads ',5' as 500 ms instead of 5."""
    part = lambda k: F.regexp_extract(c, _TIMING, k)
    ms = lambda k: (F.rpad(F.substring(part(k), 1, 3), 3, "0") if pad_ms else part(k)).cast("long")
    at = lambda k: ((part(k).cast("long") * 60 + part(k + 1).cast("long")) * 60 + part(k + 2).cast("long")) * 1000 + ms(k + 3)
    return F.when(c.rlike(_TIMING), F.struct(at(1).alias("start_ms"), at(5).alias("end_ms")))


def format_ms(c: Column) -> Column:
    h, m, s = F.floor(c / 3_600_000), F.floor(c % 3_600_000 / 60_000), F.floor(c % 60_000 / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, c % 1000)


def timing(start: Column, end: Column) -> Column:
    return F.concat_ws(" --> ", format_ms(start), format_ms(end))


def timing_key(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s,.]", "")
