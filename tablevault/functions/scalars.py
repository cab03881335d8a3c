"""Scalar expressions of the catalog and log views. All are built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Accepted spellings of database types and their canonical names.
DB_TYPES = {
    "postgresql": "postgresql",
    "postgres": "postgresql",
    "mysql": "mysql",
    "mariadb": "mysql",
    "mongodb": "mongodb",
    "sqlite": "sqlite",
}
# Severity order of log levels, most severe first.
LEVELS = {"error": 0, "warn": 1, "info": 2, "debug": 3}
# Size units, each 1024 times the one before.
SIZE_UNITS = ["", "k", "m", "g", "t", "p"]
# Fixed value: a JSON password member, escapes inside the secret allowed.
PASSWORD_MEMBER = r'("password"\s*:\s*)"(\\.|[^"\\])*"'


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def redact_secrets(text: str) -> str:
    """Driver-side text without passwords: JSON members, ``key=value`` forms and URLs with credentials."""
    text = re.sub(r'("(?:password|passwd|pwd)"\s*:\s*)"(?:\\.|[^"\\])*"', r'\1"***"', text, flags=re.I)
    text = re.sub(r"\b((?:password|passwd|pwd)\s*=\s*)(?:'[^']*'|\"[^\"]*\"|[^\s&;,'\"]+)", r"\1***", text, flags=re.I)
    return re.sub(r"(\w[\w+.:-]*://[^\s/:@]*):[^\s/@]+@", r"\1:***@", text)


def iso_stamp(ts: str | Column) -> Column:
    """ISO-8601 UTC time with ``:`` and ``.`` replaced, fit for a file name, in a session of any zone."""
    t = _c(ts)
    utc = F.when(F.typeof(t) == "timestamp", F.to_utc_timestamp(t.cast("timestamp"), F.current_timezone())).otherwise(t.cast("timestamp"))
    return F.translate(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--")


def default_text(c: str | Column, value: str | Column) -> Column:
    """``value`` where the text is absent or empty."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), value if isinstance(value, Column) else F.lit(value))


def default_number(c: str | Column, value: int) -> Column:
    """``value`` where the number is absent or zero."""
    return F.coalesce(F.nullif(_c(c), F.lit(0)), F.lit(value))


def artifact_name(name: str | Column, db: str | Column, ts: str | Column) -> Column:
    return default_text(name, F.concat_ws("_", _c(db), iso_stamp(ts)))


def artifact_extension(compress: str | Column) -> Column:
    return F.when(_c(compress), "gz").otherwise("sql")


def join_path(*parts: str | Column) -> Column:
    return F.concat_ws("/", *[_c(p) for p in parts])


def base_name(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dir_name(path: str | Column) -> Column:
    """Everything before the last slash; ``.`` for a bare name and ``/`` under the root."""
    p = _c(path)
    cut = F.regexp_replace(p, "/[^/]*$", "")
    return F.when(~p.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def epoch_millis(ts: str | Column) -> Column:
    """Milliseconds since the epoch; a time without zone is UTC, whatever the zone of the session."""
    t = _c(ts)
    shifted = F.from_utc_timestamp(t.cast("timestamp"), F.current_timezone())
    return F.unix_millis(F.when(F.typeof(t) == "timestamp_ntz", shifted).otherwise(t.cast("timestamp")))


def job_id(db: str | Column, ts: str | Column) -> Column:
    return F.concat(_c(db), F.lit("_"), epoch_millis(ts).cast("string"))


def json_object(**fields: str | Column) -> Column:
    """JSON text of the given members; null members are left out."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in fields.items()]))


def size_hundredths(size: str | Column) -> Column:
    """Bytes to hundredths of a mebibyte, half up, in exact integer arithmetic."""
    return _div(_c(size).cast("bigint") * 100 + 524288, 1048576)


def _two_decimals(hundredths: Column) -> Column:
    return F.concat(
        _div(hundredths, 100).cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
    )


def size_mb(size: str | Column) -> Column:
    return _two_decimals(size_hundredths(size))


def size_mb_or_na(size: str | Column) -> Column:
    """As :func:`size_mb`; a missing or zero size reads ``N/A``."""
    return F.when(_c(size) > 0, size_mb(size)).otherwise("N/A")


def ratio_percent(compressed: str | Column, size: str | Column) -> Column:
    """``(1 - compressed / size) * 100`` with one decimal, half away from zero; null for size 0."""
    wide = "decimal(38,0)"
    s = _c(size).cast("bigint")
    saved = (s - _c(compressed).cast("bigint")) * 1000
    tenths = _div((F.abs(saved) * 2 + s).cast(wide), (s * 2).cast(wide))
    text = F.concat(
        F.when(saved < 0, "-").otherwise(""),
        _div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"),
    )
    return F.when(s > 0, text)


def elapsed_seconds(start: str | Column, end: str | Column) -> Column:
    return (epoch_millis(end) - epoch_millis(start)) / F.lit(1000.0)


def seconds_text(millis: str | Column) -> Column:
    """Milliseconds as seconds with two decimals, half up; null when absent or zero."""
    m = _c(millis).cast("bigint")
    return F.when(m != 0, _two_decimals(_div(m + 5, 10)))


def duration_millis(seconds: str | Column) -> Column:
    return F.round(_c(seconds) * 1000).cast("bigint")


def prefix(c: str | Column, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def split_names(c: str | Column) -> Column:
    """Comma list to names: trimmed, empty pieces dropped; null stays null."""
    return F.filter(F.transform(F.split(_c(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def first_part(c: str | Column) -> Column:
    return F.substring_index(_c(c), ",", 1)


def local_time(ts: str | Column) -> Column:
    return F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def canonical_db_type(c: str | Column) -> Column:
    """Canonical database type, null when the type is not supported."""
    out = F.lit(None).cast("string")
    for spelling, name in DB_TYPES.items():
        out = F.when(_c(c) == spelling, name).otherwise(out)
    return out


def leading_int(c: str | Column) -> Column:
    """The integer a text starts with, null when there is none (ANSI-safe)."""
    return F.regexp_extract(_c(c), r"^\s*([+-]?\d+)", 1).try_cast("int")


def drop_absent(m: str | Column) -> Column:
    return F.map_filter(_c(m), lambda _k, v: v.isNotNull())


def redact(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), PASSWORD_MEMBER, '$1"***"')


def contains(c: str | Column, needle: str) -> Column:
    return _c(c).contains(needle)


def parse_size(c: str | Column) -> Column:
    """``50GB`` / ``20m`` / ``20971520`` to bytes; null when unreadable or beyond BIGINT."""
    pattern = r"^\s*(\d+)\s*([kmgtpKMGTP]?)[bB]?\s*$"
    number = F.regexp_extract(_c(c), pattern, 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(_c(c), pattern, 2))
    factor = F.lit(None).cast("bigint")
    for power, name in enumerate(SIZE_UNITS):
        factor = F.when(unit == name, F.lit(1024**power).cast("bigint")).otherwise(factor)
    return F.try_multiply(number, factor)


def yes_no(flag: str | Column) -> Column:
    return F.when(_c(flag), "Yes").otherwise("No")


def level_rank(level: str | Column) -> Column:
    """Severity rank, 0 = most severe; null for an unknown level."""
    out = F.lit(None).cast("int")
    for name, rank in LEVELS.items():
        out = F.when(_c(level) == name, rank).otherwise(out)
    return out


def sha256_hex(c: str | Column) -> Column:
    return F.sha2(_c(c), 256)


def now() -> Column:
    return F.current_timestamp()


def surrogate_id() -> Column:
    return F.uuid()
