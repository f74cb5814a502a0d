"""Scalar expressions shared by the operators. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How numbers, times and slugs are written.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NUMBER_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
EPOCH = r"^\s*\d+(\.\d+)?\s*$"
SLUG = "^[a-z0-9][a-z0-9-]*$"  # of any length: a cut could make two logs one
RESERVED_SLUGS = ("admin", "api")
DATE_PATTERNS = ("yyyy/M/d", "M/d/yyyy", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d-MMM-yyyy")

# A distributed sum has no fixed order, so its last bits vary between runs. A value
# this close to a half step counts as the half step and goes up.
HALF_STEP_SLACK = 1e-9


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(v, digits: int = 4) -> Column:
    """Round half toward +infinity; 0 digits means the default of 4."""
    f = float(10 ** (digits or 4))
    return F.floor(col(v) * F.lit(f) + F.lit(0.5 + HALF_STEP_SLACK)) / F.lit(f)


def js_round(v) -> Column:
    """Nearest whole number, halves toward +infinity."""
    return F.floor(col(v) + F.lit(0.5)).cast("long")


def number(v) -> Column:
    """Numeric text as double; blank text counts as 0, anything else unreadable as null."""
    s = col(v).cast("string")
    return F.when(F.trim(s) == "", F.lit(0.0)).when(s.rlike(NUMBER), F.trim(s).try_cast("double"))


def finite(v) -> Column:
    v = col(v)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)


def number_or(v, default: float) -> Column:
    return F.coalesce(finite(number(v)), F.lit(float(default)))


def outcome_number(v) -> Column:
    s = col(v).cast("string")
    return F.when(F.trim(s) != "", finite(number(s)))


def outcome_int(v) -> Column:
    return js_round(outcome_number(v))


def outcome_text(v) -> Column:
    return F.nullif(F.trim(col(v).cast("string")), F.lit(""))


def epoch_ms(v) -> Column:
    """Epoch seconds or milliseconds, ISO and common date text -> epoch milliseconds."""
    s = F.trim(col(v).cast("string"))
    n = F.when(s.rlike(EPOCH), s.try_cast("double"))
    plain = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]+, +", ""), r" +(GMT|UTC)$", "")  # without weekday and zone
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}"), s.try_cast("timestamp"))
    parsed = F.coalesce(
        iso,
        *[F.try_to_timestamp(plain, F.lit(day + clock)) for day in DATE_PATTERNS for clock in ("[ H:mm[:ss]]", " h:mm[:ss] a")],
    )
    # the date range of the clock type: 8.64e15 ms either side of the epoch
    ms = F.when(n < 1e11, n * 1000).otherwise(n)
    return F.when(n.isNotNull(), F.when(ms <= 8.64e15, ms.cast("long"))).otherwise(F.unix_millis(parsed))


def sql_time(ms) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd HH:mm:ss")


def clock(ts) -> Column:
    """A timestamp as the second-resolution text used in all results."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def iso_ms(ms) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def safe_name(v) -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(col(v).cast("string"), F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit("anon")).otherwise(s)


def is_slug(v) -> Column:
    return col(v).rlike(SLUG) & ~col(v).isin(*RESERVED_SLUGS)


def slug_from_filename(v) -> Column:
    s = F.regexp_replace(F.coalesce(F.nullif(col(v), F.lit("")), F.lit("import")), r"\.[^.]+$", "")
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", F.lit("imported")).otherwise(s)


def title_case(v) -> Column:
    """Underscores and dashes to spaces; first letter of every word in upper case."""
    s = F.regexp_replace(col(v).cast("string"), r"[_\-]+", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    words = F.transform(
        F.split(s, r"\b"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    )
    return F.array_join(words, "")


def number_prefix(v) -> Column:
    """The leading number of a text ("3a" -> 3), null without one."""
    return F.regexp_extract(col(v).cast("string"), NUMBER_PREFIX, 1).try_cast("double")


def activity(v="type") -> Column:
    return F.coalesce(col(v).cast("string"), F.lit("?"))


def sigmoid(z) -> Column:
    z = col(z)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log_odds(p) -> Column:
    """Log-odds of a rate, nudged off 0 and 1."""
    p = col(p)
    return F.log((p + 1e-6) / (1 - p + 1e-6))


def span_minutes(t_min, t_max) -> Column:
    """Span of two millisecond clocks in minutes, never negative; null if either is null."""
    d = col(t_max) - col(t_min)
    return F.when(d.isNotNull(), F.greatest(F.lit(0), d) / F.lit(60000.0))
