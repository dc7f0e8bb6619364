"""Time windows and boundary-counting date differences as Spark Columns.

All timestamps are ``TimestampType`` interpreted in the session time zone,
which :mod:`keelson.session` pins to UTC.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named window choices offered to users, in days (None = all history).
NAMED_WINDOWS = {"all": None, "30d": 30, "90d": 90, "180d": 180}


def ts_sql(value: datetime) -> str:
    """SQL text of a timestamp literal in the session zone (UTC)."""
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"


def ts_lit(value: datetime) -> Column:
    """Timestamp literal parsed in the session zone (UTC); never via Python tz."""
    return F.expr(ts_sql(value))


def _ref(column: str | Column) -> str | None:
    """SQL text for a plain column name (None for Column objects)."""
    return f"`{column}`" if isinstance(column, str) else None


@dataclass(frozen=True)
class Window:
    """Half-open ``[start, end)`` interval; ``None`` ends are open.

    ``as_of`` replaces "now": metrics that age items against the window end use
    ``end or as_of`` so results are reproducible (never ``current_timestamp()``).
    """

    start: datetime | None = None
    end: datetime | None = None

    @classmethod
    def all(cls) -> Window:
        return cls()

    @classmethod
    def trailing(cls, days: int, as_of: datetime) -> Window:
        return cls(start=as_of - timedelta(days=days), end=None)

    @classmethod
    def named(cls, name: str, as_of: datetime) -> Window:
        days = NAMED_WINDOWS[name]
        return cls.all() if days is None else cls.trailing(days, as_of)

    @classmethod
    def dates(cls, first_day: datetime, last_day: datetime) -> Window:
        """Custom date range: start of the first day to the last microsecond of the last."""
        start = datetime.combine(first_day.date(), time.min)
        end = datetime.combine(last_day.date(), time.max)
        return cls(start=start, end=end)

    def end_or(self, as_of: datetime) -> datetime:
        return self.end or as_of

    def contains(self, column: str | Column) -> Column:
        """Whether a known instant lies in the window: only the ends that exist are compared."""
        c = F.col(column) if isinstance(column, str) else column
        inside = c.isNotNull()
        if self.start is not None:
            inside &= c >= ts_lit(self.start)
        if self.end is not None:
            inside &= c < ts_lit(self.end)
        return inside


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Number of minute boundaries crossed from ``start`` to ``end`` (may be negative).

    Both instants are floored to the minute first, so 10:00:59 -> 10:01:01 is 1.
    """
    if isinstance(start, str) and isinstance(end, str):
        return F.expr(
            f"floor(unix_seconds({_ref(end)}) / 60) - floor(unix_seconds({_ref(start)}) / 60)"
        )
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.floor(F.unix_seconds(e) / 60) - F.floor(F.unix_seconds(s) / 60)


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Boundary-counted minutes expressed in hours (``minutes / 60.0``), as DOUBLE."""
    if isinstance(start, str) and isinstance(end, str):
        return F.expr(
            f"CAST(floor(unix_seconds({_ref(end)}) / 60) - floor(unix_seconds({_ref(start)}) / 60)"
            " AS DOUBLE) / 60.0D"
        )
    return minutes_between(start, end).cast("double") / F.lit(60.0)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Number of day boundaries crossed (calendar-date difference in UTC), as BIGINT."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.datediff(F.to_date(e), F.to_date(s)).cast("long")


def month_index(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.year(c) * 12 + F.month(c)


def months_between_starts(start: str | Column, end: str | Column) -> Column:
    """Whole months between two month-start timestamps, as BIGINT."""
    return (month_index(end) - month_index(start)).cast("long")


def month_start(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.date_trunc("month", c)


def iso_z(column: str | Column) -> Column:
    """Format a timestamp as ISO-8601 with a trailing ``Z`` (UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Rewrites of ISO-8601 forms to the one with separators, seconds, at most six digits of a
#: second and a colon in the offset.
_ISO_FORMS = (
    (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"),
    (r"([T ])(\d{2})(\d{2})(\d{2})(?=$|[Z+.,-])", "$1$2:$3:$4"),
    (r"([T ])(\d{2})(\d{2})(?=$|[Z+-])", "$1$2:$3"),
    (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=$|[Z+-])", "$1:00"),
    (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00"),
    (r"(:\d{2}),(\d)", "$1.$2"),
    (r"(\.\d{6})\d+", "$1"),
    (r"([T ][\d:.]+[+-]\d{2})(\d{2})$", "$1:$2"),
    (r"([T ][\d:.]+[+-]\d{2})$", "$1:00"),
)


def parse_timestamp(column: str | Column) -> Column:
    """Parse ISO-8601 text (``Z`` or offset), falling back to RFC 2822 dates.

    Returns NULL for empty or unparsable text instead of raising.
    """
    c = F.col(column) if isinstance(column, str) else column
    text = F.trim(c)
    for pattern, to in _ISO_FORMS:
        text = F.regexp_replace(text, pattern, to)

    def parsed(t: Column) -> Column:
        # RFC 2822: "Mon, 15 Jun 2026 08:30:00 GMT" -> drop the weekday, then parse.
        rfc = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
        forms = (
            "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
            "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd",
        )
        return F.coalesce(
            *[F.try_to_timestamp(t, F.lit(f)) for f in forms],
            *[F.try_to_timestamp(rfc, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")],
        )

    # A lambda's variable, so the rewrites are evaluated once, not once per form.
    return F.transform(F.array(text), parsed)[0]
