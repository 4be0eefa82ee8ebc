"""Dates as strict ISO text, instants, weeks and period pairs.  "Now" and "today" are always parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JST = "Asia/Tokyo"
#: First year less one of each era.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}


def strict_date(text: Column) -> Column:
    """A date from YYYY-MM-DD and nothing else."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def not_future(date: Column, today: Column) -> Column:
    return F.when(date <= today, date)


def slash_date(text: Column) -> Column:
    """2024/3/5 or 2024.3.5 to a date; else null."""
    part = lambda i: F.regexp_extract(text, r"^\s*([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})\s*$", i)
    return strict_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def compact_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{8}$"), strict_date(F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))))


def era_date(text: Column) -> Column:
    """令和6年3月5日 to a date; the first year may be written 元."""
    pattern = "(" + "|".join(ERAS) + ")(元|[0-9]{1,2})年([0-9]{1,2})月([0-9]{1,2})日"
    part = lambda i: F.regexp_extract(text, pattern, i)
    base = F.element_at(F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair]), part(1))
    year = base + F.when(part(2) == "元", F.lit(1)).otherwise(part(2).try_cast("int"))
    return F.when(part(1) != "", strict_date(F.concat_ws("-", year.cast("string"), F.lpad(part(3), 2, "0"), F.lpad(part(4), 2, "0"))))


def any_date(text: Column) -> Column:
    """The first reading that holds: ISO text, its date part, compact, slashes, era."""
    iso = strict_date(F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ].*)?$", 1))
    return F.coalesce(iso, compact_date(text), slash_date(text), era_date(text))


def closes_at(deadline: Column, zone: str = JST) -> Column:
    """Instant at which a deadline passes: a date closes at the next midnight of its zone, a time at that time."""
    day = strict_date(deadline)
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
    naive = F.when(deadline.rlike(r"T[0-9:.]+$"), F.to_utc_timestamp(F.try_to_timestamp(deadline), zone))
    return F.coalesce(end, naive, F.when(day.isNull(), F.try_to_timestamp(deadline)))


def resolve_stage(stage: Column, deadline: Column, now: Column, open_: str = "Open for Comment", closed: str = "Closed") -> Column:
    """An open stage becomes closed once its deadline has passed; deadlines that can't be read change nothing."""
    return F.when((stage == open_) & (closes_at(deadline) <= now), F.lit(closed)).otherwise(stage)


def last_day(deadline: Column, zone: str = JST) -> Column:
    """Last day on which one can still file, in the zone."""
    return F.from_utc_timestamp(closes_at(deadline) - F.expr("INTERVAL 1 MICROSECOND"), zone).cast("date")


def local_day(at: Column, zone: str = JST) -> Column:
    return F.from_utc_timestamp(at, zone).cast("date")


def week_monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_slug(day: Column) -> Column:
    """2024-w09, by ISO year and week."""
    thursday = F.date_add(week_monday(day), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-w"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def period_pair(kind: str, today: Column) -> tuple[Column, Column, Column]:
    """(start of the period before, start, end) of the last whole day, week or month; half open."""
    if kind == "daily":
        end = today
        return F.date_sub(end, 2), F.date_sub(end, 1), end
    if kind == "weekly":
        end = week_monday(today)
        return F.date_sub(end, 14), F.date_sub(end, 7), end
    if kind == "monthly":
        end = F.trunc(today, "month")
        return F.add_months(end, -2), F.add_months(end, -1), end
    raise ValueError(f"unknown period: {kind}")


def newly_seen(seen: Column, today: Column, days: int = 7) -> Column:
    """Seen less than ``days`` days ago; the future doesn't count."""
    age = F.datediff(today, seen)
    return F.coalesce((age >= 0) & (age < days), F.lit(False))


def period_of(date: Column) -> Column:
    return F.coalesce(F.year(date).cast("string"), F.lit("undated"))


def lookback(today: Column, days: int) -> Column:
    """The days before today, newest first; between 1 and 31 of them."""
    n = min(31, max(1, days))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.date_sub(today, i))


def stage_by_dates(promulgated: Column, effective: Column, today: Column) -> Column:
    """In force once its date has come, scheduled before, promulgated without one."""
    return F.when(effective <= today, "In Force").when(effective > today, "Scheduled to Take Effect").when(promulgated <= today, "Promulgated")
