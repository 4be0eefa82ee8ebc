"""RSS and calendar lines from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html, escape_ics, folded_ics


def rss_items(df: DataFrame, title: str, link: str, date: str, key: str, most: int = 50) -> DataFrame:
    """The newest ``most`` rows as RSS items, in order."""
    rows = df.orderBy(F.desc(date), F.asc(key)).limit(most)
    item = F.concat(F.lit("<item><title>"), escape_html(F.col(title)), F.lit("</title><link>"), escape_html(F.col(link)), F.lit("</link><guid isPermaLink=\"false\">"), escape_html(F.col(key).cast("string")), F.lit("</guid><pubDate>"), F.date_format(date, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    return rows.select(key, item.alias("item"))


def ics_events(df: DataFrame, key: str, title: str, day: Column) -> DataFrame:
    """All-day events as folded lines."""
    lines = F.concat(
        F.array(F.lit("BEGIN:VEVENT")), folded_ics(F.concat(F.lit("UID:"), escape_ics(F.col(key).cast("string")))),
        F.array(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"))), folded_ics(F.concat(F.lit("SUMMARY:"), escape_ics(F.col(title)))), F.array(F.lit("END:VEVENT")),
    )
    return df.select(key, F.array_join(lines, "\r\n").alias("event"))
