"""Notices of official sites: one parser gives every link of a page with what stands around it, sites are conditions on that.

:func:`links` runs the parser over a column; each site's function in ``SITES`` then is a plan of filters and expressions over
its rows, so what a site is about shows in the plan and a new site needs no parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions.rules import Rule, contains_any, first_match

# ---- Fixed values: what sites write and what their notices are called.
DAY = r"([0-9]{4})年\s*([0-9]{1,2})月\s*([0-9]{1,2})日"
BILL_KINDS = ("衆法", "参法", "閣法")
BILL_STAGES = (Rule("Enacted", ("成立",)), Rule("Government Announcement", ("未了", "否決", "撤回", "審査未了", "廃案")))
ENFORCEMENT = ("勧告", "告発", "禁止及び停止命令", "課徴金", "行政処分", "金融商品取引法違反")
MARKET = (*ENFORCEMENT, "パブリックコメント", "証券モニタリングに関する基本指針", "証券モニタリング基本方針")
NOT_MARKET = ("事例集", "活動状況", "パンフレット")
# ---- End of the fixed values.

_LINK = T.StructType([
    T.StructField("place", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("cell", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType())),
    T.StructField("table", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("table_class", T.StringType()),
    T.StructField("item", T.StringType()), T.StructField("item_class", T.StringType()), T.StructField("list_class", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("time", T.StringType()),
    T.StructField("link_class", T.StringType()), T.StructField("group", T.StringType()), T.StructField("mark", T.StringType()),
])


class _Scope:
    """An open element that texts are gathered for."""

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.words, self.rest = tag, attrs, [], {}

    def text(self) -> str:
        return " ".join("".join(self.words).split())


class _Links(HTMLParser):
    """Every link with its row, table, list item, heading and the nearest date before it."""

    KEPT = ("table", "caption", "tr", "td", "th", "li", "ul", "dt", "a", "p", "span", "div")

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.open, self.found, self.group, self.mark, self.rows, self.muted = base, [], [], "", "", 0, 0

    def near(self, *tags: str) -> _Scope | None:
        return next((s for s in reversed(self.open) if s.tag in tags), None)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        self.muted += tag in ("script", "style")
        if tag == "time" and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", attrs.get("datetime", "")):
            self.mark = attrs["datetime"]
            if item := self.near("li"):
                item.rest.setdefault("time", self.mark)
        if tag in ("tr", "li", "td", "th", "dt") and self.open and self.open[-1].tag in (tag, "a"):
            self.handle_endtag(self.open[-1].tag)  # its end was left out
        if tag not in self.KEPT:
            return
        scope = _Scope(tag, attrs)
        if tag == "tr":
            scope.rest = {"number": self.rows, "cells": [], "head": [], "paragraphs": [], "links": 0}
            self.rows += 1
        if tag == "a" and attrs.get("href"):
            row, cell = self.near("tr"), self.near("td", "th")
            scope.rest = {
                "href": attrs["href"].strip(), "row": row, "cell": len(row.rest["cells"]) if row and cell and cell.tag == "td" else -1, "table": self.near("table"),
                "item": self.near("li"), "list": self.near("ul"), "group": self.group, "mark": self.mark, "link": scope,
            }
            self.found.append(scope.rest)
            if row:
                row.rest["links"] += 1
        self.open.append(scope)

    def handle_endtag(self, tag):
        self.muted = max(0, self.muted - (tag in ("script", "style")))
        if tag == "dl":
            self.group = ""
        if tag not in self.KEPT or not any(s.tag == tag for s in self.open):
            return
        while self.open:
            scope = self.open.pop()
            self._closed(scope)
            if scope.tag == tag:
                return

    def _closed(self, scope: _Scope) -> None:
        row, item, value = self.near("tr"), self.near("li"), scope.text()
        if scope.tag == "td" and row:
            row.rest["cells"].append(value)
        elif scope.tag == "th" and row:
            row.rest["head"].append(value)
        elif scope.tag == "p" and row and not row.rest["cells"] and value:
            row.rest["paragraphs"].append(value)
        elif scope.tag == "caption" and (table := self.near("table")):
            table.rest.setdefault("caption", value)
        elif scope.tag == "dt" or (scope.tag == "span" and "heading" in scope.attrs.get("class", "")):
            self.group = value
        elif scope.tag == "tr" and not scope.rest["links"]:  # a row without a link is a record as well
            self.found.append({"href": None, "row": scope, "cell": -1, "table": self.near("table"), "item": None, "list": None, "group": self.group, "mark": self.mark, "link": None})
        if item and scope.tag in ("p", "span", "div"):
            for name in scope.attrs.get("class", "").split():
                item.rest.setdefault("fields", {}).setdefault(name, value)

    def handle_data(self, data):
        if self.muted:
            return
        for scope in self.open:
            scope.words.append(data)
        for m in re.finditer(DAY, data):
            year, month, day = map(int, m.groups())
            try:
                self.mark = pd.Timestamp(year, month, day).strftime("%Y-%m-%d")
            except ValueError:
                continue

    def done(self) -> list[dict]:
        while self.open:
            self._closed(self.open.pop())
        text = lambda s: s.text() if s else ""
        css = lambda s: s.attrs.get("class", "") if s else ""
        out = []
        for place, r in enumerate(self.found):
            row, table, item = r["row"], r["table"], r["item"]
            out.append({
                "place": place, "href": None if r["href"] is None else urljoin(self.base, r["href"]), "text": text(r["link"]), "row": row.rest["number"] if row else None,
                "cells": row.rest["cells"] if row else [], "cell": r["cell"], "head": " ".join(row.rest["head"]) if row else "", "paragraphs": row.rest["paragraphs"] if row else [],
                "table": text(table), "caption": table.rest.get("caption", "") if table else "", "table_class": css(table),
                "item": text(item), "item_class": css(item), "list_class": css(r["list"]), "fields": item.rest.get("fields", {}) if item else {}, "time": item.rest.get("time") if item else None,
                "link_class": css(r["link"]), "group": r["group"], "mark": r["mark"],
            })
        return out


def links(df: DataFrame, html: str, base: Column, keep: list[str]) -> DataFrame:
    """A row for each link of each page (and each table row without one), in the page's order, with what stands around it."""

    @F.pandas_udf(T.ArrayType(_LINK))
    def parse(pages: pd.Series, bases: pd.Series) -> pd.Series:
        def one(page, base):
            p = _Links(base or "")
            p.feed(page or "")
            p.close()
            return p.done()

        return pd.Series([one(p, b) for p, b in zip(pages, bases)])

    return df.select(*keep, base.alias("base"), F.explode(parse(F.col(html), base)).alias("r")).select(*keep, "base", "r.*")


# ------------------------------------------------------------------ sites


def _day(text: Column, nth: int = 0) -> Column:
    """The nth date written with year, month and day signs, as ISO text; null if there are fewer real ones."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(DAY), F.lit(i)).alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"))])
    days = F.transform(parts, lambda p: F.concat_ws("-", p["y"], F.lpad(p["m"], 2, "0"), F.lpad(p["d"], 2, "0")).try_cast("date"))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(nth)).cast("string")


def _slashed(text: Column) -> Column:
    return dates.slash_date(text).cast("string")


def _era(text: Column) -> Column:
    return dates.era_date(F.replace(text, F.lit(" "), F.lit(""))).cast("string")


def _cell(n: int) -> Column:
    return F.get("cells", F.lit(n))


def _has(column: str, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.col(column).contains(w)
    return out


def _css(column: str, name: str) -> Column:
    return F.array_contains(F.split(column, r"\s+"), name)


def _entry(df: DataFrame, keep: list[str], title: Column, link: Column, summary: Column, published: Column, deadline: Column | None = None, hint: Column | None = None) -> DataFrame:
    """Rows with a title and a link; null where a site says nothing."""
    none = F.lit(None).cast("string")
    out = df.select(*keep, "place", title.alias("title"), link.alias("link"), summary.alias("summary"), published.alias("published"), (none if deadline is None else deadline).alias("deadline"), (none if hint is None else hint).alias("stage_hint"))
    return out.where("title <> '' AND link <> ''")


def _first_of(df: DataFrame, *key: str) -> DataFrame:
    """The first row of each key in the page's order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("place"))).where("_n = 1").drop("_n")


def bills(df, keep, today):
    """A bill for each row of a table whose caption names its kind; the link to its progress before others, the page itself without any."""
    rows = df.where(contains_any(F.col("caption"), BILL_KINDS) & (F.size("cells") >= 4) & _cell(0).rlike("^[0-9]+$"))
    rows = rows.withColumn("_late", (F.col("text") != "経過").cast("int"))
    best = Window.partitionBy(*keep, "row").orderBy("_late", "place")
    rows = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    kind = first_match(F.col("caption"), [Rule(k, (k,)) for k in BILL_KINDS], "")
    status = F.when(_cell(3) == "", "提出").otherwise(_cell(3))
    number = F.when(_cell(1) == "", "不明").otherwise(_cell(1))
    about = F.concat(kind, F.lit("; 審議状況: "), status, F.lit("; 提出回次: "), _cell(0), F.lit("; 番号: "), number)
    return _entry(rows, keep, _cell(2), F.coalesce("href", "base"), about, F.lit(""), hint=first_match(status, BILL_STAGES, "Bill Submitted"))


def exchange_comments(df, keep, today):
    rows = _first_of(df.where(_has("table", "募集開始日", "募集終了日", "案件名") & (F.size("cells") >= 4) & (F.col("cell") == 3)), *keep, "row")
    start, end = _slashed(_cell(0)), _slashed(_cell(1))
    about = F.concat(F.lit("JPX public comment; 法人: "), _cell(2), F.lit("; 募集期間: "), F.coalesce(start, F.lit("")), F.lit("～"), F.coalesce(end, F.lit("")))
    return _entry(rows, keep, F.col("text"), F.col("href"), about, start, end)


def rule_revisions(df, keep, today):
    rows = _first_of(df.where(_has("table", "公表日", "新旧", "内容") & (F.size("cells") >= 2) & F.col("href").isNotNull()), *keep, "row")
    return _entry(rows, keep, _cell(1), F.col("href"), F.lit("東京証券取引所 規則改正新旧対照表"), _slashed(_cell(0))).where("published IS NOT NULL")


def safety_updates(df, keep, today, days: int = 550):
    """News of the safety category within ``days``, each event once."""
    rows = df.where((F.col("fields")["category"] == "安全") & F.col("href").isNotNull())
    title, link, at = F.col("fields")["title"], F.col("href"), _day(F.col("fields")["date"])
    out = _entry(rows, keep, title, link, F.lit("PMDA 安全対策業務 新着情報"), at, hint=F.lit("Government Announcement"))
    return _first_of(out.where(F.col("published") >= F.date_sub(today, days).cast("string")), *keep, "published", "title", "link")


def broker_comments(df, keep, today):
    rows = df.where((_has("table", "案件名") | _has("table", "案 件 名")) & _has("table", "募集期間") & ~_has("table", "公表日") & (F.size("cells") >= 2) & (F.col("cell") == 0))
    start, end = _day(_cell(1)), _day(_cell(1), 1)
    about = F.concat(F.lit("JSDA public comment; 募集期間: "), start, F.lit("～"), end)
    return _first_of(_entry(rows.withColumn("r", F.col("row")), [*keep, "r"], F.col("text"), F.col("href"), about, start, end).where("deadline IS NOT NULL"), *keep, "r").drop("r")


def broker_results(df, keep, today):
    rows = _first_of(df.where(_has("table", "公表日", "案件名", "募集期間") & (F.size("cells") >= 3) & (F.col("cell") == 1)), *keep, "row")
    start, end = _day(_cell(2)), _day(_cell(2), 1)
    about = F.concat(F.lit("JSDA public comment results"), F.coalesce(F.concat(F.lit("; 募集期間: "), start, F.lit("～"), end), F.lit("")))
    title = F.trim(F.substring_index(_cell(1), "【資料】", 1))
    return _entry(rows, keep, title, F.col("href"), about, _day(_cell(0)), hint=F.lit("Public Comment Results Published")).where("published IS NOT NULL")


def court_decisions(df, keep, today):
    """Rows of the top court with a link to the decision; its date is the era date of the case's second line."""
    rows = df.where(F.exists("cells", lambda c: c.contains("最高裁判例")) | _has("head", "最高裁判例")).where(F.col("href").contains("detail2/"))
    rows = _first_of(rows, *keep, "row")
    line = F.coalesce(F.get("paragraphs", F.lit(1)), F.lit(""))
    out = _entry(rows, keep, F.get("paragraphs", F.lit(0)), F.col("href"), line, _era(line), hint=F.lit("Court Decision"))
    return _first_of(out.where("published IS NOT NULL"), *keep, "link")


def market_enforcement(df, keep, today):
    rows = df.where((F.col("item") != "") & contains_any(F.col("text"), MARKET) & ~contains_any(F.col("text"), NOT_MARKET))
    hint = F.when(contains_any(F.col("text"), ENFORCEMENT), "Enforcement Action")
    out = _entry(rows, keep, F.col("text"), F.col("href"), F.lit("SESC enforcement or securities market-monitoring policy update"), _era(F.col("item")), hint=hint)
    return _first_of(out.where("published IS NOT NULL"), *keep, "link")


def privacy_news(df, keep, today):
    rows = df.where(F.col("time").isNotNull() & F.col("fields")["news-label-wrap"].isNotNull() & F.col("fields")["news-text"].isNotNull())
    return _entry(rows, keep, F.col("text"), F.col("href"), F.col("fields")["news-label-wrap"], F.col("time"))


def competition_news(df, keep, today):
    """Titles that may begin with their date in brackets."""
    rows = df.where(_css("list_class", "norcor") & (F.col("item") == F.col("text")))
    dated = F.regexp_extract("text", r"^\(([^)]+)\)\s*(.+)$", 2)
    at = F.when(dated != "", _era(F.regexp_extract("text", r"^\(([^)]+)\)", 1)))
    return _entry(rows, keep, F.when(dated != "", F.trim(dated)).otherwise(F.col("text")), F.col("href"), F.lit("報道発表"), at)


def environment_news(df, keep, today):
    """Items below a date's heading; a heading whose date is none dates nothing."""
    rows = df.where(_css("item_class", "c-news-link__item") & _css("link_class", "c-news-link__link") & F.col("group").rlike(DAY + "発表"))
    return _entry(rows, keep, F.col("text"), F.col("href"), F.coalesce(F.col("fields")["c-tag"], F.lit("報道発表")), _day(F.col("group")))


def transport_news(df, keep, today):
    """Press releases of each day's group, without the pages that list them; the first link of a release counts."""
    rows = df.where(F.col("group").rlike(f"^{DAY}$") & F.col("href").contains("/report/press/") & ~F.col("href").rlike(r"/report/press/(houdou[0-9]{6}|[a-z_]+_news)\.html$"))
    return _first_of(_entry(rows, keep, F.col("text"), F.col("href"), F.lit("報道発表"), _day(F.col("group"))), *keep, "link")


def economy_news(df, keep, today):
    """Releases dated by the nearest date before them."""
    rows = df.where(F.col("href").rlike("/press/[0-9]{4}/") & F.col("href").endswith(".html"))
    return _first_of(_entry(rows, keep, F.col("text"), F.col("href"), F.lit("ニュースリリース"), F.col("mark")), *keep, "link")


def tax_news(df, keep, today, days: int = 550):
    """Rows of the two live tables, not of the archives, with an era date in the row's head within ``days``."""
    rows = df.where(_css("table_class", "index_news") & ~_css("table_class", "info-item") & F.col("href").rlike("^https?:"))
    at = _era(F.regexp_extract("head", "令和(元|[0-9]+)年[0-9]{1,2}月[0-9]{1,2}日", 0))
    out = _entry(_first_of(rows, *keep, "row"), keep, F.col("text"), F.col("href"), F.lit("国税庁新着情報・通達等"), at)
    return _first_of(out.where(F.col("published").between(F.date_sub(today, days).cast("string"), today.cast("string"))), *keep, "link")


SITES: dict[str, Callable[[DataFrame, list[str], Column], DataFrame]] = {
    "bills": bills, "exchange_comments": exchange_comments, "rule_revisions": rule_revisions, "safety_updates": safety_updates, "broker_comments": broker_comments, "broker_results": broker_results,
    "court_decisions": court_decisions, "market_enforcement": market_enforcement, "privacy_news": privacy_news, "competition_news": competition_news, "environment_news": environment_news,
    "transport_news": transport_news, "economy_news": economy_news, "tax_news": tax_news,
}


def notices(df: DataFrame, html: str, base: Column, keep: list[str], site: str, today: Column) -> DataFrame:
    """The notices of one site's pages: ``keep``, place, title, link, summary, published, deadline, stage_hint."""
    return SITES[site](links(df, html, base, keep), keep, today)
