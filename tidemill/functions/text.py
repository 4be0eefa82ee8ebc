"""Text functions; built-in expressions but for Unicode normal forms and HTML entities."""

from __future__ import annotations

import difflib
import html as _html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]"


def collapse(text: Column) -> Column:
    """One blank for each run of ASCII white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(collapse(text), F.lit(""))


def shorten_title(text: Column, most: int = 120, least: int = 72) -> Column:
    """At most ``most`` characters, cut at the last blank if that keeps ``least``."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    has = F.instr(head, " ") > 0
    return F.when(F.length(text) <= most, text).when(has & (at >= least), F.rtrim(F.substring(head, F.lit(1), at.cast("int")))).otherwise(F.rtrim(head))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def csv_cell(text: Column) -> Column:
    """A quoted cell; a leading = + - @ or control character gets an apostrophe, so that no program takes it for a formula."""
    plain = F.coalesce(text, F.lit(""))
    guarded = F.when(plain.rlike(r"^[\x20\x09-\x0D]*[=+@\x09\x0D-]"), F.concat(F.lit("'"), plain)).otherwise(plain)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_ics(text: Column) -> Column:
    out = text
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def host(url: Column) -> Column:
    """Host of a URL, in lower case, without port or credentials; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def under_domain(host_: Column, domain: Column) -> Column:
    """Whether a host is the domain or one below it."""
    return (host_ == domain) | host_.endswith(F.concat(F.lit("."), domain))


def safe_url(url: Column) -> Column:
    """http(s) URLs without credentials, blanks and control characters; others are null."""
    ok = url.rlike(r"^https?://[^/?#@\x00-\x20\x7F]+([/?#][^\x00-\x20\x7F]*)?$")
    return F.when(ok, url)


def query_value(url: Column, name: str) -> Column:
    return F.regexp_extract(url, "[?&]" + re.escape(name) + "=([^&#]*)", 1)


def one_line(text: Column, most: int = 300) -> Column:
    return F.substring(collapse(text), 1, most)


def between_labels(text: Column, first: str, second: str) -> Column:
    """What stands between two labels; null if either is missing."""
    after = F.substring_index(text, first, -1)
    found = text.contains(first) & after.contains(second)
    return F.when(found, F.trim(F.substring_index(after, second, 1)))


def fields(text: Column, outer: str = ";", inner: str = ":") -> Column:
    """Map of "key: value; key: value"; the first ``inner`` parts, blanks go, the last of equal keys wins."""
    parts = F.filter(F.split(text, re.escape(outer)), lambda p: p.contains(inner))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, inner, 1)).alias("key"), F.trim(F.substring(p, F.instr(p, inner) + F.lit(len(inner)), F.length(p))).alias("value")))
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(last)


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams."""
    count = F.greatest(F.length(text) - (n - 1), F.lit(0))
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(title: Column, body: Column, n: int, least: int = 3) -> Column:
    """Whether at least ``least`` (or all, if fewer) of the title's n-grams occur in the body."""
    own = grams(title, n)
    hits = F.size(F.filter(own, lambda g: body.contains(g)))
    return (F.size(own) > 0) & (hits >= F.least(F.lit(least), F.size(own)))


def unsupported_numbers(output: Column, source: Column) -> Column:
    """Numbers of the output that are no substring of the source."""
    found = F.array_distinct(F.regexp_extract_all(output, F.lit("[0-9]+"), F.lit(0)))
    return F.filter(found, lambda x: ~source.contains(x))


def near_key(text: Column, most: int = 120) -> Column:
    """Lower case, anything but letters and digits as one blank, the first ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), 1, most)


def iso_dates(text: Column) -> Column:
    """2024/3/5, 2024.3.5 and 2024年3月5日 as 2024-03-05, where month and day are plausible."""
    slot = r"(?<![0-9])([0-9]{4})[/.年](0?[1-9]|1[0-2])[/.月](0?[1-9]|[12][0-9]|3[01])日?(?![0-9])"
    marked = F.regexp_replace(text, slot, "$1-0$2-0$3")
    return F.regexp_replace(F.regexp_replace(marked, r"-0([0-9]{2})-", "-$1-"), r"-0([0-9]{2})(?![0-9])", "-$1")


@F.pandas_udf(T.StringType())
def title_key(text: pd.Series) -> pd.Series:
    """NFKC, case folded, without punctuation, symbols and white space."""
    drop = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if unicodedata.category(c)[0] not in "PSZC")
    return text.map(lambda t: None if t is None else drop(t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def clean_markup(text: pd.Series) -> pd.Series:
    """Entities resolved, tags dropped, entities resolved again, white space collapsed."""
    tags = re.compile(r"<[^>]*>")
    return text.map(lambda t: None if t is None else " ".join(_html.unescape(tags.sub(" ", _html.unescape(t))).split()))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "old", "new")])))
def change_spans(old: pd.Series, new: pd.Series) -> pd.Series:
    """At most 12 changed spans between two texts."""

    def spans(a, b):
        ops = difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes()
        return [{"kind": k, "old": (a or "")[i:j], "new": (b or "")[m:n]} for k, i, j, m, n in ops if k != "equal"][:12]

    return pd.Series([spans(a, b) for a, b in zip(old, new)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_ics(line: pd.Series) -> pd.Series:
    """Lines of at most 75 octets, never cut within a character; later ones begin with a blank."""

    def fold(text):
        out, now, size = [], "", 0
        for c in text or "":
            n = len(c.encode())
            if size + n > 75:
                out.append(now)
                now, size = " ", 1
            now, size = now + c, size + n
        return [*out, now]

    return line.map(fold)


def localised(overlay: Column, locale: str, field: str, fallback: Column) -> Column:
    """A field of a locale's block in map<locale, struct>, where it isn't blank; else the fallback."""
    own = overlay[locale].getField(field)
    return F.when(F.trim(F.coalesce(own, F.lit(""))) != "", own).otherwise(fallback)


def haystack(*fields: Column) -> Column:
    """What a search looks through: all fields in lower case."""
    return F.lower(F.concat_ws("\n", *fields))
