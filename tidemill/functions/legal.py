"""Law numbers, articles, sentences and instants in Japanese legal text, as Spark expressions.

Python (Arrow) is left only where Spark has no built-in: compatibility forms, numerals of any kind in law numbers,
and bracket depth, which is a running sum with a floor over a whole batch.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numerals import UNITS, free_number
from .text import nfkc

# ---- Fixed values: forms of law numbers, articles and instants, and brackets.
LAW_NUMBER = r"^(明治|大正|昭和|平成|令和)([^年]+)年(?:[^月]+月[^日]+日)?(.+?)第([^号]+)号$"
ARTICLE = r"第([0-9０-９一二三四五六七八九十百千]+)条(?:の([0-9０-９一二三四五六七八九十]+))?"
INSTANT = r"(?<![\d-])(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})?(?![\d:])"
OPENING, CLOSING = "（(「『［[〔【", "）)」』］]〕】"
# ---- End of the fixed values.
JST_MINUTES = 9 * 60


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def law_number_key(text: Column) -> Column:
    """struct(era, year, issuer, number, other): a text that isn't a law number only has ``other``, without blanks; no text, nothing."""
    plain = F.replace(nfkc(_or_null(text)), F.lit(" "), F.lit(""))
    part = lambda i: _or_null(F.regexp_extract(plain, LAW_NUMBER, i))
    year, number = free_number(part(2)), free_number(part(4))
    whole = year.isNotNull() & number.isNotNull()
    parts = {"era": part(1), "year": year, "issuer": part(3), "number": number}
    return F.struct(*[F.when(whole, c).alias(n) for n, c in parts.items()], F.when(~whole, plain).alias("other"))


def _number(text: Column) -> Column:
    """The value of ASCII or full-width digits, of kanji digits by place, or of kanji with units; null for a mixture and for no text."""
    ascii_ = F.translate(text, "０１２３４５６７８９", "0123456789")
    placed = F.translate(text, "一二三四五六七八九", "123456789")
    size_of = F.create_map(*[F.lit(x) for u in UNITS.items() for x in u])

    def step(acc: Column, c: Column) -> Column:
        size = F.element_at(size_of, c)
        return F.when(size.isNull(), F.struct(acc["sum"].alias("sum"), c.cast("long").alias("open"))).otherwise(
            F.struct((acc["sum"] + F.greatest(acc["open"], F.lit(1)) * size).alias("sum"), F.lit(0).cast("long").alias("open"))
        )

    zero = F.lit(0).cast("long")
    units = F.aggregate(F.split(placed, ""), F.struct(zero.alias("sum"), zero.alias("open")), step, lambda acc: acc["sum"] + acc["open"])
    return F.when(ascii_.rlike("^[0-9]+$"), ascii_.cast("long")).when(text.rlike("[0-9０-９]"), None).when(placed.rlike("^[1-9]+$"), placed.cast("long")).when(text != "", units)


def article_refs(text: Column) -> Column:
    """Articles that a text names, in ASCII digits, each once, sorted; no text names none."""
    text = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(i)).alias(n) for i, n in ((1, "main"), (2, "sub"))])
    sub = lambda p: F.coalesce(F.concat(F.lit("の"), _number(p["sub"]).cast("string")), F.lit(""))
    named = F.transform(pairs, lambda p: F.concat(F.lit("第"), _number(p["main"]).cast("string"), F.lit("条"), sub(p)))
    return F.array_sort(F.array_distinct(F.array_compact(named)))


def instants_in_jst(text: Column) -> Column:
    """Date-times as "YYYY-MM-DD HH:MM JST", seconds where there are any; without a zone they are JST already; what is none stays."""

    def shown(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, INSTANT, i)
        day, hour, minute, second, zone = (part(i) for i in range(1, 6))
        local = F.concat_ws(" ", day, F.concat_ws(":", hour, minute, F.when(second == "", "00").otherwise(second))).try_cast("timestamp_ntz")
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, -2, 2).try_cast("int")
        east = F.when(zone == "", JST_MINUTES).when(zone == "Z", 0).when((hours < 24) & (minutes < 60), F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
        there = (local + F.make_dt_interval(F.lit(0), F.lit(0), JST_MINUTES - east)).cast("string")
        tail = F.substring(there, 17, 3)
        return F.coalesce(F.concat(F.substring(there, 1, 16), F.when(tail == ":00", "").otherwise(tail), F.lit(" JST")), found)

    gaps, found = F.split(text, INSTANT, -1), F.regexp_extract_all(text, F.lit(INSTANT), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda gap, at: F.concat(gap, F.coalesce(shown(at), F.lit("")))), "")


def _depths(signs: np.ndarray) -> np.ndarray:
    """Bracket depth after each sign: it never falls below 0, and a line's end closes all."""
    step = np.isin(signs, [ord(c) for c in OPENING]).astype(np.int64) - np.isin(signs, [ord(c) for c in CLOSING])
    line = np.cumsum(signs == 10)
    total = np.cumsum(step)
    # within a line the total is lifted by as much as it ever fell below the line's start
    start = np.concatenate([[0], total[signs == 10]])[line]
    fall = np.minimum.accumulate(np.minimum(total - start, 0) - line * (len(signs) + 1)) + line * (len(signs) + 1)
    return total - start - fall


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentence_list(text: pd.Series) -> pd.Series:
    """Sentences by full stops outside brackets; a line's end closes a sentence and all brackets; blanks around them go."""
    texts = text.fillna("").tolist()
    whole = "\n".join(texts) + "\n"
    signs = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero((signs == 10) | ((signs == ord("。")) & (_depths(signs) == 0))) + 1
    parts = [whole[a:b].strip() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    first = np.searchsorted(ends, np.cumsum([0] + [len(t) + 1 for t in texts]), side="right")
    return pd.Series([[p for p in parts[a:b] if p] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], index=text.index)


def first_kind(sentence: Column, kinds: list[tuple[str, str]]) -> Column:
    """The first kind whose pattern a sentence holds, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        out = F.when(sentence.rlike(pattern), name).otherwise(out)
    return out


def unnegated(text: Column, phrase: str, negation: str, reach: int = 120) -> Column:
    """Whether a phrase occurs without a negation in its clause before it, within ``reach`` characters."""
    heads = F.slice(F.split(text, re.escape(phrase), -1), F.lit(1), F.greatest(F.size(F.split(text, re.escape(phrase), -1)) - 1, F.lit(0)))
    clause = F.transform(heads, lambda h: F.regexp_extract(F.when(F.length(h) > reach, F.substring(h, -reach, reach)).otherwise(h), r"([^.;:!?。；]*)$", 1))
    return F.exists(clause, lambda c: ~c.rlike(negation))


def support(count: Column, expected: Column) -> Column:
    """Share in percent, null where nothing was expected."""
    return F.when(expected > 0, F.round(count * 100.0 / expected, 4))
