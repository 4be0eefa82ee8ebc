"""Dates and numbers that English and Japanese or Chinese texts state, and which of them a text has without support.

A text is read in passes: each takes what its pattern finds and leaves a blank, so no digit counts twice.  Passes are
Spark expressions.  Dates are struct(y, m, d): y is null and d is 0 where the text doesn't say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: names of months and numbers, signs of dates and counters.
MONTHS = "january february march april may june july august september october november december".split()
WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()
MORE_WORDS = {"twice": 2, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "dozen": 12, "hundred": 100}
ROMANS = "i ii iii iv v vi vii viii ix x".split()
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
SIGNS = "〇零一二两兩三四五六七八九十百千"
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
NUMBER = r"(?<![\d.])(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
ERA = f"令和([0-9{SIGNS}]+|元)年"
DAYS = r"(\d{1,2})月(\d{1,2})日(?:から|より|至|到|～|〜|~|-|－|—|・|、|和|及|与)(\d{1,2})日"
MONTH_RANGE = r"(\d{4})年(\d{1,2})月?(?:から|至|到|～|〜|~|-|－)(\d{1,2})月"
YMD, YM = r"(?:(\d{4})年)?(\d{1,2})月(\d{1,2})日", r"(?:(\d{4})年)?(\d{1,2})月(?!\d)"
COUNTED = f"([{SIGNS}]+)(?=年|か月|ヶ月|カ月|个月|個月|月|日|名|人|户|戸|项|項|件|批|类|類|次|倍|%|％|割|成|天|周|週|回|号|条|款|项)"
# ---- End of the fixed values.
_MONTH = "(" + "|".join(MONTHS) + ")"
_DATES, _NUMBERS = "array<struct<y:int,m:int,d:int>>", "array<bigint>"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def _int(text: Column) -> Column:
    """A whole number; null for no text."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def _found(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct(g1, ...)> of the groups of each match."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def _date(y: Column | None, m: Column, d: Column | int) -> Column:
    d = F.lit(d) if isinstance(d, int) else _int(d)
    return F.struct((F.lit(None) if y is None else _int(y)).cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))


def _read(text: Column, passes: list[tuple[str, tuple[int, ...], Callable, str]]) -> tuple[Column, Column]:
    """(dates, rest of the text): each pass gives an array of dates for a match, and what stands there after it."""
    dates = []
    for pattern, groups, made, left in passes:
        dates.append(F.flatten(F.transform(_found(text, pattern, *groups), made)))
        text = F.regexp_replace(text, pattern, left)
    return F.array_distinct(F.concat(*[d.cast(_DATES) for d in dates])), text


def _kanji(text: Column) -> Column:
    """Digits by place or with units, 元 as 1."""
    digits, units = _map(DIGITS), _map(UNITS)

    def step(acc: Column, c: Column) -> Column:
        unit, digit = F.element_at(units, c), F.element_at(digits, c)
        placed = F.struct(acc["sum"].alias("sum"), (acc["open"] * 10 + digit).cast("bigint").alias("open"))
        closed = F.struct((acc["sum"] + F.greatest(acc["open"], F.lit(1)) * unit).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("open"))
        return F.when(unit.isNotNull(), closed).when(digit.isNotNull(), placed).otherwise(acc)

    zero = F.lit(0).cast("bigint")
    read = F.aggregate(F.split(text, ""), F.struct(zero.alias("sum"), zero.alias("open")), step, lambda a: a["sum"] + a["open"])
    return F.when(text == "元", F.lit(1).cast("bigint")).when(text.rlike("^[0-9]+$"), text.cast("bigint")).otherwise(read)


def _years(dates: Column) -> Column:
    return F.transform(F.filter(dates, lambda d: d["y"].isNotNull()), lambda d: d["y"].cast("bigint"))


def english_facts(text: Column) -> Column:
    """struct(dates, numbers) of an English text: ISO dates, days and months with or without years, ranges, numerals and number words."""
    text, month = F.coalesce(text, F.lit("")), _map({name: i for i, name in enumerate(MONTHS, 1)})
    of = lambda c: F.element_at(month, F.lower(c))
    iso, rest = _read(text, [(ISO, (1, 2, 3), lambda g: F.array(_date(g["g1"], _int(g["g2"]), g["g3"])), " ")])
    dates, rest = _read(rest, [
        (rf"(?i)\b(\d{{1,2}}) (?:and|to|or|-|–) (\d{{1,2}}) {_MONTH}", (1, 2, 3), lambda g: F.array(_date(None, of(g["g3"]), g["g1"]), _date(None, of(g["g3"]), g["g2"])), " $2 $3"),
        (rf"(?i)\b{_MONTH} (?:and|to|or|-|–) {_MONTH} (\d{{4}})", (1, 2, 3), lambda g: F.array(_date(g["g3"], of(g["g1"]), 0), _date(g["g3"], of(g["g2"]), 0)), " "),
        (rf"(?i)\b{_MONTH} (\d{{1,2}}),? (\d{{4}})", (1, 2, 3), lambda g: F.array(_date(g["g3"], of(g["g1"]), g["g2"])), " "),
        (rf"(?i)\b(\d{{1,2}}) {_MONTH}(?:,? (\d{{4}}))?", (1, 2, 3), lambda g: F.array(_date(g["g3"], of(g["g2"]), g["g1"])), " "),
        (rf"(?i)\b{_MONTH}(?: (\d{{4}}))?\b", (1, 2), lambda g: F.array(_date(g["g2"], of(g["g1"]), 0)), " "),
    ])
    roman = F.transform(F.regexp_extract_all(rest, F.lit(rf"\(({'|'.join(sorted(ROMANS, key=len, reverse=True))})\)"), F.lit(1)), lambda r: F.element_at(_map({r: i for i, r in enumerate(ROMANS, 1)}), r).cast("bigint"))
    rest = F.regexp_replace(rest, rf"\(({'|'.join(ROMANS)})\)", " ")
    values = {w: i for i, w in enumerate(WORDS)} | MORE_WORDS
    words = F.transform(F.regexp_extract_all(rest, F.lit(rf"(?i)\b({'|'.join(values)})\b"), F.lit(1)), lambda w: F.element_at(_map(values), F.lower(w)).cast("bigint"))
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(1)), _int)
    dates = F.array_distinct(F.concat(iso, dates))
    return F.struct(dates.alias("dates"), F.array_sort(F.array_distinct(F.array_compact(F.concat(_years(dates), roman, numbers, words)))).alias("numbers"))


def local_facts(text: Column) -> Column:
    """The same of a Japanese or Chinese text; numerals of signs count before a counter only."""
    text = F.coalesce(text, F.lit(""))
    iso, rest = _read(text, [(ISO, (1, 2, 3), lambda g: F.array(_date(g["g1"], _int(g["g2"]), g["g3"])), " ")])
    gaps, eras = F.split(rest, ERA, -1), F.regexp_extract_all(rest, F.lit(ERA), F.lit(1))
    rest = F.array_join(F.zip_with(gaps, eras, lambda gap, y: F.concat(gap, F.coalesce(F.concat((_kanji(y) + 2018).cast("string"), F.lit("年")), F.lit("")))), "")
    dates, rest = _read(rest, [
        (DAYS, (1, 2, 3), lambda g: F.array(_date(None, _int(g["g1"]), g["g2"]), _date(None, _int(g["g1"]), g["g3"])), " "),
        (MONTH_RANGE, (1, 2, 3), lambda g: F.array(_date(g["g1"], _int(g["g2"]), 0), _date(g["g1"], _int(g["g3"]), 0)), " "),
        (YMD, (1, 2, 3), lambda g: F.array(_date(g["g1"], _int(g["g2"]), g["g3"])), " "),
        (YM, (1, 2), lambda g: F.array(_date(g["g1"], _int(g["g2"]), 0)), " "),
    ])
    scaled = lambda pattern, size, sign, t: F.array_join(F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda gap, n: F.concat(gap, F.coalesce(F.concat(F.floor(n.cast("double") * size).cast("string"), F.lit(sign)), F.lit("")))), "")
    rest = scaled(r"(\d+)割", 10, "%", scaled(r"(\d+(?:\.\d+)?)万", 10_000, "", rest))
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(1)), _int)
    counted = F.transform(F.regexp_extract_all(rest, F.lit(COUNTED), F.lit(1)), _kanji)
    dates, stated = F.array_distinct(F.concat(iso, dates)), _years(dates)
    return F.struct(dates.alias("dates"), F.array_sort(F.array_distinct(F.array_compact(F.concat(stated, numbers, counted)))).alias("numbers"))


def _known(date: Column, known: Column) -> Column:
    """Whether a date agrees with one that is known: in its month, in its day if it has one, in the year if both have."""
    return F.exists(known, lambda k: (k["m"] == date["m"]) & ((date["d"] == 0) | (k["d"] == date["d"])) & F.coalesce(k["y"] == date["y"], F.lit(True)))


def unsupported_facts(english: Column, local: Column) -> Column:
    """Sorted "date ..." and "number ..." that the facts of a local text state and the English ones don't; numbers below 2 aren't asked for.

    Both are results of :func:`english_facts` and :func:`local_facts`.
    """
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    label = lambda d: F.concat_ws("-", d["y"].cast("string"), two(d["m"]), F.when(d["d"] > 0, two(d["d"])))
    dates = F.transform(F.filter(local["dates"], lambda d: ~_known(d, english["dates"])), lambda d: F.concat(F.lit("date "), label(d)))
    known = F.concat(english["numbers"], _years(english["dates"]))
    numbers = F.transform(F.filter(local["numbers"], lambda n: (n >= 2) & ~F.array_contains(known, n)), lambda n: F.concat(F.lit("number "), n.cast("string")))
    return F.array_sort(F.array_distinct(F.concat(dates, numbers)))


def fact_places(facts: Column, text: Column, around: int = 40, most: int = 120) -> Column:
    """Each fact with the piece of the text that it stands in: array<struct(fact, snippet)>."""
    at = lambda f: F.instr(text, F.substring_index(F.substring_index(f, " ", -1), "-", 1))
    return F.transform(facts, lambda f: F.struct(f.alias("fact"), F.substring(text, F.greatest(at(f) - around, F.lit(1)), F.lit(most)).alias("snippet")))
