"""Which pages of a long document say most: an overview and the pages with provisions, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- Fixed values: signs of substance on a page.
CUES = (
    "改正概要", "改正の概要", "主な改正", "改正内容", "改正点", "適用対象", "適用範囲", "施行期日", "施行日", "経過措置",
    "新設", "義務付け", "届出", "許可", "認可", "基準", "要件",
)
CLAUSE = "第[0-9０-９一二三四五六七八九十百千]+条"
CONTENTS = "目次"
# ---- End of the fixed values.


def substance(text: Column) -> Column:
    """Three for each cue that a page has, one for each clause up to four, eight less for a table of contents."""
    cues = F.size(F.filter(F.array(*[F.lit(c) for c in CUES]), lambda c: text.contains(c))) * 3
    clauses = F.least(F.lit(4), F.size(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0))))
    return cues + clauses - F.when(F.substring(text, 1, 100).contains(CONTENTS), 8).otherwise(0)


def page_excerpts(pages: DataFrame, key: str, page: str, text: str, most: int, later: int = 2) -> DataFrame:
    """(key, excerpt): a document's whole text if it fits, else its first page and the ``later`` others with most substance.

    Every chosen page but the last leaves room for those after it (600 characters each at most); a piece below 100
    characters is left out.  Blank pages don't count; documents of blank pages alone are missing.
    """
    clean = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    rows = pages.select(F.col(key), F.col(page).alias("page"), clean.alias("body")).where("body <> ''")
    own = Window.partitionBy(key)
    rows = rows.withColumn("whole", F.sum(F.length("body") + 1).over(own) - 1).withColumn("nth", F.row_number().over(own.orderBy("page")))
    best = F.row_number().over(own.orderBy((F.col("nth") > 1).cast("int"), F.when(F.col("nth") > 1, -substance(F.col("body"))), "page"))
    rows = rows.withColumn("best", best).where((F.col("whole") <= most) | (F.col("best") <= later + 1))
    # a fitting document has all its pages here, any other a few: both are bounded by the budget and the pages' number
    found = rows.groupBy(key).agg(F.max("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("page", "body"))).alias("p"))
    mark = lambda x: F.concat(F.lit("[page "), x["page"].cast("string"), F.lit("; excerpt] "))
    reserve = lambda i: F.aggregate(F.slice("p", i + 2, F.size("p")), F.lit(0), lambda n, x: n + F.least(F.lit(600), F.length(x["body"])) + 25)

    def step(acc: Column, x: Column) -> Column:
        room = F.greatest(F.lit(0), acc["left"] - F.length(mark(x["v"])) - x["reserve"])
        take = F.least(F.length(x["v"]["body"]), room)
        part = F.concat(mark(x["v"]), F.substring(x["v"]["body"], F.lit(1), take))
        used = F.struct((acc["left"] - F.length(part) - 1).alias("left"), F.concat(acc["out"], F.array(part)).alias("out"))
        return F.when(take < 100, acc).otherwise(used)

    chosen = F.transform("p", lambda x, i: F.struct(x.alias("v"), reserve(i).alias("reserve")))
    cut = F.aggregate(chosen, F.struct(F.lit(most).alias("left"), F.array().cast("array<string>").alias("out")), step, lambda a: F.substring(F.array_join(a["out"], " "), 1, most))
    return found.select(key, F.when(F.col("whole") <= most, F.array_join(F.col("p.body"), " ")).otherwise(cut).alias("excerpt"))
