"""Names of drafts, court case numbers and other parts of Japanese titles, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import ERAS
from .text import nfkc

# ---- Fixed values: forms of drafts' names and case numbers, and how syllables and signs of a case are written.
DRAFT = (
    "^(.+?(?:法律|政令|省令|府令|内閣府令|規則|告示|命令|訓令))(?:（案）|案)(?:等)?(?:等)?"
    "(?:に関する|に対する|について|についての|への)"
)
CASE = r"(明治|大正|昭和|平成|令和)(元|\d+)\s*[（(]([^)）\s]{1,3})[)）]\s*(\d+)"
SYLLABLES = {
    "あいうえお": "A I U E O", "かきくけこ": "Ka Ki Ku Ke Ko", "さしすせそ": "Sa Shi Su Se So", "たちつてと": "Ta Chi Tsu Te To", "なにぬねの": "Na Ni Nu Ne No",
    "はひふへほ": "Ha Hi Fu He Ho", "まみむめも": "Ma Mi Mu Me Mo", "やゆよ": "Ya Yu Yo", "らりるれろ": "Ra Ri Ru Re Ro", "わを": "Wa Wo",
}
SIGNS = {"受": "Ju", "許": "Kyo", "行": "Gyo"}
# ---- End of the fixed values.


def draft_name(title: Column) -> Column:
    """The draft instrument that a consultation's title names; empty if it names none."""
    text = F.replace(nfkc(F.coalesce(title, F.lit(""))), F.lit("(案)"), F.lit("（案）"))
    return F.regexp_extract(F.translate(text, "「」", ""), DRAFT, 1)


def romanised(code: Column) -> Column:
    """A case's code in Latin letters, its signs joined by hyphens; null if one isn't known."""
    known = {k: v for row, names in SYLLABLES.items() for k, v in zip(row, names.split())}
    katakana = {chr(ord(k) + 0x60): v for k, v in known.items()}
    table = F.create_map(*[F.lit(x) for pair in (known | katakana | SIGNS).items() for x in pair])
    parts = F.transform(F.split(code, ""), lambda c: F.element_at(table, c))
    return F.when((code != "") & ~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "-"))


def case_numbers(text: Column) -> Column:
    """array<struct(written, year, code, number)> of the cases that a text names, each once, in order; unknown codes are left out."""
    text = nfkc(F.coalesce(text, F.lit("")))
    group = lambda i, n: F.regexp_extract_all(text, F.lit(CASE), F.lit(i)).alias(n)
    found = F.array_distinct(F.arrays_zip(group(1, "era"), group(2, "year"), group(3, "code"), group(4, "number")))
    eras = F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair])
    year = lambda c: F.when(c["year"] == "元", 1).otherwise(c["year"].cast("int"))
    cases = F.transform(found, lambda c: F.struct(
        F.concat(c["era"], c["year"], F.lit("("), c["code"], F.lit(")"), c["number"]).alias("written"),
        (F.element_at(eras, c["era"]) + year(c)).alias("year"), romanised(c["code"]).alias("code"), c["number"].cast("long").alias("number"),
    ))
    return F.filter(cases, lambda c: c["code"].isNotNull())
