"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: What stands before an assigned value, and the value.
_HEAD = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
#: Kinds in the order that breaks ties of spans with the same start.  The first three
#: are strong: they count alone.  The others are weak: they count only when linked.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: A pattern whose last repetition has a minimum finds the very runs that the pattern
#: without one finds and a length filter keeps: runs are maximal and begin alike.
PATTERNS = (
    _HEAD + r"[A-Za-z0-9+/_.=-]+",
    r"AKIA[A-Z0-9]{12,}",
    r"[0-9a-f]{32,}",
    r"(?:client_id|access_id|user_id|account)\x20*[:=]\x20*[A-Za-z0-9._@-]{4,}",
    r"[A-Za-z0-9+/]{40,}",
    r"https?://[A-Za-z0-9.-]+",
)
#: Code points between two parts that still make one scope.
SCOPE = 256
#: Roles that a weak kind's complements play; it is reported if each role has a part in its scope.
ROLE = {"assign": "key", "hex": "key", "secret": "key", "access": "id", "identifier": "id", "endpoint": "at"}
NEEDS = {"identifier": ("key",), "secret": ("id",), "endpoint": ("id", "key")}
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<kind:int,gap:int,n:int,kept:boolean>>"


def _kept(kind: int, match: Column) -> Column:
    """Whether a match passes what its pattern can't say."""
    if kind == 0:
        return F.length(F.regexp_replace(match, "^" + _HEAD, "")) >= 8
    if kind == 4:
        return (F.length(match) == 40) & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _found(text: Column, kind: int) -> Column:
    """A kind's leftmost non-overlapping matches: code points between each and the one before, its own, and whether it counts.

    ``split`` gives the texts between the matches, ``regexp_extract_all`` the
    matches.  A text without a match, as nearly all are, is not split.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    each = F.zip_with(gaps, found, lambda g, m: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("n"), _kept(kind, m).alias("kept")))
    return F.when(F.size(found) == 0, F.array().cast(_FOUND)).otherwise(each)


def _spans(rows: DataFrame) -> DataFrame:
    """(row, start, kind, end): positions are running sums over a text's matches of a kind."""
    each = rows.where(F.size("found") > 0).select("row", F.posexplode("found").alias("i", "f")).select("row", "i", "f.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto).cast("int"))
    return each.where("kept").select("row", (F.col("end") - F.col("n")).alias("start"), "kind", "end")


def _text(spans: Column) -> Column:
    """Sorted spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _bins(a: Column, b: Column) -> Column:
    return F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE))).alias("bin")


def _clear(spans: DataFrame) -> DataFrame:
    """The spans without the weak ones that overlap a strong one: an interval join through bins of SCOPE code points."""
    strong = F.col("kind") < 3
    base = spans.where(strong).select(F.col("row").alias("b_row"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), _bins(F.col("start"), F.col("end") - 1).alias("b_bin"))
    weak = spans.where(~strong).select("row", "start", "kind", "end", _bins(F.col("start"), F.col("end") - 1))
    meets = (F.col("row") == F.col("b_row")) & (F.col("bin") == F.col("b_bin")) & (F.col("b_start") < F.col("end")) & (F.col("start") < F.col("b_end"))
    covered = weak.join(base, meets, "left_semi").select(*[F.col(c).alias(f"c_{c}") for c in ("row", "start", "kind")]).distinct()
    same = (F.col("row") == F.col("c_row")) & (F.col("start") == F.col("c_start")) & (F.col("kind") == F.col("c_kind"))
    return spans.join(covered, same, "left_anti")


def _linked(parts: DataFrame) -> DataFrame:
    """Interval join of the weak parts with their complements: those that are complete.

    Parts fall into bins of SCOPE code points, a weak part also into the bins that
    its scope reaches; an equi-join on row, bin and role with the exact distance as
    a further condition is a semi join, so no pair is ever made, however many
    parts a scope holds.
    """
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])]), F.col("kind"))
    have = parts.select(F.col("row").alias("h_row"), role.alias("h_role"), F.col("start").alias("h_start"), F.col("end").alias("h_end"), _bins(F.col("start"), F.col("end")).alias("h_bin"))
    out = None
    for kind, needs in NEEDS.items():
        weak = parts.where(F.col("kind") == KINDS.index(kind))
        for need in needs:
            binned = weak.select("row", "start", "kind", "end", _bins(F.col("start") - SCOPE, F.col("end") + SCOPE))
            near = (F.col("row") == F.col("h_row")) & (F.col("bin") == F.col("h_bin")) & (F.col("h_role") == need) & (F.col("h_start") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("h_end") + SCOPE)
            weak = binned.join(have, near, "left_semi").select("row", "start", "kind", "end").distinct()
        out = weak if out is None else out.union(weak)
    return out


def scan_secrets(spark: SparkSession, docs: DataFrame, text: str) -> DataFrame:
    """Spans of secrets in each row's whole text.

    Adds to ``docs``'s other columns: ``base_spans``, ``linked_spans`` (arrays of start,
    kind, end in code points, end exclusive; kinds are places in KINDS, sorted by start) and
    ``spans_text``, ``base_text`` (kind:start:end, comma-joined).  Strong kinds are always
    reported; a 40-character key, a client identifier or an endpoint only if its
    complements lie within SCOPE code points.  A weak part that overlaps a strong
    one is that strong one and isn't reported again.

    Work and memory grow in proportion to a text's length and its matches: running sums give the positions, and
    bins of SCOPE code points bound what is compared with a span.

    A null text is empty; it and texts without parts have empty arrays.  Repeated rows
    and repeated keys keep their own results; columns of ``docs`` named like a result
    are replaced.  An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in ("base_spans", "linked_spans", "spans_text", "base_text")]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.concat(*[_found(whole, k) for k in range(len(KINDS))])
    rows = docs.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"), found.alias("found"))
    rows = cut(spark, rows.withColumn("row", F.monotonically_increasing_id()))
    parts = cut(spark, _clear(cut(spark, _spans(rows))))
    span = F.struct("start", "kind", "end")
    spans = parts.where(F.col("kind") < 3).union(_linked(parts).select("row", "start", "kind", "end"))
    spans = spans.groupBy(F.col("row").alias("l_row")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = rows.select("rest", "row").join(spans, F.col("row") == F.col("l_row"), "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    base, linked = F.filter("spans", lambda s: s["kind"] < 3), F.filter("spans", lambda s: s["kind"] >= 3)
    return rows.select(
        *[F.col("rest").getField(c).alias(c) for c in rest],
        base.alias("base_spans"), linked.alias("linked_spans"), _text(F.col("spans")).alias("spans_text"), _text(base).alias("base_text"),
    )
