"""Dossiers over closures of linked records: who claims an item, what is settled, reviewed, citable and shown.

A closure is a table of (dossier, item) rows; all here are joins and combining aggregates over such tables, so
a dossier of any size costs its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: settled and blocking states, states of review in their order.
SETTLED = ("confirmed", "not_applicable")
ON_HOLD = ("BLOCKED", "REVIEW_REQUIRED")
REVIEWS = ("unreviewed", "ai_checked", "human_reviewed")
# ---- End of the fixed values.


def claims(closure: DataFrame, dossier: str, item: str) -> DataFrame:
    """(item, dossier, claimants): the first dossier in order has an item; others that reach it are in conflict."""
    found = closure.groupBy(item).agg(F.min(dossier).alias(dossier), F.countDistinct(dossier).alias("claimants"))
    return found.select(item, dossier, "claimants")


def shown_on(closure: DataFrame, publishable: DataFrame, dossier: str, item: str) -> DataFrame:
    """(item, dossier): the dossier that is shown on an item; of several that may be, the last in order."""
    may = publishable.select(F.col(dossier).alias("_d"))
    return closure.join(may, F.col(dossier) == F.col("_d"), "left_semi").groupBy(item).agg(F.max(dossier).alias(dossier))


def values_in(closure: DataFrame, facts: DataFrame, dossier: str, item: str, value: str) -> DataFrame:
    """(dossier, values): the sorted distinct values that a dossier's items have; dossiers without any are missing.

    Values are made distinct before they are collected: a row holds as many as there are values.
    """
    rows = closure.select(dossier, F.col(item).alias("_i")).join(facts.select(item, value), F.col("_i") == F.col(item))
    rows = rows.where(F.col(value).isNotNull()).select(dossier, value).distinct()
    return rows.groupBy(dossier).agg(F.array_sort(F.collect_list(value)).alias("values"))


def page_status(closure: DataFrame, records: DataFrame, item: str, dossier: str, number: str, target: str, effective: str) -> DataFrame:
    """For each item the dates of its own instrument within its dossier: (item, effective_dates, pending).

    Records of the dossier with the same number and target count; one without a date leaves it pending.
    """
    own = closure.select(dossier, F.col(item).alias("_i")).join(records, F.col("_i") == F.col(item)).where(F.col(number).isNotNull())
    status = own.groupBy(dossier, number, target).agg(F.array_sort(F.collect_set(effective)).alias("effective_dates"), F.max(F.col(effective).isNull()).alias("pending"))
    status = status.select(*[F.col(c).alias(f"_{c}") for c in (dossier, number, target)], "effective_dates", "pending")
    met = (F.col(dossier) == F.col(f"_{dossier}")) & (F.col(number) == F.col(f"_{number}")) & F.col(target).eqNullSafe(F.col(f"_{target}"))
    return own.join(status, met).select(item, dossier, "effective_dates", "pending")


def open_categories(facts: DataFrame, dossier: str, category: str, status: str, critical: Sequence[str]) -> DataFrame:
    """(dossier, gaps): critical categories without a settled fact, or with one that isn't settled; all dossiers that have facts."""
    settled = F.col(status).isin(*SETTLED)
    marks = [F.struct(F.lit(c).alias("c"), (F.coalesce(F.max((F.col(category) == c) & settled), F.lit(False)) & ~F.coalesce(F.max((F.col(category) == c) & ~F.coalesce(settled, F.lit(False))), F.lit(False))).alias("ok")) for c in critical]
    found = facts.groupBy(dossier).agg(F.array(*marks).alias("m"))
    return found.select(dossier, F.transform(F.filter("m", lambda x: ~x["ok"]), lambda x: x["c"]).alias("gaps"))


def review_of(section: Column, base: Column, reviewed_at: Column, verified_at: Column) -> Column:
    """The state that counts: a section's own, else the whole's; a person's review only from the last verification on."""
    known = lambda c: F.when(c.isin(*REVIEWS), c)
    state = F.coalesce(known(F.coalesce(section, base)), F.lit(REVIEWS[0]))
    current = F.coalesce(reviewed_at >= verified_at, F.lit(False))
    return F.when((state == REVIEWS[2]) & ~current, REVIEWS[1]).otherwise(state)


def _rank(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in REVIEWS]), F.coalesce(state, F.lit(REVIEWS[0])))


def visible(reviews: Mapping[str, Column], policy: Mapping[str, str]) -> Column:
    """Categories whose state reaches what the policy asks for."""
    return F.array_compact(F.array(*[F.when(_rank(state) >= _rank(F.lit(policy.get(name, REVIEWS[2]))), F.lit(name)) for name, state in reviews.items()]))


def gate(status: Column, has_state: Column, required: Column, gaps: Column, hold: Column, form: Column, stage: Column, form_stages: Mapping[str, Sequence[str]], seed: Column, related: Column) -> Column:
    """What stands against publication, in order; nothing does where a dossier isn't published."""
    allowed = reduce(lambda out, f: F.when(form == f, stage.isin(*form_stages[f])).otherwise(out), form_stages, F.lit(False))
    reasons = {
        "facts": F.size(gaps) > 0, "hold": hold.isin(*ON_HOLD), "form": form.isNotNull() & stage.isNotNull() & ~allowed,
        "seed": seed.isNotNull() & (F.size(related) > 0) & ~F.array_contains(related, seed),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()]))
    none = F.array().cast("array<string>")
    return F.when(status != "published", none).when(has_state, found).when(required, F.array(F.lit("case file"))).otherwise(none)


def uncited(facts: DataFrame, sources: DataFrame, cited: DataFrame, fact: str, dossier: str, source: str, url: str) -> DataFrame:
    """Facts none of whose sources' URLs is cited by their dossier; facts without sources say nothing."""
    of = sources.select(F.col(source).alias("_s"), F.col(url).alias("_u"))
    known = cited.select(F.col(dossier).alias("_d"), F.col(url).alias("_c")).distinct()
    rows = facts.join(of, F.col(source) == F.col("_s"), "left")
    rows = rows.join(known, (F.col(dossier) == F.col("_d")) & (F.col("_u") == F.col("_c")), "left")
    return rows.groupBy(dossier, fact).agg(F.max(F.col("_c").isNotNull()).alias("_any")).where("NOT _any").drop("_any")


def packets(queue: DataFrame, closure: DataFrame, records: DataFrame, seed: str, count: str, dossier: str, item: str, text: str, most: int) -> DataFrame:
    """A row for each record of a queued seed's closure, texts cut to ``most`` and marked; ``problem`` says why a seed gives none.

    A seed that is queued twice, unknown, or whose closure has another size than was queued gives one row with its problem.
    """
    asked = queue.groupBy(seed).agg(F.count("*").alias("_times"), F.max(count).alias("_expected"))
    of_seed = closure.select(F.col(item).alias("_m"), F.col(dossier).alias("_of"))
    sizes = closure.groupBy(dossier).agg(F.count("*").alias("_size")).withColumnRenamed(dossier, "_sd")
    known = asked.join(of_seed, F.col(seed) == F.col("_m"), "left").join(sizes, F.col("_of") == F.col("_sd"), "left")
    problem = F.when(F.col("_times") > 1, "duplicate").when(F.col("_of").isNull(), "unknown").when(F.col("_size") != F.col("_expected"), "count")
    known = known.select(seed, "_of", problem.alias("problem"))
    good = known.where("problem IS NULL").join(closure.select(F.col(dossier).alias("_cd"), item), F.col("_of") == F.col("_cd"))
    good = good.join(records.select(F.col(item).alias("_r"), F.col(text).alias("_t")), F.col(item) == F.col("_r"), "left")
    cut = good.select(seed, item, F.substring("_t", 1, most).alias(text), (F.coalesce(F.length("_t"), F.lit(0)) > most).alias("truncated"), "problem")
    bad = known.where("problem IS NOT NULL").select(seed, F.lit(None).cast(closure.schema[item].dataType).alias(item), F.lit(None).cast("string").alias(text), F.lit(False).alias("truncated"), "problem")
    return cut.union(bad)


def named_in(text: Column, label: str, markers: Mapping[str, Sequence[str]]) -> Column:
    """Sorted names whose markers stand in a text after a label; none without the label."""
    after = F.when(text.contains(label), F.substring(text, F.instr(text, label) + F.lit(len(label)), F.length(text)))
    return F.array_sort(F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [after.contains(m) for m in marks]), F.lit(name)) for name, marks in markers.items()])))


def only_one(name: Column, host: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """The one rule (result, marks of the name, domains of the host) that holds; null if none or several do."""
    under = lambda domain: (host == domain) | host.endswith("." + domain)
    hits = [F.when(reduce(lambda a, b: a | b, [name.contains(m) for m in marks]) & reduce(lambda a, b: a | b, [under(d) for d in domains]), F.lit(result)) for result, marks, domains in rules]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) == 1, found[0])
