"""Nested documents held against declared rules: a sorted list of what is wrong and where, as one expression.

Rules are conditions by name; a rule over an array names the element's place.  Case files, ledgers of sources and of the
facts drawn from them, are one such set of rules (:func:`case_file_problems`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import strict_date

# ---- Fixed values: what a case file may say.
VERSION = 1
DOSSIER, SEED, SOURCE, FACT, SHA = "^[a-z0-9]+(-[a-z0-9]+)*$", "^raw-[0-9a-f]{16}$", "^s[0-9]{1,3}$", "^f[0-9]{1,3}$", "^[0-9a-f]{64}$"
KINDS = ("new", "update")
HOLDS, RELEASES = ("BLOCKED", "RETRY_WAIT", "REVIEW_REQUIRED"), ("official_records_change", "date", "manual")
SOURCE_KINDS = ("gazette", "egov_law", "egov_public_comment", "diet", "ministry", "self_regulatory", "other_official")
SOURCE_STATES = ("fetched", "failed", "not_fetched")
FETCH_ERRORS = (
    "transient_network", "http_429", "http_5xx", "http_4xx", "blocked_or_waf", "js_required", "too_large", "empty_or_scanned", "non_official_url", "parse_error",
)
CATEGORIES = (
    "instrument_form", "promulgation_date", "effective_date", "partial_effective_date", "amended_provisions", "old_vs_new", "scope", "obligation_type",
    "transitional_measures", "delegation", "policy_background", "business_impact",
)
INFERRED = ("policy_background", "business_impact")
FACT_STATES = ("confirmed", "not_applicable", "unconfirmed", "inference")
FORMS = ("bill", "enacted_act", "promulgated_instrument", "in_force_instrument", "draft_instrument", "guideline")
DUTIES = ("obligation", "prohibition", "effort_duty", "recommendation", "none")
MOST = {"sources": 40, "facts": 60, "next_action": 600, "reason": 800, "excerpt": 1500, "statement": 1500, "quote": 600}
OFFICIAL = r"^https://([a-z0-9-]+\.)*(go\.jp|lg\.jp|courts\.go\.jp|shugiin\.go\.jp|sangiin\.go\.jp|jpx\.co\.jp|jsda\.or\.jp)(/.*)?$"
# ---- End of the fixed values.

#: A case file's JSON; what has another type is read as missing.
CASE_FILE = (
    "schema_version int, dossier_id string, kind string, seed_item_id string, stage string, next_action string,"
    " hold struct<state: string, reason: string, unblock_condition: string, retry_after: string>,"
    " sources array<struct<id: string, url: string, kind: string, status: string, attempts: int, sha256: string, fetched_at: string, error_class: string, last_attempt_at: string, excerpt: string, version: struct<as_of: string>>>,"
    " facts array<struct<id: string, category: string, status: string, statement: string, quote: string, source_ids: array<string>, value: string, values: array<string>>>, unresolved array<string>"
)
Check = Callable[[Column], Column]


def problems(checks: Mapping[str, Column]) -> Column:
    """The names of the conditions that hold, in their order; a condition without an answer doesn't hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def problems_in(items: Column, name: str, checks: Mapping[str, Check]) -> Column:
    """The same for each element of an array, as "name[place].check"; missing elements are problems themselves."""
    at = lambda i, rest: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"), rest)
    own = lambda x: F.when(x.isNull(), F.array(F.lit(""))).otherwise(problems({f".{n}": check(x) for n, check in checks.items()}))
    return F.flatten(F.transform(F.coalesce(items, F.array()), lambda x, i: F.transform(own(x), lambda p: at(i, p))))


def not_in(value: Column, allowed) -> Column:
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def unlike(value: Column, pattern: str) -> Column:
    return ~F.coalesce(value.rlike(pattern), F.lit(False))


def no_date(value: Column) -> Column:
    """A value that is there but is no date."""
    return value.isNotNull() & strict_date(value).isNull()


def no_text(value: Column, most: int, required: bool = True) -> Column:
    """Blank (or missing, if required) or longer than ``most``."""
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    return (blank if required else value.isNotNull() & blank) | (F.length(value) > most)


def repeated(items: Column, of: Check) -> Column:
    """Values that several elements have."""
    values = F.filter(F.transform(F.coalesce(items, F.array()), of), lambda v: v.isNotNull())
    return F.array_distinct(F.filter(values, lambda v: F.size(F.filter(values, lambda w: w == v)) > 1))


def case_file_problems(doc: Column, name: Column) -> Column:
    """What is wrong with a case file (a struct of ``CASE_FILE``) that is stored under a name."""
    sources, facts, hold = doc["sources"], doc["facts"], doc["hold"]
    instant = lambda t: F.try_to_timestamp(t).isNull() | unlike(t, "T")
    retry, confirmed = hold["retry_after"], lambda f: f["status"] == "confirmed"
    whole = problems({
        "schema_version": F.coalesce(doc["schema_version"] != VERSION, F.lit(True)), "dossier_id": ~F.coalesce(doc["dossier_id"] == name, F.lit(False)) | unlike(name, DOSSIER), "kind": not_in(doc["kind"], KINDS),
        "seed_item_id": doc["seed_item_id"].isNotNull() & unlike(doc["seed_item_id"], SEED), "stage": doc["stage"].isNotNull(), "next_action": no_text(doc["next_action"], MOST["next_action"], False),
        "sources": F.size(sources) > MOST["sources"], "facts": F.size(facts) > MOST["facts"], "unresolved": F.exists(doc["unresolved"], lambda u: F.trim(F.coalesce(u, F.lit(""))) == ""),
    })
    held = F.when(hold.isNotNull(), problems({
        "hold.state": not_in(hold["state"], HOLDS), "hold.reason": no_text(hold["reason"], MOST["reason"]), "hold.unblock_condition": not_in(hold["unblock_condition"], RELEASES), "hold.retry_after": no_date(retry),
        "hold.retry_after missing": retry.isNull() & ((hold["unblock_condition"] == "date") | (hold["state"] == "RETRY_WAIT")),
    })).otherwise(F.array().cast("array<string>"))
    twice_source, twice_fact = repeated(sources, lambda s: s["id"]), repeated(facts, lambda f: f["id"])
    of_sources = problems_in(sources, "sources", {
        "id": lambda s: unlike(s["id"], SOURCE) | F.array_contains(twice_source, s["id"]), "url": lambda s: unlike(s["url"], OFFICIAL), "kind": lambda s: not_in(s["kind"], SOURCE_KINDS),
        "status": lambda s: not_in(s["status"], SOURCE_STATES), "attempts": lambda s: s["attempts"] < 0,
        "sha256": lambda s: (s["status"] == "fetched") & unlike(s["sha256"], SHA), "fetched_at": lambda s: (s["status"] == "fetched") & instant(s["fetched_at"]),
        "error_class": lambda s: ((s["status"] == "fetched") & s["error_class"].isNotNull()) | ((s["status"] == "failed") & not_in(s["error_class"], FETCH_ERRORS)),
        "last_attempt_at": lambda s: (s["status"] == "failed") & instant(s["last_attempt_at"]), "excerpt": lambda s: no_text(s["excerpt"], MOST["excerpt"], False), "version.as_of": lambda s: no_date(s["version"]["as_of"]),
    })
    source_of = lambda i: F.filter(F.coalesce(sources, F.array()), lambda s: s["id"] == i)
    of_facts = problems_in(facts, "facts", {
        "id": lambda f: unlike(f["id"], FACT) | F.array_contains(twice_fact, f["id"]), "category": lambda f: not_in(f["category"], CATEGORIES), "status": lambda f: not_in(f["status"], FACT_STATES),
        "statement": lambda f: no_text(f["statement"], MOST["statement"]), "quote": lambda f: no_text(f["quote"], MOST["quote"], False),
        "source_ids unknown": lambda f: F.exists(f["source_ids"], lambda i: F.size(source_of(i)) == 0),
        "source_ids not fetched": lambda f: confirmed(f) & F.exists(f["source_ids"], lambda i: F.exists(source_of(i), lambda s: ~F.coalesce(s["status"] == "fetched", F.lit(False)))),
        "source_ids missing": lambda f: confirmed(f) & (F.size(F.coalesce(f["source_ids"], F.array().cast("array<string>"))) == 0),
        "inference": lambda f: (f["status"] == "inference") & not_in(f["category"], INFERRED), "value": lambda f: confirmed(f) & (f["category"] == "instrument_form") & not_in(f["value"], FORMS),
        "values": lambda f: confirmed(f) & (f["category"] == "obligation_type") & (F.coalesce(F.size(f["values"]) < 1, F.lit(True)) | F.exists(f["values"], lambda v: not_in(v, DUTIES))),
    })
    return reduce(lambda a, b: F.concat(a, b), [whole, held, of_sources, of_facts])
