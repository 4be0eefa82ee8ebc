"""English titles for Japanese notices by rule: a subject, its topic, a prefix by source and stage, safe titles for the rest.

All tables are ordered rules and the first that holds counts; a title is one projection without Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rule, contains_any, first_match

# ---- Fixed values: results depend on each entry and on their order.
MOST_CHARS, LEAST_CHARS = 120, 72
JAPANESE = "[぀-ヿㇰ-ㇿｦ-ﾟ㐀-䶿一-鿿]"
SUBJECT_ENDS = (
    "に対する意見募集及び公聴会", "に対する意見募集", "に関する御意見の募集", "に関する意見・情報の募集", "についての意見・情報の募集", "に係る意見の募集",
    "に関する意見の募集", "に関する意見募集", "への意見募集", "の公表について", "について公表しました",
)
TRAILING = ("について", "を掲載しました。", "を掲載しました", "を公表しました。", "を公表しました", "公表しました。", "公表しました")
QUOTES = ("「」", "『』", '""', "''")
AMENDED, REVISED = ("一部改正", "一部を改正", "改正案"), ("改訂案", "変更案")
DRAFT = ("（案）", "(案)", "改正案", "案等", "案）", "案に", "案及び", "案又は")
RULES = ("指針", "ガイドライン", "規程")
LEAKS = ("漏えい", "漏洩")
#: Topics that stand as they are, whatever the title says of drafts.
WHOLE_TOPICS = (
    "Cabinet Decision", "Response to", "Market Survey", "Cease-and-Desist", "Enforcement Status", "Revocation", "IOSCO", "MOU", "Bills Submitted",
    "RegTech", "Revision to", "Local Government", "Permission for", "Compliance Reports", "White Papers", "Working Group", "Decision Changing", "Special Review",
)
NTA, SESC, JSDA = ("NTA", "National Tax Agency"), ("Securities and Exchange Surveillance Commission", "SESC"), ("Japan Securities Dealers Association", "JSDA")
COURTS, JPX = ("Courts in Japan",), ("Japan Exchange Group", "Tokyo Stock Exchange")
PMDA, DIET, EGOV_LAW = ("PMDA", "Pharmaceuticals and Medical Devices Agency"), ("House of Representatives", "衆議院"), ("e-Gov Law Search",)
FSA, MHLW = ("Financial Services Agency", "金融庁", "FSA"), ("Ministry of Health", "厚生労働省", "MHLW")
#: Marks of the source's name (none: any source), beginning of the stage, words of the title (one of them), prefix.
PREFIXES = (
    (NTA, "Public Comment", (), "NTA Public Comment"),
    (NTA, "", (), "NTA Update"),
    (SESC, "Enforcement Action", (), "SESC Enforcement Action"),
    (SESC, "", (), "SESC Update"),
    (JSDA, "Public Comment Results Published", (), "JSDA Public Comment Results"),
    (JSDA, "", (), "JSDA Public Comment"),
    (COURTS, "", (), "Supreme Court Decision"),
    (JPX, "Public Comment", (), "JPX Public Comment"),
    (JPX, "", (), "JPX Rule Revision"),
    (PMDA, "", (), "PMDA Safety Update"),
    (DIET, "", (), "Diet Bill Update"),
    (EGOV_LAW, "", (), "e-Gov Law Update"),
    (("公正取引委員会", "JFTC"), "Public Comment", (), "JFTC Public Comment"),
    (("公正取引委員会", "JFTC"), "", (), "JFTC Update"),
    (("個人情報保護委員会", "PPC"), "", (), "PPC Update"),
    (("消費者庁", "CAA"), "", (), "CAA Update"),
    (("経済産業省", "METI"), "", ("エネルギー", "電力", "ガス", "GX", "脱炭素", "カーボン"), "METI Energy Update"),
    (("経済産業省", "METI"), "", (), "METI Update"),
    (("国土交通省", "MLIT"), "Public Comment", (), "MLIT Public Comment"),
    (("国土交通省", "MLIT"), "", (), "MLIT Update"),
    (("農林水産省", "MAFF"), "Public Comment", (), "MAFF Public Comment"),
    (("農林水産省", "MAFF"), "", (), "MAFF Update"),
    (FSA, "", (), "FSA Update"),
    (MHLW, "", (), "MHLW Update"),
    (("Digital Agency", "デジタル庁"), "", (), "Digital Agency Update"),
    (("法務省", "MOJ"), "", (), "MOJ Update"),
    (("環境省", "MOE"), "", (), "MOE Update"),
    (("財務省", "MOF"), "", (), "MOF Update"),
    (("総務省", "MIC"), "", (), "MIC Update"),
    ((), "Public Comment Results Published", (), "Public Comment Results"),
    ((), "Public Comment Closed", (), "Closed Public Comment"),
    ((), "Public Comment Open", (), "Public Comment"),
    ((), "Draft Guideline", (), "Draft Guideline"),
)
PREFIX = "Japanese Regulatory Update"
#: Stage, and a safe title after the prefix of a consultation.
CONSULTATIONS = (
    ("Public Comment Open", ": Regulatory proposal open for comment"),
    ("Public Comment Results Published", " Results: Regulatory comment results published"),
    ("Public Comment Closed", " Closed: Regulatory comment period closed"),
)
LABELS = (
    (NTA, "NTA"), (SESC, "SESC"), (JSDA, "JSDA"), (COURTS, "Supreme Court"), ((*JPX, "JPX"), "JPX"), (PMDA, "PMDA Safety"), (DIET, "Diet Bill"),
    (EGOV_LAW, "e-Gov Law"), (("JFTC",), "JFTC"), (("PPC",), "PPC"), (("CAA",), "CAA"), (("METI",), "METI"), (("MLIT",), "MLIT"), (("MAFF",), "MAFF"),
    (("FSA", "Financial Services Agency"), "FSA"), (("MHLW", "Ministry of Health"), "MHLW"), (("Digital Agency",), "Digital Agency"), (("MOJ",), "MOJ"),
    (("MOE",), "MOE"), (("MOF",), "MOF"), (("MIC",), "MIC"), (("e-Gov",), "e-Gov Public Comment"),
)
LABEL, NO_AREA = "Japanese Regulatory", "Japanese regulatory matters"
# ---- End of the fixed values.


def _hit(source: Column, stage: Column, title: Column, marks: Sequence[str], begins: str, words: Sequence[str]) -> Column:
    """Whether a rule's three parts hold; empty ones always do."""
    tests = [contains_any(source, marks)] * bool(marks) + [stage.startswith(begins)] * bool(begins) + [contains_any(title, words)] * bool(words)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def by_rules(source: Column, stage: Column, title: Column, rules: Sequence[tuple], default: str | None) -> Column:
    """What the first rule (marks, stage's beginning, words, result) gives that holds."""
    return reduce(lambda out, r: F.when(_hit(source, stage, title, *r[:3]), F.lit(r[3])).otherwise(out), reversed(rules), F.lit(default))


def capped(title: Column, most: int = MOST_CHARS, least: int = LEAST_CHARS) -> Column:
    """At most ``most`` characters; a longer title ends in three stops, after a whole word if that leaves ``least``."""
    head = F.rtrim(F.substring(title, 1, most - 3))
    words = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(title) <= most, title).otherwise(F.concat(F.when(F.length(words) >= least, F.rtrim(words)).otherwise(head), F.lit("...")))


def unquoted(text: Column, depth: int = 4) -> Column:
    """Without the quotation marks around the whole, ``depth`` pairs of them, and without blanks at the ends."""
    pairs = "|".join(f"^{a}(.*){b}$" for a, b in QUOTES)
    groups = "".join(f"${i + 1}" for i in range(len(QUOTES)))
    return reduce(lambda t, _: F.trim(F.regexp_replace(t, f"(?s){pairs}", groups)), range(depth), F.trim(text))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def subject(title: Column) -> Column:
    """What a notice's title is about: what comes before the words of its kind, or what it quotes if it announces a page."""

    def named(text: Column) -> Column:
        quoted = F.regexp_extract(text, "^「([^」]+)」", 1)
        before = reduce(lambda out, m: F.when(text.contains(m), F.substring_index(text, m, 1)).otherwise(out), reversed(SUBJECT_ENDS), text)
        return F.when((quoted != "") & contains_any(text, ("掲載", "ページ")), quoted).otherwise(before)

    text = unquoted(_let(F.trim(F.regexp_replace(F.trim(title), r"^[（(]\s*受付終了\s*[）)]", "")), named))
    for phrase in TRAILING:
        text = F.trim(F.regexp_replace(text, re.escape(phrase) + r"\z", ""))
    return F.regexp_replace(F.regexp_replace(unquoted(text), r"\s+", " "), "^[ 。]+|[ 。]+$", "")


def subject_title(about: Column, title: Column, topics: Sequence[Rule]) -> Column:
    """The subject in English where a topic is known, with what kind of draft it is; else with its Japanese name."""
    amended, revised, draft = contains_any(about, AMENDED), contains_any(about, REVISED), contains_any(about, DRAFT)

    def known(topic: Column) -> Column:
        whole = topic.endswith("Updated") | reduce(lambda a, b: a | b, [topic.startswith(x) for x in WHOLE_TOPICS])
        kinds = [
            (whole, topic), (title.contains("閣議決定"), F.concat(F.lit("Cabinet Decision on "), topic)), (contains_any(title, LEAKS), topic),
            (title.contains("更新"), F.concat(topic, F.lit(" Updated"))), (revised, F.concat(F.lit("Draft Revision to "), topic)),
            (amended, F.concat(F.lit("Draft Amendment to "), topic)), (draft, F.concat(F.lit("Draft "), topic)),
        ]
        others = [(amended, "Draft Amendment to "), (revised, "Draft Revision to "), (draft & contains_any(about, RULES), "Draft Guidelines or Rules: ")]
        unknown = reduce(lambda out, k: F.when(k[0], F.concat(F.lit(k[1]), about)).otherwise(out), reversed(others), about)
        return F.when(topic != "", reduce(lambda out, k: F.when(*k).otherwise(out), reversed(kinds), topic)).otherwise(unknown)

    return _let(first_match(F.concat_ws(" ", about, title), topics, ""), known)


def consultation(stage: Column, prefix: str = "Public Comment") -> Column:
    """A safe title for the stages of a consultation; null for others."""
    return reduce(lambda out, c: F.when(stage == c[0], F.lit(prefix + c[1])).otherwise(out), reversed(CONSULTATIONS), F.lit(None).cast("string"))


def english_title(title: Column, source: Column, stage: Column, area: Column, topics: Sequence[Rule] = (), safe: Sequence[tuple] = ()) -> Column:
    """Prefix and subject; a title that still holds Japanese gives way to a safe one.

    ``safe`` has rules like PREFIXES for safe titles (:func:`load_safe`); after them come the stages of a
    consultation, then the source's label with the area.
    """
    prefix = by_rules(source, stage, F.coalesce(title, F.lit("")), PREFIXES, PREFIX)
    label = by_rules(source, stage, F.lit(""), [(marks, "", (), name) for marks, name in LABELS], LABEL)
    topic_of = F.when(F.coalesce(area, F.lit("")).isin("", "Other"), NO_AREA).otherwise(area)
    last = F.concat(label, F.lit(" Update: Regulatory announcement related to "), topic_of)

    def made(prefix: Column, title: Column) -> Column:
        named = _let(subject(title), lambda about: subject_title(about, title, topics))
        apart = ~prefix.contains("Public Comment")
        kind = F.when(apart & (stage == "Public Comment Closed"), "Closed public comment on ").when(apart & (stage == "Public Comment Results Published"), "Public comment results on ").otherwise("")
        return F.concat(prefix, F.lit(": "), kind, named)

    def whole(title: Column) -> Column:
        fallback = F.coalesce(by_rules(source, stage, title, safe, None), consultation(stage), last)
        return _let(_let(prefix, lambda p: made(p, title)), lambda m: F.when(m.rlike(JAPANESE), fallback).otherwise(m))

    return _let(_let(F.coalesce(title, F.lit("")), whole), lambda t: capped(t))
