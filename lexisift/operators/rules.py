"""Rules over texts: what a rule is, and evaluating many rules in one pass over the rows.

Every rule becomes one column of spans; a row's results are an array with an entry per rule that fired, so evaluation and
everything that follows from it (verdicts, correlation, actions) needs no shuffle. Rules are validated before any job runs.

Order: the length-only check, else language, least length, exclusions, then patterns: in mode ``any`` the first pattern with
hits alone counts, in mode ``all`` every pattern must have some. Then the checksum filter and the cap on matches. Texts that
are null give null results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.rows import exploded
from lexisift.functions.text import luhn, unicode_form

from . import spans as sp
from .output_probes import CHECKERS, OVERSIZED
from .probes import probe

SEVERITIES = ("P0", "P1", "P2")
ACTIONS = ("block", "warn", "redact", "clean", "truncate", "soft_allow", "dynamic")
PATTERN_TYPES = ("regex", "keyword", "entropy", "composite")
#: Rules that see the text as it came (fixed values).
RAW_RULES = ("I-29", "I-32", "I-44")


@dataclass(frozen=True)
class Pattern:
    type: str
    value: str
    confidence: float = 1.0
    min_length: int | None = None
    sub_patterns: tuple["Pattern", ...] = ()

    def __post_init__(self) -> None:
        if self.type not in PATTERN_TYPES:
            raise ValueError(f"unknown pattern type {self.type}")
        if not 0 <= self.confidence <= 8:
            raise ValueError("confidence outside 0..8")
        if self.type == "keyword" and not self.value:
            raise ValueError("empty keyword")
        if self.type == "entropy" and (self.min_length or 12) < 3:
            raise ValueError("entropy patterns need a length of 3 or more")
        if self.type == "composite" and not self.sub_patterns:
            raise ValueError("composite pattern without parts")
        if self.type == "regex":
            try:
                re.compile(self.value)
            except re.error as e:
                raise ValueError(f"invalid pattern {self.value!r}: {e}") from e

    @property
    def negative(self) -> bool:
        return self.confidence == 0.0 or self.value.startswith("!")


@dataclass(frozen=True)
class Boost:
    rules: tuple[str, ...]
    severity: str
    window: int = 500


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str = "P2"
    action: str = "warn"
    patterns: tuple[Pattern, ...] = ()
    mode: str = "any"
    category: str = "general"
    stages: tuple[str, ...] = ("input",)
    enabled: bool = True
    max_matches: int = 10
    min_length: int | None = None
    exclusions: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    max_length: int | None = None
    no_pattern: bool = False
    redact_template: str | None = None
    luhn_check: bool = False
    form: str | None = None
    links: tuple[str, ...] = ()
    boost: Boost | None = None
    reductions: dict[str, str] = field(default_factory=dict)
    session_threshold: int | None = None
    pollution_of: tuple[str, ...] = ()
    admin_alert: bool = False
    compliance_audit: bool = False
    gdpr_audit: bool = False

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Z]+-\d{2,3}", self.id):
            raise ValueError(f"invalid rule id {self.id}")
        if not 1 <= len(self.name) <= 200:
            raise ValueError("a name has 1 to 200 characters")
        if self.severity not in SEVERITIES or self.action not in ACTIONS:
            raise ValueError(f"{self.id}: unknown severity or action")
        if self.severity == "P0" and self.action not in ("block", "redact", "warn"):
            raise ValueError(f"{self.id}: a P0 rule blocks, redacts or warns")
        if self.severity == "P2" and self.action == "block":
            raise ValueError(f"{self.id}: a P2 rule doesn't block")
        if not 1 <= self.max_matches <= 1000 or self.mode not in ("any", "all"):
            raise ValueError(f"{self.id}: max_matches is 1..1000, mode any or all")


class RuleBook:
    """The rules by id, in the order of their severities and then as given."""

    def __init__(self, rules: list[Rule] = ()):
        self._rules: dict[str, Rule] = {}
        self.replace_all(rules)

    def replace_all(self, rules: list[Rule]) -> int:
        self._rules = {r.id: r for r in rules}
        return len(self._rules)

    def add(self, *rules: Rule) -> None:
        self._rules = self._rules | {r.id: r for r in rules}

    def remove(self, rule_id: str) -> bool:
        return self._rules.pop(rule_id, None) is not None

    def enable(self, rule_id: str, enabled: bool = True) -> None:
        if rule_id not in self._rules:
            raise ValueError(f"unknown rule {rule_id}")
        self._rules[rule_id] = replace(self._rules[rule_id], enabled=enabled)

    def get(self, rule_id: str) -> Rule | None:
        return self._rules.get(rule_id)

    def __len__(self) -> int:
        return len(self._rules)

    def all(self) -> list[Rule]:
        return list(self._rules.values())

    def by(self, **is_: str) -> list[Rule]:
        return [r for r in self._rules.values() if all(getattr(r, k) == v for k, v in is_.items())]

    def for_stage(self, stage: str) -> list[Rule]:
        own = [r for r in self._rules.values() if r.enabled and stage in r.stages]
        return sorted(own, key=lambda r: SEVERITIES.index(r.severity))

    def count_by_severity(self) -> dict[str, int]:
        return {s: sum(r.severity == s for r in self._rules.values()) for s in SEVERITIES}


def pattern_spans(p: Pattern, c: Column, limit: int) -> Column:
    if p.type == "entropy":
        return sp.entropy_spans(c, p.confidence, p.min_length or 12, limit)
    if p.type == "composite":
        mode, distance = sp.mode_of(p.value)
        parts = [(pattern_spans(x, c, limit), not x.negative) for x in p.sub_patterns]
        if mode == "or":
            return sp.first_of(parts)
        if mode == "not":
            return sp.unless(parts[0][0], [x for x, _ in parts[1:]])
        yes, no = [x for x, ok in parts if ok], [x for x, ok in parts if not ok]
        if not yes:
            return sp.none()
        return sp.near(yes, distance, no) if mode == "near" else sp.all_of(yes, no, limit)
    if p.confidence > 1:  # such a pattern never matches: a match's confidence is at most 1
        return F.when(c.isNull(), F.lit(None).cast(sp.SPANS)).otherwise(sp.none())
    return sp.regex_spans(c, p.value, limit) if p.type == "regex" else sp.keyword_spans(c, p.value, limit)


RESULT = "struct<ord:int,rule_id:string,name:string,severity:string,action:string,pattern_idx:int,spans:array<struct<start_pos:int,end_pos:int,matched:string>>>"


def _text_of(rule: Rule, c: Column, raw: Column) -> Column:
    if rule.id in RAW_RULES:
        return raw
    return unicode_form(c, rule.form) if rule.form in ("NFC", "NFD", "NFKC", "NFKD") else c


def checked(rule: Rule, c: Column, hits: Column | None) -> Column | None:
    """Spans of the rule's own checker, if it has one."""
    if rule.id == "I-43":
        note = F.concat(F.lit("Content length "), F.length(c).cast("string"), F.lit(f" exceeds {OVERSIZED} character limit"))
        span = F.struct(F.lit(0).alias("start_pos"), F.least(F.length(c), F.lit(200)).alias("end_pos"), note.alias("matched"))
        return F.when(F.length(c) > OVERSIZED, F.array(span)).otherwise(sp.none())
    if rule.id not in CHECKERS or hits is None:
        return None
    own = F.transform(F.filter(hits, lambda h: h["rule_id"] == rule.id), lambda h: F.struct(h["start_pos"].alias("start_pos"), h["end_pos"].alias("end_pos"), h["matched"].alias("matched")))
    return F.slice(own, 1, rule.max_matches)


def rule_result(rule: Rule, order: int, c: Column, each: list[Column], language: Column | None, certainty: Column | None, checker: Column | None = None) -> Column:
    """The rule's result as a struct, null where it doesn't fire. each: the spans of its patterns; those of its checker come first."""

    def result(idx: Column, found: Column) -> Column:
        return F.struct(F.lit(order).alias("ord"), F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("name"), F.lit(rule.severity).alias("severity"), F.lit(rule.action).alias("action"), idx.cast("int").alias("pattern_idx"), found.alias("spans"))

    nothing = F.lit(None).cast(RESULT)
    if rule.no_pattern:
        if rule.max_length is None:
            return nothing
        return F.when(F.length(c) > rule.max_length, result(F.lit(0), sp.none())).otherwise(nothing)
    if not rule.patterns and checker is None:
        return nothing
    valid = (lambda s: F.filter(s, lambda x: luhn(x["matched"]))) if rule.luhn_check else (lambda s: s)
    if not rule.patterns:
        found, idx = valid(checker), F.lit(0)
    elif rule.mode == "all":
        found = valid(sp.all_of(each, limit=rule.max_matches))
        idx = F.lit(0)
    else:  # the first pattern with hits decides, even if its hits fail the checksum
        hits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), s.alias("s")) for i, s in enumerate(each)]), lambda x: F.size(x["s"]) > 0)
        first = F.get(hits, 0)
        found, idx = valid(first["s"]), first["i"]
    if checker is not None and rule.patterns:
        idx = F.when(F.size(checker) > 0, 0).otherwise(idx)
        found = F.slice(F.concat(valid(checker), F.coalesce(found, sp.none())), 1, rule.max_matches)
    admitted = F.lit(True)
    if rule.min_length is not None:
        admitted = admitted & (F.length(c) >= rule.min_length)
    for x in rule.exclusions:
        try:
            re.compile(x)
        except re.error:
            continue  # an invalid exclusion excludes nothing
        admitted = admitted & ~c.rlike(sp.java(x, ignore_case=False))
    if rule.languages and language is not None:
        sure = certainty >= 0.3 if certainty is not None else F.lit(True)
        admitted = admitted & (language.isNull() | ~sure | language.isin(list(rule.languages)))
    return F.when(admitted & (F.size(found) > 0), result(idx, found)).otherwise(nothing)


def evaluate(df: DataFrame, rules: list[Rule], text: str, raw: str | None = None, language: str | None = None, certainty: str | None = None, into: str = "results") -> DataFrame:
    """df with an array of the results of the rules that fired, in the order of the rules.

    The spans of all patterns are one column of their own, so that each pattern runs once however often it is referred to.
    """
    c, r = F.col(text), F.col(raw or text)
    lang = F.col(language) if language else None
    sure = F.col(certainty) if certainty else None
    active = [(i, x) for i, x in enumerate(rules) if x.enabled]
    every = [pattern_spans(p, _text_of(x, c, r), x.max_matches) for _, x in active if not x.no_pattern for p in x.patterns]
    found = F.array(*every) if every else F.array().cast(f"array<{sp.SPANS}>")
    df = df.withColumn("_found", found)
    packs = [p for _, x in active if not x.no_pattern for p in CHECKERS.get(x.id, ())]
    hits = F.col("_checked") if packs else None
    if packs:  # the checkers of all rules in one pass
        df = probe(df, text, packs, adjust=True, into="_checked")
    each, at = [], 0
    for i, x in active:
        n = 0 if x.no_pattern else len(x.patterns)
        each.append(rule_result(x, i, c, [F.get("_found", k) for k in range(at, at + n)], lang, sure, None if x.no_pattern else checked(x, c, hits)))
        at += n
    fired = F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast(f"array<{RESULT}>")
    return df.withColumn(into, F.when(c.isNotNull(), fired)).drop("_found", "_checked")


def matches(evaluated: DataFrame, key: str, results: str = "results") -> DataFrame:
    """One row per match: (key, rule_id, pattern_idx, match_no, start_pos, end_pos, matched)."""
    r = exploded(evaluated, results, "r", key)
    m = exploded(r, "r.spans", "s", key, "r.rule_id", "r.pattern_idx", position="match_no")
    return m.select(key, "rule_id", "pattern_idx", "match_no", "s.start_pos", "s.end_pos", F.substring("s.matched", 1, 200).alias("matched"))
