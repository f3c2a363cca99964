"""From the results of a row's rules to its verdict, and from the verdict to the rewritten text. No shuffle: all of it works
on the array of results within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.rows import exploded
from lexisift.functions.text import clean, severity_rank, surrounding, truncate_at_boundary

from . import spans as sp
from .rules import Rule

TOKEN = "[REDACTED]"


def _rank(x: Column) -> Column:
    return severity_rank(x["severity"])


def _with_severity(r: Column, severity: Column) -> Column:
    return F.struct(r["ord"].alias("ord"), r["rule_id"].alias("rule_id"), r["name"].alias("name"), severity.alias("severity"), r["action"].alias("action"), r["pattern_idx"].alias("pattern_idx"), r["spans"].alias("spans"))


def closest(a: Column, b: Column) -> Column:
    """Distance of two spans: the least of the distances between their ends."""
    return F.least(F.abs(a["end_pos"] - b["start_pos"]), F.abs(b["end_pos"] - a["start_pos"]), F.abs(a["start_pos"] - b["end_pos"]), F.abs(b["start_pos"] - a["end_pos"]))


def _near(others: Column, window: int):
    return lambda s: F.exists(others, lambda o: closest(s, o) <= window)


def correlate(df: DataFrame, rules: list[Rule], results: str = "results") -> DataFrame:
    """Severities after proximity boosts and then reductions, in the order of the rules; adds the links between fired rules."""
    r = F.col(results)
    of = lambda ids: F.flatten(F.transform(F.filter(r, lambda x: x["rule_id"].isin(ids)), lambda x: x["spans"]))
    # whether each boost applies is settled first, outside of the pass over the results
    raised = [F.when(F.exists(F.coalesce(of([x.id]), sp.none()), _near(of(list(x.boost.rules)), x.boost.window)), F.struct(F.lit(x.id).alias("id"), F.lit(x.boost.severity).alias("to"))) for x in rules if x.boost]
    if raised:
        df = df.withColumn("_raised", F.map_from_entries(F.filter(F.array(*raised), lambda x: x.isNotNull())))
        df = df.withColumn(results, F.transform(results, lambda x: _with_severity(x, F.coalesce(F.col("_raised")[x["rule_id"]], x["severity"])))).drop("_raised")
    df = df.withColumn("worst_boosted", F.array_min(F.transform(results, _rank)))
    ids = F.transform(results, lambda r: r["rule_id"])
    pairs = [F.when(F.array_contains(ids, r.id) & F.array_contains(ids, o), F.struct(F.lit(r.id).alias("rule_id"), F.lit(o).alias("linked"))) for r in rules for o in r.links]
    links = F.filter(F.array(*pairs), lambda x: x.isNotNull()) if pairs else F.array().cast("array<struct<rule_id:string,linked:string>>")
    df = df.withColumn("links", links)
    # of the reductions of a rule that fired, the last that makes it less severe holds
    lowered = [F.when(F.array_contains(F.transform(results, lambda x: x["rule_id"]), rule.id), F.struct(F.lit(t).alias("id"), F.lit(s).alias("to"))) for rule in rules for t, s in rule.reductions.items()]
    if lowered:
        df = df.withColumn("_lowered", F.filter(F.array(*lowered), lambda x: x.isNotNull()))

        def least(x: Column) -> Column:
            own = F.filter(F.col("_lowered"), lambda y: y["id"] == x["rule_id"])
            return F.aggregate(own, x["severity"], lambda a, y: F.when(severity_rank(y["to"]) > severity_rank(a), y["to"]).otherwise(a))

        df = df.withColumn(results, F.transform(results, lambda x: _with_severity(x, least(x)))).drop("_lowered")
    return df


def verdict(df: DataFrame, rules: list[Rule], results: str = "results") -> DataFrame:
    """Verdict columns. A boost counts for the overall severity, a reduction doesn't; blocking is decided before either."""
    r = F.col(results)
    first_severity = {x.id: x.severity for x in rules}
    hard = [x.id for x in rules if x.severity == "P0" and x.action in ("block", "redact")]
    flagged = lambda name: [x.id for x in rules if getattr(x, name)]
    fired = lambda ids: F.exists(r, lambda x: x["rule_id"].isin(ids)) if ids else F.lit(False)
    given = F.array_min(F.transform(r, lambda x: severity_rank(F.create_map(*[F.lit(v) for kv in first_severity.items() for v in kv])[x["rule_id"]]))) if rules else F.lit(None)
    worst = F.least(F.lit(2), given, F.col("worst_boosted")) if "worst_boosted" in df.columns else F.least(F.lit(2), given)
    warn = lambda x: F.transform(F.filter(x["spans"], lambda s: s["matched"] != ""), lambda s: F.concat(F.lit("["), x["rule_id"], F.lit("] "), x["name"], F.lit(": "), F.substring(s["matched"], 1, 100)))
    blocked = fired(hard)
    templates = [(x.id, x.redact_template) for x in rules if x.redact_template]
    template = (lambda i: F.create_map(*[F.lit(v) for kv in templates for v in kv])[i]) if templates else (lambda i: F.lit(None).cast("string"))
    return (
        df.withColumn("n_triggered", F.coalesce(F.size(r), F.lit(0)))
        .withColumn("match_count", F.coalesce(F.aggregate(r, F.lit(0), lambda a, x: a + F.size(x["spans"])), F.lit(0)))
        .withColumn("blocked", F.coalesce(blocked, F.lit(False)))
        .withColumn("overall_severity", F.concat(F.lit("P"), worst.cast("string")))
        .withColumn("overall_action", F.when(F.col("blocked"), "block").otherwise("warn"))
        .withColumn("warnings", F.flatten(F.transform(F.filter(r, lambda x: x["action"] == "warn"), warn)))
        .withColumn("redact_spans", F.flatten(F.transform(r, lambda x: F.transform(x["spans"], lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), s["matched"].alias("matched"), template(x["rule_id"]).alias("redacted"))))))
        .withColumn("admin_alert", F.coalesce(fired(flagged("admin_alert")), F.lit(False)))
        .withColumn("compliance_audit", F.coalesce(fired(flagged("compliance_audit")), F.lit(False)))
        .withColumn("gdpr_audit", F.coalesce(fired(flagged("gdpr_audit")), F.lit(False)))
    )


def redact(c: Column, spans: Column, token: str = TOKEN, templates: bool = False) -> Column:
    """Each span replaced by the token, the last first; of equal starts the earlier given first. Spans may overlap or end
    behind the text. With templates, spans carry ``redacted``, which stands for the token where it isn't null."""
    own = (lambda s: F.coalesce(s["redacted"], F.lit(token))) if templates else (lambda s: F.lit(token))
    numbered = F.transform(spans, lambda s, i: F.struct((-s["start_pos"]).alias("k"), i.alias("i"), s["start_pos"].alias("a"), s["end_pos"].alias("b"), own(s).alias("t")))
    return F.aggregate(F.array_sort(numbered), c, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["a"]), s["t"], F.substring(acc, s["b"] + 1, F.length(acc))))


def apply_action(action: str, c: Column, spans: Column, blocked: Column, suspicion: Column, limit: int = 1000, templates: bool = False) -> Column:
    """The text after an action; null where it is blocked."""
    gone = F.lit(None).cast("string")
    if action == "block":
        return gone
    if action == "redact":
        return redact(c, spans, templates=templates)
    if action == "clean":
        return clean(c)
    if action == "truncate":
        return truncate_at_boundary(c, limit)
    if action == "dynamic":
        return F.when(blocked | (suspicion > 50), gone).when(F.size(spans) > 0, redact(c, spans, templates=templates)).otherwise(c)
    if action in ("warn", "soft_allow"):
        return c
    raise ValueError(f"unknown action {action}")


def evidence(df: DataFrame, key: str, text: str, results: str = "results", width: int = 200, language: str | None = None) -> DataFrame:
    """Why each rule fired: one row per match with what stands before and behind it, one per link between fired rules and, with
    a column of the detected language, one per fired rule that names it. The surroundings are cut out within the row."""
    c = F.col(text)

    def matches(r: Column) -> Column:
        def one(s: Column) -> Column:
            before, after = surrounding(c, s["start_pos"], s["end_pos"], width)
            return F.struct(r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), F.substring(s["matched"], 1, 200).alias("matching_text"), before.alias("text_before"), after.alias("text_after"))

        return F.transform(r["spans"], one)

    m = exploded(df, F.flatten(F.transform(results, matches)), "m", key)
    out = m.select(key, "m.rule_id", "m.severity", F.lit("lexical").alias("source_layer"), "m.matching_text", "m.text_before", "m.text_after")
    if language:
        fired = exploded(df.filter(F.col(language).isNotNull()), results, "r", key, F.col(language).alias("_language"))
        out = out.unionByName(fired.select(key, "r.rule_id", "r.severity", F.lit("syntactic").alias("source_layer"), F.col("_language").alias("matching_text"), F.lit("").alias("text_before"), F.lit("").alias("text_after")))
    if "links" not in df.columns:
        return out
    linked = exploded(df, "links", "k", key).select(key, "k.rule_id", F.lit(None).cast("string").alias("severity"), F.lit("correlation").alias("source_layer"), F.col("k.linked").alias("matching_text"), F.lit("").alias("text_before"), F.lit("").alias("text_after"))
    return out.unionByName(linked)


def audit_events(df: DataFrame, key: str, stage: str, results: str = "results", context: tuple[str, ...] = ()) -> DataFrame:
    """One event per fired rule: snippet of the first match, all spans, the action taken."""
    rows = exploded(df, results, "r", key, *context, "overall_action")
    first = F.when(F.size("r.spans") > 0, F.substring(F.element_at("r.spans", 1)["matched"], 1, 200)).otherwise("")
    spans = F.transform("r.spans", lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), F.substring(s["matched"], 1, 100).alias("matched")))
    return rows.select(
        key, *context, F.lit(stage).alias("stage"), "r.rule_id", F.col("r.name").alias("rule_name"), "r.severity", "r.action", first.alias("content_snippet"),
        F.lit(0).alias("content_length"), F.size("r.spans").alias("match_count"), spans.alias("matched_spans"), F.col("overall_action").alias("action_taken"), F.lit(False).alias("gdpr_relevant"),
    )
