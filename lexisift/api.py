"""One object that holds the rules and runs them over tables: the surface for applications."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions.rows import exploded
from lexisift.functions.text import normalize
from lexisift.operators import scanner, sessions, verdicts
from lexisift.operators.analyzers import detect_language
from lexisift.operators.rules import Rule, RuleBook, evaluate
from lexisift.sources.rulefiles import load_rules, rule_of

log = logging.getLogger(__name__)
HOOKS = ("before_detection", "after_detection", "before_scan", "after_scan")


class Engine:
    """settings: ``overrides`` with ``severity`` and ``action`` by rule, ``disabled_rules``, ``enabled_only_rules``."""

    def __init__(self, rules: list[Rule] = (), settings: dict | None = None):
        self.book = RuleBook(rules)
        self.settings = settings or {}
        self._hooks: dict[str, list[Callable]] = {h: [] for h in HOOKS}

    # rules

    def load_rules_from_list(self, rules: list[Rule | dict]) -> int:
        return self.book.replace_all([r if isinstance(r, Rule) else rule_of(r) for r in rules])

    def load_rules(self, path: str) -> int:
        return self.book.replace_all(load_rules(path))

    def add_rule(self, rule: Rule | dict) -> None:
        self.book.add(rule if isinstance(rule, Rule) else rule_of(rule))

    def remove_rule(self, rule_id: str) -> bool:
        return self.book.remove(rule_id)

    def enable_rule(self, rule_id: str) -> None:
        self.book.enable(rule_id)

    def disable_rule(self, rule_id: str) -> None:
        self.book.enable(rule_id, False)

    def get_rule(self, rule_id: str) -> Rule | None:
        return self.book.get(rule_id)

    def rules_for(self, stage: str) -> list[Rule]:
        """Rules of a stage in order of severity, after the overrides of the settings."""
        o = self.settings.get("overrides", {})
        only, off = set(o.get("enabled_only_rules") or ()), set(o.get("disabled_rules") or ())
        out = [r for r in self.book.for_stage(stage) if r.id not in off and (not only or r.id in only)]
        return [replace(r, severity=o.get("severity", {}).get(r.id, r.severity), action=o.get("action", {}).get(r.id, r.action)) for r in out]

    # hooks: a hook that fails is logged and doesn't stop the run

    def register_hook(self, name: str, call: Callable) -> None:
        if name not in self._hooks:
            raise ValueError(f"unknown hook {name}")
        self._hooks[name].append(call)

    def _fire(self, name: str, df: DataFrame) -> None:
        for call in self._hooks[name]:
            try:
                call(df)
            except Exception:
                log.exception("hook %s failed", name)

    # detection

    def _detect(self, df: DataFrame, stage: str, text: str, language: bool) -> DataFrame:
        self._fire("before_detection", df)
        rules = self.rules_for(stage)
        df = df.withColumn("raw_content", F.col(text)).withColumn(text, normalize(F.col(text)))
        lang = sure = None
        if language and any(r.languages for r in rules):
            df = detect_language(df, text)
            df = df.withColumn("detected_language", F.col("detected.language")).withColumn("language_confidence", F.col("detected.confidence")).drop("detected")
            lang, sure = "detected_language", "language_confidence"
        out = verdicts.verdict(verdicts.correlate(evaluate(df, rules, text, "raw_content", lang, sure), rules), rules)
        self._fire("after_detection", out)
        return out

    def detect_input(self, df: DataFrame, text: str = "content", language: bool = True) -> DataFrame:
        """df with results and verdict of the rules for input; text is normalised, raw_content is as it came."""
        return self._detect(df, "input", text, language)

    def detect_output(self, df: DataFrame, text: str = "content", language: bool = True) -> DataFrame:
        return self._detect(df, "output", text, language)

    def track_behavior(self, df: DataFrame, session: str, order: list[str], text: str = "content") -> DataFrame:
        """Verdicts of each message with the running state of its session; rules for behavior come first."""
        own = {r.id: r for r in self.rules_for("behavior")}
        rules = [*own.values(), *(r for r in self.rules_for("input") if r.id not in own)]
        plain = [r for r in rules if r.session_threshold is None and not r.pollution_of]
        watch = [r for r in rules if r.session_threshold is not None or r.pollution_of]
        judged = verdicts.verdict(verdicts.correlate(evaluate(df.withColumn(text, normalize(F.col(text))), plain, text), plain), plain)
        return sessions.track(judged, session, order, watch)

    def act(self, df: DataFrame, action: str, text: str = "content", suspicion: str | None = None) -> DataFrame:
        """df with processed_content after an action on the verdicts."""
        s = F.col(suspicion) if suspicion else F.lit(0)
        return df.withColumn("processed_content", verdicts.apply_action(action, F.col(text), F.col("redact_spans"), F.col("blocked"), s, templates=True))

    def audit(self, judged: DataFrame, key: str, stage: str, context: tuple[str, ...] = ()) -> DataFrame:
        return verdicts.audit_events(judged, key, stage, context=context)

    @staticmethod
    def metrics(judged: DataFrame, results: str = "results", top: int = 20) -> DataFrame:
        """How often each rule fired, the most frequent first."""
        return exploded(judged, results, "r").groupBy("r.rule_id").agg(F.count("*").alias("n_triggered"), F.sum(F.size("r.spans")).alias("n_matches")).orderBy(F.desc("n_triggered"), "rule_id").limit(top)

    @staticmethod
    def timed(call: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
        """What a call gives, written out to nowhere, and the seconds that took."""
        import time

        began = time.perf_counter()
        df = call()
        df.write.format("noop").mode("overwrite").save()
        return df, time.perf_counter() - began

    # code review

    def review_code(self, spark: SparkSession, source: str | DataFrame, manifest: DataFrame | None = None) -> DataFrame:
        """Findings in a folder or a table (file_id, file_path, content); with a manifest only of files it doesn't have."""
        if isinstance(source, str):
            files = scanner.read_folder(spark, source)
            files = files.withColumn("file_id", F.xxhash64("file_path")).withColumn("fp", scanner.fingerprint(F.col("file_path"), F.col("modified"), F.col("length"), F.col("content")))
        else:
            files = source
        if manifest is not None:
            files = scanner.changed(files, manifest, ["file_path", "fp"])
        self._fire("before_scan", files)
        found = scanner.scan(files)
        self._fire("after_scan", found)
        return found
