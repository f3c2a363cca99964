"""Rules and settings from files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame

from lexisift.operators.rules import Boost, Pattern, Rule


def pattern_of(d: dict) -> Pattern:
    return Pattern(d["type"], d.get("value", ""), float(d.get("confidence", 1.0)), d.get("min_length"), tuple(pattern_of(x) for x in d.get("sub_patterns", ())))


def rule_of(d: dict) -> Rule:
    """A rule from its description as nested maps; what is wrong with it raises ValueError."""
    det, cfg = d.get("detection", {}), d.get("config", {})
    boost = cfg.get("context_boost")
    return Rule(
        d["id"], d["name"], d.get("severity", "P2"), d.get("action", "warn"), tuple(pattern_of(p) for p in det.get("patterns", ())), det.get("mode", "any"), d.get("category", "general"),
        tuple(d.get("applicable_stages", ("input",))), d.get("enabled", True), cfg.get("max_matches", det.get("max_matches", 10)), det.get("min_length"), tuple(cfg.get("exclusions") or det.get("exclusions") or ()),
        tuple(det.get("languages") or ()), cfg.get("max_length"), cfg.get("no_pattern_match", False), cfg.get("redact_template"), cfg.get("luhn_check", False), cfg.get("normalize"), tuple(cfg.get("link_to_rules") or ()),
        Boost(tuple(boost["proximity_rules"]), boost["severity_override"], boost.get("proximity_window", 500)) if boost else None, dict(cfg.get("severity_reduction") or {}),
        cfg.get("cumulative_score_threshold") if cfg.get("session_tracking") else None, tuple(cfg.get("rules_context_dependency") or ()) if cfg.get("session_pollution_flag") else (),
        cfg.get("admin_alert", False), cfg.get("compliance_audit", False), cfg.get("gdpr_audit", False),
    )


def load_rules(path: str) -> list[Rule]:
    """Rules of a JSON file: a list, or a map with the list under ``rules``."""
    data = json.loads(Path(path).read_text())
    return [rule_of(d) for d in (data["rules"] if isinstance(data, dict) else data)]


#: A table of rules is a dimension: it is read to the driver to become part of the plan.
MAX_RULES = 5_000


def rules_from_table(df: DataFrame, enabled_only: bool = True) -> list[Rule]:
    """Rules of a table (rule_id, rule_name, category, severity, action, applicable_stages, enabled, match_mode, max_matches,
    patterns array<struct<ptype, pattern, confidence>>)."""
    rows = df.orderBy("rule_id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = []
    for r in rows:
        if enabled_only and not r["enabled"]:
            continue
        out.append(Rule(r["rule_id"], r["rule_name"], r["severity"], r["action"], tuple(Pattern(p["ptype"], p["pattern"], p["confidence"]) for p in r["patterns"]), r["match_mode"], r["category"], tuple(r["applicable_stages"]), r["enabled"], r["max_matches"]))
    return out


def merged(*layers: dict) -> dict:
    """Maps laid over one another; nested maps are merged, other values replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_environment(prefix: str, environ: dict[str, str] | None = None) -> dict:
    """Settings of variables with the prefix: ``PREFIX_A__B=1`` is {"a": {"b": "1"}}."""
    out: dict = {}
    for name, value in (os.environ if environ is None else environ).items():
        if name.startswith(prefix + "_"):
            at = out
            *path, last = name[len(prefix) + 1 :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
    return out


def load_settings(*paths: str, prefix: str = "LEXISIFT", environ: dict[str, str] | None = None) -> dict:
    """JSON settings (YAML where a reader is installed), later files over earlier ones, the environment over all."""
    layers = []
    for p in paths:
        if not Path(p).exists():
            continue
        text = Path(p).read_text()
        if p.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ImportError("no YAML reader is installed; use JSON settings") from e
            layers.append(yaml.safe_load(text) or {})
        else:
            layers.append(json.loads(text))
    return merged(*layers, from_environment(prefix, environ))
