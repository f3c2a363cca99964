"""The rules that the catalogue's queries use."""

from __future__ import annotations

from lexisift.operators.rules import Boost, Pattern, Rule

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ADDRESS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
DIGITS = r"[0-9][0-9 -]{11,22}[0-9]"
CODE = r"[0-9]+ (?:files|audit records|characters|retries)"


def keyword(word: str, confidence: float = 0.8) -> Pattern:
    return Pattern("keyword", word, confidence)


def regex(pattern: str, confidence: float = 0.9) -> Pattern:
    return Pattern("regex", pattern, confidence)


#: Contact data, addresses, card numbers and words of caution in texts.
FLAGSHIP = [
    Rule("I-14", "Card number", "P0", "block", (regex(DIGITS),), luhn_check=True, compliance_audit=True),
    Rule("I-13", "E-mail address", "P1", "redact", (regex(EMAIL),), gdpr_audit=True, boost=Boost(("I-11",), "P0", 200)),
    Rule("I-10", "Network address", "P1", "warn", (regex(ADDRESS),), admin_alert=True),
    Rule("I-11", "Phone number", "P1", "warn", (regex(r"\+[0-9]{1,3}[ .-][0-9 .()-]{6,16}[0-9]"),), links=("I-13",)),
    Rule("I-20", "Certificates and tokens", "P2", "warn", (keyword("certificate"), keyword("token")), max_matches=3, reductions={"I-10": "P2"}),
]
#: On documents: prose words, so that many rows fire.
PROSE = [
    Rule("O-21", "Shell commands", "P0", "block", (keyword("shell commands"),), admin_alert=True),
    Rule("O-22", "Certificate warning", "P1", "redact", (keyword("certificate warning"),), boost=Boost(("O-23",), "P0", 300), gdpr_audit=True),
    Rule("O-23", "Counted things", "P1", "warn", (regex(CODE),), links=("O-22",), max_matches=5),
    Rule("O-24", "Session marked", "P2", "warn", (keyword("session"),), reductions={"O-23": "P2"}, max_matches=4, compliance_audit=True),
]
#: Over the messages of a session.
SESSION = [
    Rule("I-13", "E-mail address", "P1", "warn", (regex(EMAIL),)),
    Rule("I-10", "Network address", "P0", "warn", (regex(ADDRESS),)),
    Rule("I-20", "Deployment", "P2", "warn", (keyword("deployment"),)),
]
WATCHERS = [
    Rule("B-47", "Score of a session", "P1", "warn", session_threshold=15),
    Rule("B-42", "Polluted session", "P0", "block", pollution_of=("I-10",)),
]
