"""The words that spare a pattern its run: a text without them can't match."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisift.operators import code_pack, code_probes, output_probes
from lexisift.operators.probes import required, run

EVERY = [*code_probes.PROBES, *code_pack.PROBES, *output_probes.PROBES, *output_probes.RESET]


@pytest.mark.parametrize("pattern, words", [("abc", ("abc",)), ("a?bcd", ("bcd",)), ("(?:foo|barn)x*", ("foo", "barn")), ("(?:foo|b?)", ()), ("[ab]+", ()), ("(?i)EVAL\\s*x", ("eval",)), ("(?!no)yes", ("yes",)), ("(?:ab)+cde", ("cde",))])
def test_required(pattern, words):
    assert required(pattern) == words


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(EVERY), st.data())
def test_whatever_matches_holds_a_word(probe, data):
    flags = re.M | (re.I if probe.ignore_case else 0)
    try:
        text = data.draw(st.from_regex(re.compile(probe.pattern, flags)))
    except Exception:  # noqa: BLE001 - a pattern that texts can't be made from
        return
    words = required(probe.pattern, re.I if probe.ignore_case else 0)
    if re.search(probe.pattern, text, flags) and text.isascii():
        assert not words or any(w in text.lower() for w in words)


def test_most_patterns_have_words():
    assert sum(bool(required(p.pattern)) for p in EVERY) > 0.9 * len(EVERY)


def test_run_is_the_same_without_words(monkeypatch):
    texts = ["eval(x); os.system(y)", "SELECT a FROM b WHERE c = " + "'x' + d", "password = 'hunter22'\n", "", "x" * 1000]
    before = [run(t, "py", tuple(EVERY), False, "a.py") for t in texts]
    from lexisift.operators import probes

    monkeypatch.setattr(probes, "required", lambda *a: ())
    probes._compiled.cache_clear()
    assert [run(t, "py", tuple(EVERY), False, "a.py") for t in texts] == before
    probes._compiled.cache_clear()
