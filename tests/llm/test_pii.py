"""Personal data: the base detectors against the plain patterns, and disguises mapped back."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varve.llm import pii


def plain(text):
    """The contract's patterns as they stand, on small texts."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1250.@-+ ()%é", max_size=60))
def test_base_matches_the_patterns(text):
    assert pii.detected(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "@", ".", " ", "5", "x", "-"]), max_size=12))
def test_base_matches_on_likely_parts(parts):
    text = "".join(parts)
    assert pii.detected(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jo.do [at] mail7 (dot) example [dot] com now", "email", "jo.do [at] mail7 (dot) example [dot] com"),
        ("write to jo at example dot com now", "email", "jo at example dot com"),
        ("mail jо@exаmple.com", "email", "jо@exаmple.com"),
        ("jo＠example.com", "email", "jo＠example.com"),
        ("jo @ example.com", "email", "jo @ example.com"),
        ("call +one zero one seven five five five seven seven one three", "phone", None),
        ("call plus one zero one seven five five five seven seven one three now", "phone", "plus one zero one seven five five five seven seven one three"),
        ("host 192 dot 168 dot 1 dot 20 up", "ip", "192 dot 168 dot 1 dot 20"),
        ("four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
        ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
        ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
    ],
)
def test_disguises_map_back(text, kind, source):
    base, added = pii.spans(text)
    assert not base
    found = [text[a:b] for a, b, k in added if k == kind]
    assert (found == [source]) if source else len(found) <= 1


def test_plain_prose_adds_nothing():
    assert pii.spans("He was at home. One of two dot matrix printers, at three.")[1] == []
    assert pii.spans(None) == ([], [])


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "+1", "+1(", "@", "a@", "one ", "dot ", " at ", "a.", "(at)"])
def test_long_texts_take_linear_time(unit):
    pii.spans(unit * (200_000 // len(unit)))
    begun = time.perf_counter()
    pii.spans("one two three. " + unit * (200_000 // len(unit)) + "1a")
    assert time.perf_counter() - begun < 20


def test_a_run_ends_before_a_number_that_goes_on():
    text = "call plus one zero one seven five five five seven seven one three double 4x"
    base, added = pii.spans(text)
    assert not base and [text[a:b] for a, b, _ in added] == ["plus one zero one seven five five five seven seven one three"]


def test_digest_against_the_plain_patterns(spark):
    texts = ["mail a.b@c.de or 1.2.3.4 and +1 (017) 555-7713, 4111 1111 1111 1111", "jo at example dot com", None, "", "none", "mail a.b@c.de or 1.2.3.4", "x " * 100_000 + "a@b.cd"]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", 1, "y"), (None, texts[1], "x", 1, "y")]
    schema = "doc_id long, text string, spans string, n_ip int, base_sha256 string"
    got = sorted(pii.digest(spark.createDataFrame(rows, schema)).collect(), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        base, added = plain(text or ""), pii.spans(text)[1]
        told = lambda found: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2]))))
        counts = [sum(k == kind for *_, k in base) for kind in pii.KINDS]
        want.append((doc_id, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(base + added), len(added)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert pii.digest(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    ("text", "source"),
    [
        ("mail jane at example.com", "jane at example.com"),
        ("mail jane\tdot\tdoe@example.com", "jane\tdot\tdoe@example.com"),
        ("mail jane\t@\texample.com", "jane\t@\texample.com"),
        ("mail jane  at  example  dot  com now", "jane  at  example  dot  com"),
        ("mail jªne@exampl².com", "jªne@exampl².com"),
    ],
)
def test_every_transducer_opens_the_gate(text, source):
    form = pii.normalised(text)
    assert form is not None
    assert source in [text[form.starts[a] : form.ends[b - 1]] for a, b, kind in pii.detected(form.text) if kind == "email"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["jane", "example.com", "example", "com", " ", "  ", "\t", "at", "AT", "dot", "@", ".", "[at]", "(", ")", "one", "double", "ſix", "fıve", "f\u0130ve", "7", "plus", "-", ", ", "ª", "²", "\xa0", "о", "\u200b"]), max_size=14))
def test_gate_changes_no_result(parts):
    text = "".join(parts)
    on, off = pii.normalised(text), pii.normalised(text, gate=False)
    assert (on is None) == (off is None)
    assert on is None or (on.text, on.starts, on.ends) == (off.text, off.starts, off.ends)


@pytest.mark.parametrize(
    ("text", "fragment", "whole"),
    [
        ("mail jоhn@example.com", "hn@example.com", "jоhn@example.com"),
        ("mail jane dot doe@example.com", "doe@example.com", "jane dot doe@example.com"),
        ("mail john@example.cоm now", "john@example.c", "john@example.cоm"),
    ],
)
def test_base_fragments_hide_no_identifier(text, fragment, whole):
    base, added = pii.spans(text)
    assert [text[a:b] for a, b, _ in base] == [fragment]
    assert [text[a:b] for a, b, _ in added] == [whole]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["jo", "о", "@", " at ", ".", " dot ", "com", "de", " ", "1.2", "one ", "4111 1111 1111 1111", "+1 017 555 7713"]), max_size=12))
def test_added_spans_are_those_that_no_base_span_covers(parts):
    text = "".join(parts)
    base, added = pii.spans(text)
    assert base == pii.detected(text)
    form = pii.normalised(text)
    found = [(form.starts[a], form.ends[b - 1], kind) for a, b, kind in pii.detected(form.text)] if form else []
    assert added == [s for s in found if not any(a <= s[0] and s[1] <= b and kind == s[2] for a, b, kind in base)]
