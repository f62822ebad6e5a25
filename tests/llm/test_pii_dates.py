"""Dates keep their format and come back, in every way of writing them."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pytest
from hypothesis import given, settings, strategies as st

from custlens.llm import pii

WAYS = {
    "iso": lambda d: d.isoformat(),
    "dotted": lambda d: f"{d.day:02d}.{d.month:02d}.{d.year}",
    "dotted, short": lambda d: f"{d.day}.{d.month}.{d.year}",
    "dotted, short day": lambda d: f"{d.day}.{d.month:02d}.{d.year}",
    "slashed, month first": lambda d: f"{d.month:02d}/{d.day:02d}/{d.year}",
    "slashed, short": lambda d: f"{d.month}/{d.day}/{d.year}",
    "slashed, day first": lambda d: f"{d.day}/{d.month:02d}/{d.year}",
    "slashed, day first, short month": lambda d: f"{d.day}/{d.month}/{d.year}",
}
there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
days = st.integers(0, (pii.LAST_DAY - pii.FIRST_DAY).days).map(lambda k: pii.FIRST_DAY + timedelta(days=k))


@settings(max_examples=200, deadline=None)
@given(days, st.sampled_from(sorted(WAYS)))
def test_round_trip_in_the_same_form(day, way):
    text = f"on {WAYS[way](day)}, then"
    new, spans = pii.replaced(text, there)
    assert [k for _, _, k in spans] == ["date"]
    assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", text)
    assert pii.replaced(new, back)[0] == text


def test_the_same_day_stays_linked():
    day = date(2024, 2, 1)
    iso = pii.replaced(day.isoformat(), there)[0]
    assert pii.replaced("01.02.2024", there)[0] == "{2}.{1}.{0}".format(*iso.split("-"))
    assert pii.replaced("1.2.2024", there)[0] == pii.replaced("1.2.2024", there)[0] != "1.2.2024"


def test_a_permutation_of_each_form():
    for form in (pii.FULL, (13, 2, 1), (1, 1, 1)):
        every = [date.fromordinal(k) for k in pii.days_of_format(*form)][:3000]
        new = {there.day(d, form) for d in every}
        assert len(new) == len(every) and all(d.day >= form[0] for d in new)


def test_a_key_is_needed(spark):
    with pytest.raises(TypeError):
        pii.pseudonymized(spark.range(1))
