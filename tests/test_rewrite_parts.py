"""A pass applied to the map and to the owners in parts of the volumes, against the SQL over the smallest tables."""

import os

import pytest

from varve.operators import rewrite as rw
from varve.plans import fixtures as fx

from tests.test_parts import FOLDER, matches_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize(("name", "label"), [("g13_apply", "applied"), ("g13_apply_owners", "owners")])
def test_a_pass_is_applied_in_parts(spark, monkeypatch, name, label):
    monkeypatch.setattr(fx, "PART_LINES", 2000)
    made, real = set(), rw.stored_parts
    monkeypatch.setattr(rw, "stored_parts", lambda make, parts, label, *more: real(lambda k: made.add((label, k)) or make(k), parts, label, *more))
    matches_sql(spark, name)
    assert made == {(label, k) for k in range(fx.parts(spark, FOLDER))} and len(made) > 1
