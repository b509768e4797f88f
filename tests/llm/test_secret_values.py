"""Secrets that are short, have no digit or hold marks are candidates, and the forest finds them."""

import os
import sys

import numpy as np
import pytest

pytest.importorskip("tablewright.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

from cases import documents  # noqa: E402
from tablewright.llm import secret_scan  # noqa: E402

VALUES = [
    ('the login has password: "Tr0ub4dor&3" since then', "Tr0ub4dor&3"),
    ('we set pwd = "S3cr!tPass" there', "S3cr!tPass"),
    ("token = QwErTyUiOpAsDfGhJkLz, as told", "QwErTyUiOpAsDfGhJkLz"),
    ("see https://bob:p4%x@host.example.org/a for it", "p4%x"),
    ("note: api_key='grün und blau' here", "grün und blau"),
    ('{"secret": "a&b"}', "a&b"),
    ("open password=", None),
]


def test_values_after_names(spark):
    rng = np.random.default_rng(8)
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    rows = [(100 + k, f"the server was set with password={pick('0123456789abcdefXYZ', 18)} on that day") for k in range(30)]
    rows += [(200 + k, f"it was paid from {pick('0123456789', 16)} to version 1.2.{k}.20240101 today") for k in range(30)]
    rows += list(enumerate(t for t, _ in VALUES))
    found = secret_scan.scan(documents(spark, rows)).collect()
    for r in found:
        assert dict(rows)[r.doc_id][r.start : r.end] == r.candidate
    for k, (_, value) in enumerate(VALUES):
        assert [r.candidate for r in found if r.doc_id == k] == ([value] if value else [])
    assert {r.doc_id for r in found if r.secret and r.doc_id < 100} == {k for k, (_, v) in enumerate(VALUES) if v}
    assert not any(r.secret for r in found if r.doc_id >= 200)
