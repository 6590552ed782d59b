"""Exact deduplication: fingerprints that compose, groups against brute force, collisions told apart."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import exact

DOCS = "doc_id long, text string, n long, row string, print string, salt int, first int"


def brute(rows: list[tuple]) -> list[tuple]:
    """doc_id, keep_id, group_size, kept, text_sha256 by the contract; of equal ids one row stays."""
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups: dict = {}
    for k, t in enumerate(plain):
        groups.setdefault(t, []).append(k)
    out = []
    for t, members in groups.items():
        members.sort(key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(rows[k][0], rows[members[0]][0], len(members), k == members[0], sha) for k in members]
    return sorted(out, key=repr)


def corpus() -> list[tuple]:
    draw = random.Random(4)
    words = ["a", "bé", "c d", "eee", "x\x1cy"]
    text = lambda n: draw.choice(["", " "]).join([draw.choice(words) + draw.choice([" ", "\t", "\n ", "  ", "\r\n"]) for _ in range(n)])
    texts = [text(draw.randint(0, 4)) for _ in range(150)] + [None, "", " ", "\x0b\x0c", "long " * 3000, "long\t" * 3000, "long " * 2999 + "lang "]
    rows = [(draw.randint(0, 90), t) for t in texts] + [(None, "a a"), (None, "a  a"), (None, "only here"), (None, "only  here"), (7, "same"), (7, "same"), (7, "other")]
    return [(*r, 1, "x", "y", 2, 3) for r in rows + rows[:20]]


@pytest.mark.parametrize(("piece", "prime"), [(exact.PIECE, exact.PRIME), (16, exact.PRIME), (16, 3)])
def test_copies(spark, monkeypatch, piece, prime):
    """Brute force; with pieces of 16 bytes, and with three-valued lanes, so that many prints agree by chance."""
    monkeypatch.setattr(exact, "SALT_ROWS", 5)
    rows = corpus()
    found = exact.exact_copies(spark.createDataFrame(rows, DOCS).repartition(5), piece, prime)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_shuffle_join(spark, monkeypatch):
    """Beyond the broadcast bound prints are joined by a shuffle, frequent ones apart."""
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    rows = [(*r, 1, "x", "y", 2, 3) for r in [(k, "hot  text") for k in range(300)] + [(k, f"text {k % 40}") for k in range(100)]]
    assert sorted(map(tuple, exact.op12_exact_dedup(spark.createDataFrame(rows, DOCS)).collect()), key=repr) == brute(rows)


def test_drop_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = sorted((r[0], r[4]) for r in brute(rows) if r[3] and r[0] is not None)
    got = [(r.doc_id, hashlib.sha256(plain(r.text).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(r for r in got if r[0] is not None) == want and len(got) == len({plain(r[1]) for r in rows})


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact.op12_exact_dedup(docs).count() == 0 and exact.drop_copies(docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.lists(st.integers(0, 300), max_size=6))
def test_fingerprints_compose(data, cuts):
    """Pieces at any cuts, shifted by what is behind them, add up to the whole; Horner's rule agrees."""
    powers = exact.falling_powers(300)
    whole = exact.piece_lanes(data, powers)
    places = sorted({min(c, len(data)) for c in cuts} | {0, len(data)})
    parts = [exact.shifted(exact.piece_lanes(data[a:b], powers), len(data) - b) for a, b in zip(places, places[1:], strict=False)]
    assert whole == [sum(p[k] for p in parts) % exact.PRIME for k in range(4)]
    for k, point in enumerate(exact.POINTS.tolist()):
        value = 0
        for byte in data:
            value = (value * point + byte) % exact.PRIME
        assert value == whole[k]


def test_unequal(spark):
    """Rows whose prints agree though their last byte differs are found, whatever their salt."""
    rows = [(k, k, (9, 1, 1), 9, b"x" * 8 + (b"z" if k % 10 == 3 else b"y")) for k in range(60)]
    copies = spark.createDataFrame(rows, "row long, doc_id long, print struct<n_bytes:long,high:long,low:long>, n long, text binary")
    assert sorted(r.row for r in exact.unequal(copies, piece=4).collect()) == list(range(3, 60, 10))
    assert np.all(np.array([r.row for r in exact.unequal(copies.where("row % 10 <> 3"), piece=4).collect()]) < 0)
