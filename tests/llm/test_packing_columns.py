"""Placing of pieces reads lengths and numbers only; token ids and other columns stay out of Python."""

from sparkassay.llm import packing
from sparkassay.session import materialize


def test_ids_are_not_sent_to_python(spark):
    rows = [(d, p, 1 + (d * 7 + p) % 9, bytes([d % 256]) * 4) for d in range(60) for p in range(2)]
    pieces = materialize(spark.createDataFrame(rows, "doc_id long, piece int, length long, ids binary"), "pieces")
    placed = packing.assign(pieces, capacity=16, grain=1, rounds=20)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    got = placed.collect()
    assert sorted((r.doc_id, r.piece, r.length, bytes(r.ids)) for r in got) == sorted(rows)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
