"""Rounds of the sampling bias over lists, and over joined cells."""

import pytest
from thallus.operators import differential

LEVELS = {"species": ["A", "T"], "time": ["June20", "Jan21"]}


def test_lists_and_cells_agree(spark, monkeypatch):
    """The same bias after the same rounds; lists serve while their numbers are few, cells beyond."""
    rows = [
        (f"t{t}" if t else None, f"s{s}", "AT"[s % 2], ("June20", "Jan21")[s // 2 % 2], float((7 * t + 5 * s) % 11) / 3 + (s % 2) * t / 5)
        for s in range(30) for t in range(9) if (s * t) % 4 != 3
    ]
    rows += rows[:5]  # a repeated row counts twice
    table = spark.createDataFrame(rows, "taxon string, sample string, species string, time string, y double")
    used, cells_path = [], differential._bias_of_cells
    monkeypatch.setattr(differential, "_bias_of_cells", lambda *a: used.append(1) or cells_path(*a))
    for rounds in (1, 2, 30):
        got, ended = differential._bias(table, ["species", "time"], LEVELS, 1e-9, rounds)
        got = {r.sample: r.theta for r in got.collect()}
        assert not used
        with monkeypatch.context() as m:
            m.setattr(differential, "BROADCAST_BYTES", 0)
            want, as_well = differential._bias(table, ["species", "time"], LEVELS, 1e-9, rounds)
            want = {r.sample: r.theta for r in want.collect()}
        assert used.pop() and len(want) == 30 and got == pytest.approx(want, abs=1e-12) and ended == as_well
