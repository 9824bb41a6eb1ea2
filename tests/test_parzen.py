"""The sequential sampler on a known surface."""

from __future__ import annotations

import random

import numpy as np

from hearthline.models import tuning

SPACE = {"a": (1.0, 100.0, "log"), "b": (0.0, 10.0, "float"), "c": (2, 40, "log-int")}


def surface(p):
    return -((np.log(p["a"]) - 1.0) ** 2) - 0.3 * (p["b"] - 7.0) ** 2 - (np.log(p["c"] / 9.0)) ** 2


def test_beats_random_draws():
    searched, drawn = [], []
    for seed in range(30):
        history = []
        for _ in range(40):
            units = tuning.propose(history, SPACE, seed)
            history.append((units, surface(tuning.from_unit(SPACE, units))))
        searched.append(max(v for _, v in history))
        rng = random.Random(f"random|{seed}")
        drawn.append(max(surface(tuning.from_unit(SPACE, {n: rng.random() for n in SPACE})) for _ in range(40)))
    assert np.mean(searched) > np.mean(drawn) / 2 and np.mean(np.array(searched) > np.array(drawn)) > 0.7


def test_windows_are_densities():
    x = np.linspace(0, 1, 20001)
    for seen in ([0.5], [0.0, 1.0], [0.2, 0.21, 0.9]):
        window = tuning.Parzen(seen)
        assert abs(np.mean([window.density(v) for v in x]) - 1.0) < 1e-3
        rng = random.Random(1)
        assert all(0.0 <= window.draw(rng) <= 1.0 for _ in range(200))


def test_units_and_ranges():
    low, high = ({n: float(v) for n in SPACE} for v in (0, 1))
    assert tuning.from_unit(SPACE, low) == {"a": 1.0, "b": 0.0, "c": 2}
    assert tuning.from_unit(SPACE, high) == {"a": 100.0, "b": 10.0, "c": 40}
    assert tuning.propose([], SPACE, 3) == tuning.propose([], SPACE, 3)


def test_trials_share_one_staged_table(spark, monkeypatch):
    """Each trial reads the table written once, whatever the number of trials."""
    written = []
    monkeypatch.setattr(tuning, "staged", lambda df, label: written.append(label) or df)
    df = spark.range(30).selectExpr("CAST(id % 3 AS INT) AS fold", "CAST(id % 2 AS INT) AS t")
    found = tuning.parzen_search(df, lambda **chosen: lambda fit, valid: valid.selectExpr("t", "t AS p"), {"a": (0.0, 1.0, "float")}, trials=3)
    assert [r["qwk_mean"] for r in found.collect()] == [1.0] * 3
    assert written == ["trials"]
