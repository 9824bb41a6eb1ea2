"""Overlapping windows of the tagger, reconciled over runs of tiles."""

from __future__ import annotations

import numpy as np

from hearthline.llm import pii
from hearthline.llm.chain_crf import viterbi
from hearthline.llm.tagger import Tagger, symbols

TEXTS = ["no sign of any", "", "mail a.b@c.org or +44 20 7946 0958 " + "x" * 300 + " 10.0.0.1", "7" * 40, ("12 ab " * 60) + "y" * 100 + "1", "@", "1234 " * 900]


def _plain(text: str, tagger: Tagger) -> np.ndarray:
    """Character by character: the mean emission of its windows, and one decoding per run of tiles."""
    codes = pii.coded(text)
    out = np.zeros(len(codes), dtype=np.int8)
    chosen = [int(t) for t in pii.tiles(codes)]
    x = symbols(codes)
    emissions = {}
    for t in chosen:
        at = [t * pii.TILE - pii.EDGE + i for i in range(pii.WINDOW)]
        window = np.array([[x[i] if 0 <= i < len(x) else 0 for i in at]], dtype=np.int16)
        for i, e in zip(at, tagger.emissions(window)[0], strict=True):
            emissions.setdefault(i, {})[t] = e
    runs = np.split(np.array(chosen), np.flatnonzero(np.diff(chosen) > 1) + 1) if chosen else []
    for run in runs:
        own = set(run.tolist())
        chars = [i for t in run for i in range(t * pii.TILE, min((t + 1) * pii.TILE, len(codes)))]
        emit = np.array([np.mean([e for t, e in emissions[i].items() if t in own], axis=0) for i in chars])
        out[chars] = viterbi(emit[None], np.array([len(chars)]), tagger.p["trans"])[0]
    return out


def test_one_decoding_per_run_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 1000)
    tagger = Tagger(seed=11)
    tagger.p["out"] *= 3.0
    tagger.p["trans"] = np.random.default_rng(1).normal(size=tagger.p["trans"].shape)
    for rows in (4, 2048):
        got = pii.global_tags([pii.coded(t) for t in TEXTS], tagger, rows)
        for text, tags in zip(TEXTS, got, strict=True):
            assert tags[: len(text)].tolist() == _plain(text, tagger).tolist() and not tags[len(text) :].any()


def test_pieces_cover_every_tile_once():
    tile = np.concatenate([np.arange(3, 5), np.arange(10, 300), [400]])
    parts = pii.pieces(tile)
    assert [t for _, _, a, b in parts for t in range(a, b)] == tile.tolist()
    assert all(lo <= a and b <= hi and hi - lo <= pii.PIECE + 2 * pii.MARGIN for lo, hi, a, b in parts)
    assert pii.pieces(tile[:0]) == []


def test_long_runs_in_pieces_agree_with_the_whole(monkeypatch):
    tagger = Tagger(seed=11)
    text = "".join(np.random.default_rng(2).choice(list("0123 ab@."), 6000))
    codes = [pii.coded(text)]
    parts = pii.global_tags(codes, tagger)[0]
    monkeypatch.setattr(pii, "PIECE", 10_000)
    assert (parts == pii.global_tags(codes, tagger)[0]).mean() > 0.999
