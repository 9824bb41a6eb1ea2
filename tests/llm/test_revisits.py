"""Revisit resolution against brute force, with hot payloads, ties and null ids."""

from __future__ import annotations

import hashlib
import random

import pytest

from hearthline.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def _pages() -> list[tuple]:
    rng = random.Random(9)
    bodies = [("x%d " % i) * (300 + i) for i in range(40)]
    rows = [(i, f"http://a/{i}", bodies[min(int(rng.expovariate(0.2)), 39)]) for i in range(300)]
    rows += [(1000 + i, None, "hot " * 400) for i in range(200)]
    rows += [(1199, "again", "hot " * 400), (None, "no id", "hot " * 400), (None, "no id", "none " * 300), (None, "no id", "none " * 300)]
    rows += [(2000 + i, "small", "short") for i in range(3)] + [(3000, "empty", ""), (3001, "null", None)]
    return rows


def _expected(rows: list[tuple]) -> list[tuple]:
    largest: dict = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= warc.MIN_REVISIT:
            largest[html] = max(page, largest.get(html, page))
    out = []
    for page, url, html in rows:
        keeper = largest.get(html)
        out.append((page, url, hashlib.sha1((html or "").encode()).hexdigest(), None if keeper == page else keeper))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [False, True])
def test_resolution_equals_brute_force_and_responses_keep_their_bodies(spark, monkeypatch, crowded):
    """Also with bit maps of one word, which let nearly everything through."""
    if crowded:
        whole = common.bit_map
        monkeypatch.setattr(common, "bit_map", lambda wanted, key, words: whole(wanted, key, 1))
    rows = _pages()
    found = warc.resolve(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r["page_id"], r["url"], r["payload_digest"], r["refers_to"]) for r in found), key=str) == _expected(rows)
    for r in found:
        if r["refers_to"] is None:
            assert hashlib.sha1(r["html"].encode()).hexdigest() == r["payload_digest"]
    if not crowded:
        assert sum(r["html"] is not None for r in found if r["refers_to"] is not None) <= 3


def test_archives_hold_every_page_once(spark):
    rows = _pages()
    read = warc.archive_pages(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = _expected(rows)
    assert sorted(((r["page_id"], r["payload_digest"], r["refers_to"]) for r in read), key=str) == sorted(((p, d, k) for p, _, d, k in want), key=str)
    sizes = {hashlib.sha1((h or "").encode()).hexdigest(): len((h or "").encode()) for _, _, h in rows}
    assert all(r["payload_bytes"] == sizes[r["payload_digest"]] and (r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in read)
