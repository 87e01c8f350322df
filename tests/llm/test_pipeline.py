"""The pipeline on the smallest tables, and its stages against plain loops."""

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert oracle.differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], oracle.duck(SF)) == ""


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = out.count()
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert docs.count() >= seen["mixing"] > 0 and seen["near_duplicates"] < seen["toxicity"] < seen["language"]
    sequences = {}
    for r in docs.collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(np.frombuffer(r["ids"], "<u4")) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in sequences.values():
        assert sum(n for _, n in rows) == max(o + n for o, n in rows) <= 2048


def test_near_duplicates_stage_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    ids, changed = sorted(sets), True
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    assert kept == {i for i in ids if group[i] == i}
