"""Operator 9: components of the links that are found."""

import math

import numpy as np
import pytest

from thalweg.llm import embedding_dedup

from .test_near import components


@pytest.mark.parametrize("block", [2000, 20])
def test_embedding_components(spark, monkeypatch, block):
    """Stars and chains whose ends are unlike: where all links are found, components are those of the links, exactly."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r, d, rows = np.random.default_rng(5), 48, []
    unit = lambda x: x / np.linalg.norm(x)
    for shape in ["star"] * 60 + ["chain"] * 25:
        hub = unit(r.standard_normal(d))
        for i in range(3 if shape == "star" else 6):
            side = r.standard_normal(d)
            side = unit(side - (side @ hub) * hub)
            leaf = 0.925 * hub + math.sqrt(1 - 0.925**2) * side
            rows.append(leaf)
            hub = leaf if shape == "chain" else hub
        rows += [hub] if shape == "star" else []
    x = np.array(rows)[r.permutation(len(rows))].astype(np.float32)
    exact = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = [(a, b) for a, b in zip(*np.nonzero(np.triu(exact @ exact.T >= 0.9, 1)), strict=True)]
    got = {g.vec_id: g for g in embedding_dedup.embedding_near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3)).collect()}
    want = np.bincount(np.array(links).ravel(), minlength=len(x))
    assert len(links) >= 300 and [got[i].n_links for i in range(len(x))] == want.tolist()
    root = components(range(len(x)), links)
    assert {i: (g.component_id, g.kept) for i, g in got.items()} == {i: (root[i], root[i] == i) for i in root}
