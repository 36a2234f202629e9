import numpy as np
import pytest

from mediasift.llm import grid_join as g

from .brute import smallest_reachable

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, copies int"


def brute(rows):
    def usable(v):
        return v is not None and None not in v and len(v) > 0 and np.isfinite(v).all() and np.any(np.array(v) != 0)

    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, l in rows if usable(v) and l is not None}
    label = {i: l for i, _, l in rows}
    links = [
        (a, b) for a in unit for b in unit
        if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    ]
    n = {i: sum(i in p for p in links) for i, _, _ in rows}
    return n, smallest_reachable(label, links)


@pytest.mark.parametrize("block", [16, 1024])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(g, "BLOCK", block)
    monkeypatch.setattr(g, "RUN", 8)
    random = np.random.default_rng(4)
    rows, centers = [], random.normal(size=(12, 16))
    for i in range(420):
        v = centers[i % 12] + random.normal(size=16) * (0.04 if i % 3 else 0.5)
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(500 + i, rows[5][1], rows[5][2]) for i in range(40)]  # equal vectors
    rows += [(600, [2 * x for x in rows[5][1]], rows[5][2]), (601, rows[5][1], None), (602, rows[5][1], 9)]
    rows += [(603, None, 1), (604, [], 1), (605, [0.0] * 16, 1), (606, [float("nan")] * 16, 1), (607, [float("inf")] + [1.0] * 15, 1)]
    rows += [(608, [None] + [1.0] * 15, 1), (609, [1.0, 2.0], 1), (610, [1.0, 2.0001], 1), (611, [1e30, 1e30], 1), (612, [1e-30, 1e-30], 1)]
    got = {r["vec_id"]: r for r in g.vector_links(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3)).collect()}
    n, classes = brute(rows)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], classes[i], classes[i] == i) for i in n}


def test_odd_rows(spark):
    rows = [(None, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (2, [0.0, 1.0], 1, "", 0)]
    got = sorted(g.vector_links(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in got) == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]
    assert g.vector_links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_distant_runs_are_skipped():
    x = g.unit(np.random.default_rng(0).normal(size=(256, 8)) * 0.01 + np.eye(8)[0])
    y = g.unit(np.random.default_rng(1).normal(size=(256, 8)) * 0.01 + np.eye(8)[1])
    assert not g.join_blocks(x, x, y, y, 0.98, 0.2).any()
    assert g.join_blocks(x, x, x, x, 0.98, 0.2).all()
