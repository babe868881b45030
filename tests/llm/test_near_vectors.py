import numpy as np
import pytest

from brindle.llm import near_vectors as nv


def brute(rows):
    good = [k for k, (i, v, g) in enumerate(rows) if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        least[r] = i if r not in least else min(least[r], i)
    return sorted((str(i), links[k], str(least[find(k)]), i is None or i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize(("cell", "block"), [(2000, 3000), (40, 3000), (60, 25)])
def test_like_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(nv, "CELL_ROWS", cell)
    monkeypatch.setattr(nv, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows = []
    centres = rng.normal(size=(12, 8))
    for k in range(500):
        v = centres[k % 12] + rng.normal(size=8) * (0.35 if k % 3 else 0.02)
        rows.append((k * 2, (v * (1 + k % 5)).astype(np.float32).tolist(), int(k % 4 == 0)))
    rows += [(2001 + k, rows[12][1], 1) for k in range(30)] + [(3000 + k, [2 * x for x in rows[12][1]], 1) for k in range(3)]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 8, 1), (4003, [1.0, None] + [0.0] * 6, 1), (4004, [float("nan")] + [1.0] * 7, 1), (4005, [float("inf")] + [1.0] * 7, 1), (4006, rows[3][1], None), (4007, rows[3][1], 7), (None, rows[3][1], 0), (4008, rows[3][1][:7], 0), (4009, [-0.0, 1.0] + [0.0] * 6, 3), (4010, [0.0, 1.0] + [-0.0] * 6, 3)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in nv.near_vectors(table).collect())
    assert got == brute(rows)
    assert nv.near_vectors(table.limit(0)).count() == 0
