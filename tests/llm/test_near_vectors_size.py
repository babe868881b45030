"""What a join job of ``op9`` holds, and when a label is cut into cells."""

import tracemalloc

import numpy as np
import pyarrow as pa

from brindle.llm import near_vectors as nv


def _job(x, home):
    n = len(x)
    vectors = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.astype(np.float32).ravel()))
    zero = pa.array(np.zeros(n, np.int32))
    return pa.table([pa.array(np.arange(n)), vectors, pa.array(np.ones(n, np.int64)), pa.array(home), zero, zero, zero], names=["rep", "vector", "copies", "home", "block", "low", "high"])


def test_a_job_holds_tiles_and_not_all_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 8))
    x[3000:] = x[:3000] + rng.normal(size=(3000, 8)) * 0.01
    home = np.arange(6000) % 3 != 0
    table = _job(x, home)
    tracemalloc.start()
    out = nv._join_job(table, 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000
    unit = nv._unit(table.column("vector").combine_chunks())
    linked = (unit @ unit.T >= 0.93) & (home[:, None] | home[None, :])
    np.fill_diagonal(linked, False)
    assert dict(zip(out["rep"].to_pylist(), out["links"].to_pylist())) == {i: n for i, n in enumerate(linked.sum(axis=1).tolist()) if n}


def test_cells_only_where_they_prune():
    rng = np.random.default_rng(1)
    even = rng.normal(size=(60, 64))
    even /= np.sqrt((even * even).sum(axis=1))[:, None]
    assert not nv._prunes(even[:30], even[30:], 0.374)
    grouped = np.repeat(np.eye(64)[:20], 3, axis=0) + rng.normal(size=(60, 64)) * 0.01
    grouped /= np.sqrt((grouped * grouped).sum(axis=1))[:, None]
    assert nv._prunes(grouped[::3], grouped[1::3], 0.374)
