import tracemalloc

import numpy as np

from meshquill.operators import layout


def test_repulsion_is_the_whole_sum_in_small_blocks():
    rng = np.random.default_rng(1)
    p, charge, v = rng.normal(size=(2000, 2)) * 500, -rng.random(2000) * 60, np.zeros((2000, 2))
    tracemalloc.start()
    layout._repel(p, v, charge, 0.7, layout._Jiggle())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in (0, 17, 1999):
        d = np.delete(p - p[i], i, 0)
        d2 = (d**2).sum(1)
        d2 = np.where(d2 < 1, np.sqrt(d2), d2)
        assert np.allclose(v[i], (d * (np.delete(charge, i) * 0.7 / d2)[:, None]).sum(0))
    assert peak < 4 << 20  # blocks stay in a core's cache
