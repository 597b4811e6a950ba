import time

import numpy as np

from meshquill.operators import layout


def plain(p, charge, i):
    d = np.delete(p - p[i], i, 0)
    d2 = (d**2).sum(1)
    return (d * (np.delete(charge, i) / np.where(d2 < 1, np.sqrt(d2), d2))[:, None]).sum(0)


def test_repulsion_of_many_nodes_is_the_whole_sum():
    rng = np.random.default_rng(1)
    even, clumps = rng.random((5000, 2)) * 3000, rng.integers(0, 40, (5000, 2)) * 90 + rng.random((5000, 2)) * 4
    strewn = rng.normal(size=(5000, 2)) * 500
    strewn[:5] *= 1e4
    for p in (even, clumps, strewn, even * [1, 1e-6], even * 1e-4):
        charge, v = -rng.random(len(p)) * 60 - 1, np.zeros((len(p), 2))
        layout._repel(p, v, charge, 0.7, layout._Jiggle())
        for i in (0, 1, 17, 4999):
            assert np.linalg.norm(v[i] - plain(p, charge * 0.7, i)) < 1e-7 * np.linalg.norm(plain(p, charge * 0.7, i)) + 1e-7
    even[7] = even[2500]
    v = np.zeros((len(even), 2))
    layout._repel(even, v, charge, 0.7, layout._Jiggle())
    apart = v[7] - v[2500]
    assert np.isfinite(v).all() and np.abs(apart).max() > 0  # equal points are driven apart


def test_a_tick_does_not_grow_with_the_square_of_the_nodes():
    took = []
    for n in (8_000, 8_000, 32_000):
        rng = np.random.default_rng(2)
        p, v, body, jiggle = rng.random((n, 2)) * 20 * n**0.5, np.zeros((n, 2)), np.full(n, 9.5), layout._Jiggle()
        began = time.process_time()
        layout._repel(p, v, np.full(n, -120.0), 0.7, jiggle)
        layout._collide(p, v * 0, body, jiggle)
        took.append(time.process_time() - began)
    assert took[2] < 9 * took[1]  # 16 times if all pairs are summed


def test_collisions_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    p, body = np.round(rng.normal(size=(400, 2)) * 150), 9.5 + rng.random(400) * 30
    body[:2] = 300, 90
    v = rng.normal(size=(400, 2))
    want = v.copy()
    q = p + v
    for i in range(400):
        for j in range(i + 1, 400):
            d = q[i] - q[j]
            far, reach = np.hypot(*d), body[i] + body[j]
            if far < reach:
                push, share = d * (reach - far) / far * layout.COLLIDE_STRENGTH, body[j] ** 2 / (body[i] ** 2 + body[j] ** 2)
                want[i] += push * share
                want[j] -= push * (1 - share)
    layout._collide(p, v, body, layout._Jiggle())
    assert np.allclose(v, want)
    p, v = np.zeros((2, 2)), np.zeros((2, 2))
    layout._collide(p, v, np.full(2, 9.5), layout._Jiggle())
    assert np.allclose(v[0], -v[1]) and np.hypot(*v[0]) > 1  # equal points
