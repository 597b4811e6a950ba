"""Force layout. Seeding and spreading are DataFrame operators; the ticks,
each of which needs the one before, run as one kernel a graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import GraphView
from ..runtime import ship
from .field import field, spans

G = "graph_id"
POSITIONS = "graph_id string, idx long, x double, y double"
# Fixed values of the simulation.
GOLDEN = math.radians(137.508)
ALPHA_DECAY, ALPHA_MIN, VELOCITY_DECAY = 0.045, 0.001, 0.65
MAX_TICKS, BATCH, QUIET_MOVE, QUIET_BATCHES = 500, 8, 1e-3, 2
INTRA_STRENGTH, INTER_STRENGTH, CENTER_STRENGTH, COHESION = 0.5, 0.12, 0.005, 0.12
COLLIDE_STRENGTH, MIN_DISTANCE2 = 0.85, 1.0
#: Nodes whose repulsion is summed at a time; nodes up to which all pairs are summed one by one.
BLOCK, PAIRWISE = 16, 3000
#: Largest body of a class as a multiple of its least one, for collisions.
CLASS = 1.5


def seed(members: DataFrame) -> DataFrame:
    """(graph_id, idx, x, y) of (graph_id, idx, community, radius): communities
    by size on a sunflower, and their nodes on a smaller one each."""
    by_size = members.groupBy(G, "community").agg(F.count("*").alias("n"), (F.sqrt(F.count("*").cast("double")) * (F.avg("radius") * 1.5 + 2)).alias("r"))
    order = Window.partitionBy(G).orderBy(F.desc("n"), "community")
    whole = Window.partitionBy(G)
    total, reach = F.sum("n").over(whole), F.sum("r").over(whole)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    angle = (F.row_number().over(order) - 1) * GOLDEN
    far = F.greatest(F.sqrt(total.cast("double")) * 18, reach * 0.8) * F.sqrt(before / total + 0.02)
    centres = by_size.select(G, "community", "n", "r", (F.cos(angle) * far).alias("cx"), (F.sin(angle) * far).alias("cy"))
    placed = members.withColumn("k", F.row_number().over(Window.partitionBy(G, "community").orderBy("idx")) - 1).join(centres, [G, "community"])
    local = F.col("r") * F.sqrt((F.col("k") + 0.5) / F.col("n"))
    turn = F.col("k") * GOLDEN
    return placed.select(G, "idx", (F.col("cx") + F.cos(turn) * local).alias("x"), (F.col("cy") + F.sin(turn) * local).alias("y"))


def spread(positions: DataFrame, communities: DataFrame, factor: float) -> DataFrame:
    """Communities moved away from the centre of all nodes by a factor."""
    both = positions.join(communities, [G, "idx"])
    middle = both.groupBy(G).agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"))
    centre = both.groupBy(G, "community").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    moved = both.join(centre, [G, "community"]).join(F.broadcast(middle), G)
    return moved.select(G, "idx", (F.col("x") + (factor - 1) * (F.col("cx") - F.col("gx"))).alias("x"), (F.col("y") + (factor - 1) * (F.col("cy") - F.col("gy"))).alias("y"))


def progress(alpha: float, ticks: int) -> int:
    """0 to 1000: by the decay of alpha or by ticks, what is further."""
    decay = 1.0 if alpha <= ALPHA_MIN else max(0.0, math.log(alpha) / math.log(ALPHA_MIN))
    return round(1000 * min(1.0, max(decay, ticks / MAX_TICKS)))


class _Jiggle:
    """A linear congruence for points that coincide."""

    def __init__(self):
        self.s = 1

    def __call__(self) -> float:
        self.s = (1664525 * self.s + 1013904223) % (1 << 32)
        return (self.s / (1 << 32) - 0.5) * 1e-6


def _links(a: np.ndarray, b: np.ndarray, n: int):
    count = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    return a, b, count[a] / np.maximum(count[a] + count[b], 1)


def simulate(xy: np.ndarray, radius: np.ndarray, community: np.ndarray, src: np.ndarray, dst: np.ndarray, view: GraphView, factor: float = 1.0, report=None) -> np.ndarray:
    """Positions (n x 2) at rest: repulsion, collision, springs within and
    between communities, centring, cohesion."""
    n, p, v, jiggle = len(xy), xy.astype(float).copy(), np.zeros((len(xy), 2)), _Jiggle()
    charge = -abs(view.repulsion) * 6 * np.sqrt(radius / 5)
    body = radius * 1.5 + 2
    real = src != dst
    same = community[src] == community[dst]
    springs = [(_links(src[real & same], dst[real & same], n), view.nodeDistance, INTRA_STRENGTH), (_links(src[real & ~same], dst[real & ~same], n), view.clusterDistance * max(1.0, math.sqrt(n / 200)), INTER_STRENGTH)]
    sizes = np.bincount(community, minlength=1)
    alpha, ticks, quiet, was = 1.0, 0, 0, p.copy()
    while n and ticks < MAX_TICKS:
        for _ in range(min(BATCH, MAX_TICKS - ticks)):
            alpha -= alpha * ALPHA_DECAY
            _repel(p, v, charge, alpha, jiggle)
            _collide(p, v, body, jiggle)
            for (a, b, bias), distance, strength in springs:
                _pull(p, v, a, b, bias, distance, strength * alpha, jiggle)
            p -= p.mean(0) * CENTER_STRENGTH
            centre = np.stack([np.bincount(community, p[:, k], len(sizes)) for k in (0, 1)], 1) / np.maximum(sizes, 1)[:, None]
            v += np.where((sizes[community] > 1)[:, None], (centre[community] - p) * COHESION * alpha, 0)
            v *= VELOCITY_DECAY
            p += v
            ticks += 1
        if factor != 1:
            centre = np.stack([np.bincount(community, p[:, k], len(sizes)) for k in (0, 1)], 1) / np.maximum(sizes, 1)[:, None]
            p += (factor - 1) * (centre[community] - p.mean(0))
        if report:
            report(progress(alpha, ticks))
        still = np.sqrt(((p - was) ** 2).sum(1).max()) < QUIET_MOVE * max(1.0, np.sqrt((p**2).sum(1).mean()))
        quiet, was = quiet + 1 if still else 0, p.copy()
        if quiet >= QUIET_BATCHES or alpha <= ALPHA_MIN:
            break
    return p


def _repel(p, v, charge, alpha, jiggle):
    if len(p) > PAIRWISE:
        v += field(p, charge * alpha, MIN_DISTANCE2, jiggle)
        return
    x, y = np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1])
    pull = charge * alpha
    for lo in range(0, len(p), BLOCK):
        own = np.arange(lo, min(lo + BLOCK, len(p)))
        dx, dy = x - x[own, None], y - y[own, None]
        d2 = dx * dx
        d2 += dy * dy
        d2[own - lo, own] = np.inf
        for i, j in np.argwhere(d2 == 0):
            dx[i, j], dy[i, j] = jiggle(), jiggle()
            d2[i, j] = dx[i, j] ** 2 + dy[i, j] ** 2
        near = d2 < MIN_DISTANCE2
        if near.any():
            d2[near] = np.sqrt(MIN_DISTANCE2 * np.maximum(d2[near], 1e-300))
        force = np.divide(pull, d2, out=d2)
        v[own, 0] += np.einsum("ij,ij->i", dx, force)
        v[own, 1] += np.einsum("ij,ij->i", dy, force)


def _touching(q, body):
    """Pairs (i < j) nearer than their bodies together. A pair is found in the
    class of its larger body, in cells of twice the largest body there."""
    kind = np.floor(np.log(body / body.min()) / math.log(CLASS)).astype(np.int64)
    found = []
    for k in np.unique(kind):
        pool = np.flatnonzero(kind <= k)
        at = np.floor(q[pool] / (2 * body[kind == k].max())).astype(np.int64)
        at -= at.min(0) - 1
        wide = at[:, 0].max() + 2
        key = at[:, 1] * wide + at[:, 0]
        order = np.argsort(key, kind="stable")
        pool, key = pool[order], key[order]
        x, y, reach, ranks = q[pool, 0], q[pool, 1], body[pool], kind[pool]
        own = np.flatnonzero(ranks == k)
        alone = len(own) == len(pool)  # then half of the cells will do
        for step in (0, wide) if alone else (-wide, 0, wide):
            first = own + 1 if alone and not step else np.searchsorted(key, key[own] + step - 1)
            many = np.searchsorted(key, key[own] + step + 1, "right") - first
            for lo, hi, n, other in spans(first, many):
                one = np.repeat(own[lo:hi], n)
                dx, dy = x[one] - x[other], y[one] - y[other]
                hit = np.flatnonzero(dx * dx + dy * dy < (reach[one] + reach[other]) ** 2)
                one, other = one[hit], other[hit]
                if not alone:
                    once = (ranks[other] < k) | (pool[one] < pool[other])
                    one, other = one[once], other[once]
                found.append((pool[one], pool[other]))
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip((none, none), *found))
    return np.minimum(i, j), np.maximum(i, j)


def _collide(p, v, body, jiggle):
    q, n = p + v, len(p)
    i, j = _touching(q, body)
    d = q[i] - q[j]
    row, side = np.nonzero(d == 0)
    for k in np.lexsort((side, j[row], i[row])):
        d[row[k], side[k]] = jiggle()
    far, reach = np.sqrt((d**2).sum(1)), body[i] + body[j]
    push = d * ((reach - far) / far * COLLIDE_STRENGTH)[:, None]
    share = body[j] ** 2 / (body[i] ** 2 + body[j] ** 2)
    for k in (0, 1):
        v[:, k] += np.bincount(i, push[:, k] * share, n) - np.bincount(j, push[:, k] * (1 - share), n)


def _pull(p, v, a, b, bias, distance, strength, jiggle):
    if not len(a):
        return
    q = p + v
    d = q[b] - q[a]
    d[d == 0] = jiggle()
    far = np.sqrt((d**2).sum(1, keepdims=True))
    d *= (far - distance) / far * strength
    for k, push in enumerate(np.ascontiguousarray(d.T)):
        v[:, k] += np.bincount(a, push * (1 - bias), len(v)) - np.bincount(b, push * bias, len(v))


def layout(members: DataFrame, edges: DataFrame, view: GraphView = GraphView(), start: DataFrame | None = None, factor: float = 1.0) -> DataFrame:
    """(graph_id, idx, x, y) at rest; members as for seed, start for a warm
    start. One task a graph: give very large graphs by community."""
    ship(members.sparkSession)
    placed = members.join(start if start is not None else seed(members), [G, "idx"])
    none = F.lit(None).cast("long")
    rows = placed.select(G, "idx", "community", "radius", "x", "y", none.alias("src"), none.alias("dst")).unionByName(edges.select(G, "src", "dst"), allowMissingColumns=True)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        nodes = g[g["idx"].notna()].sort_values("idx")
        ids = nodes["idx"].to_numpy(np.int64)
        links = g[g["src"].notna()].sort_values(["src", "dst"])
        at = lambda c: np.searchsorted(ids, links[c].to_numpy(np.int64))
        community = np.unique(nodes["community"].to_numpy(np.int64), return_inverse=True)[1]
        p = simulate(nodes[["x", "y"]].to_numpy(float), nodes["radius"].to_numpy(float), community, at("src"), at("dst"), view, factor)
        return pd.DataFrame({G: g[G].iloc[0], "idx": ids, "x": p[:, 0], "y": p[:, 1]})

    return rows.groupBy(G).applyInPandas(kernel, POSITIONS)
