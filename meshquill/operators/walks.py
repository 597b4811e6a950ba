"""Shortest cycles, chains and owners of graphs whose edges fit one process.

The edges are collected once and sent to all tasks; each task searches from its
share of the starts, so nothing but the results is written. Nodes with one edge
in and one out are folded into the edge between their neighbours: all of them
have the same cycle, from one search. A search goes from both ends at once, and
of equal ways takes the first by edge order.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

G = "graph_id"
#: Edges (of all graphs together) that are searched in one process; beyond, by joins.
KERNEL_EDGES = 1_000_000
#: Steps of cycles sent on at a time.
BATCH_STEPS = 1 << 17


def fits(rows: DataFrame) -> bool:
    return rows.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES


def _offsets(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def _numbered(g: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(graph, index) of the distinct nodes in order, and each end's place there."""
    order = np.lexsort((ends, g))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(g[order]) != 0) | (np.diff(ends[order]) != 0)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(fresh) - 1
    return g[order][fresh], ends[order][fresh], node


def strong(n: int, at: list[int], to: list[int]) -> np.ndarray:
    """A number for each node, equal inside a strongly connected component
    (Tarjan's search without recursion)."""
    index, low, comp, stack, count = [-1] * n, [0] * n, [-1] * n, [], 0
    place = at[:n]
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [root]
        while work:
            u = work[-1]
            if index[u] < 0:
                index[u] = low[u] = count
                count += 1
                stack.append(u)
            for k in range(place[u], at[u + 1]):
                v = to[k]
                if index[v] < 0:
                    place[u] = k
                    work.append(v)
                    break
                if comp[v] < 0:
                    low[u] = min(low[u], low[v])
            else:
                work.pop()
                if low[u] == index[u]:
                    while True:
                        v = stack.pop()
                        comp[v] = u
                        if v == u:
                            break
    return np.array(comp, np.int64)


class Folded:
    """Components of graphs with their chains folded. A unit is a node with more
    than one edge in or out, or a chain."""

    def __init__(self, graph: np.ndarray, src: np.ndarray, dst: np.ndarray):
        """Edges by source, then in edge order."""
        self.graph, self.idx, node = _numbered(np.concatenate((graph, graph)), np.concatenate((src, dst)))
        n, a, b = len(self.idx), node[: len(src)], node[len(src) :]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        comp = strong(n, _offsets(a, n).tolist(), b.tolist())
        a, b = a[comp[a] == comp[b]], b[comp[a] == comp[b]]
        n_in, n_out = np.bincount(b, minlength=n), np.bincount(a, minlength=n)
        inner = n_out > 0
        branch = inner & ((n_in > 1) | (n_out > 1))
        # a component that is one bare cycle: its first node
        bare = np.flatnonzero(inner)[~np.isin(comp[inner], comp[branch])]
        branch[bare[np.unique(comp[bare], return_index=True)[1]]] = True
        at, to, stop = _offsets(a, n).tolist(), b.tolist(), branch.tolist()
        tail, head, chain, ends = [], [], [], []
        for u in np.flatnonzero(branch).tolist():
            for k in range(at[u], at[u + 1]):
                v = to[k]
                while not stop[v]:
                    chain.append(v)
                    v = to[at[v]]
                tail.append(u)
                head.append(v)
                ends.append(len(chain))
        self.tail, self.head = np.array(tail, np.int64), np.array(head, np.int64)
        self.chain, self.chain_at = np.array(chain, np.int64), np.array([0, *ends], np.int64)
        self.branch, self.edge = np.flatnonzero(branch), np.flatnonzero(np.diff(self.chain_at) > 0)

    def __len__(self) -> int:
        return len(self.branch) + len(self.edge)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("out", "into")}

    def _open(self) -> None:
        """Edges out of and into each node, in their order: (node, length, edge)."""
        if not hasattr(self, "out"):
            self.out, self.into = {}, {}
            for e, (a, b, w) in enumerate(zip(self.tail.tolist(), self.head.tolist(), (np.diff(self.chain_at) + 1).tolist())):
                self.out.setdefault(a, []).append((b, w, e))
                self.into.setdefault(b, []).append((a, w, e))

    def way(self, x: int, y: int) -> tuple[int, list[int]]:
        """(length, edges) of the shortest way of an edge or more from x to y
        in a component; of equal ones the first by edge order."""
        out, into = self.out, self.into
        ahead, back, near, far = {}, {}, {x: 0}, {y: 0}
        fore, rear, best, meets = [(0, x)], [(0, y)], None, []
        while not ahead or (fore and rear and (best is None or fore[0][0] + rear[0][0] <= best)):
            forward = bool(back) and (not ahead or len(fore) <= len(rear))  # both ends first
            queue, done, other, reached, links = (fore, ahead, back, near, out) if forward else (rear, back, ahead, far, into)
            d, u = heappop(queue)
            if u in done:
                continue
            done[u] = d
            for v, w, _ in links[u]:
                to = d + w
                if v in other:
                    whole = to + other[v]
                    if best is None or whole < best:
                        best, meets = whole, []
                    if whole == best:
                        meets.append(u if forward else v)
                if v not in done and to < reached.get(v, to + 1):
                    reached[v] = to
                    heappush(queue, (to, v))
        # nodes met from x that lie on a shortest way
        good, todo = set(meets), meets
        while todo:
            u = todo.pop()
            for v, w, _ in into[u]:
                if v not in good and ahead.get(v) == ahead[u] - w:
                    good.add(v)
                    todo.append(v)
        u, d, path = x, 0, []
        while d < best:
            for v, w, e in out[u]:
                if back.get(v) == best - d - w or (v in good and ahead[v] == d + w):
                    path.append(e)
                    u, d = v, d + w
                    break
        return best, path

    def _steps(self, x: int, path: list[int]) -> list[np.ndarray]:
        """x and the nodes after it, without the last."""
        parts = [[x]]
        for e in path:
            parts += [self.chain[self.chain_at[e] : self.chain_at[e + 1]], self.head[e : e + 1]]
        return parts[:-1]

    def cycle(self, unit: int) -> tuple[int, np.ndarray]:
        """(graph, indices) of the cycle of a unit, a chain's from its least index."""
        self._open()
        k = unit - len(self.branch)
        if k < 0:
            x = int(self.branch[unit])
            nodes = np.concatenate(self._steps(x, self.way(x, x)[1]))
        else:
            e = self.edge[k]
            a, b = int(self.tail[e]), int(self.head[e])
            own = self.chain[self.chain_at[e] : self.chain_at[e + 1]]
            at = int(own.argmin())
            rest = [[b]] if a == b else [*self._steps(b, self.way(b, a)[1]), [a]]
            nodes = np.concatenate([own[at:], *rest, own[:at]])
        return int(self.graph[nodes[0]]), self.idx[nodes]

    def length(self, unit: int) -> tuple[int, np.ndarray, int]:
        """(graph, indices of the unit's nodes, length of their shortest cycle)."""
        self._open()
        k = unit - len(self.branch)
        if k < 0:
            x = int(self.branch[unit])
            own, n = self.branch[unit : unit + 1], self.way(x, x)[0]
        else:
            e = self.edge[k]
            a, b = int(self.tail[e]), int(self.head[e])
            own = self.chain[self.chain_at[e] : self.chain_at[e + 1]]
            n = len(own) + 1 + (0 if a == b else self.way(b, a)[0])
        return int(self.graph[own[0]]), self.idx[own], n


def _collected(edges: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(names of graphs, graph, src, dst) of the edges by source, then in edge order."""
    found = edges.orderBy(G, "src", "eidx").select(G, "src", "dst").toArrow().combine_chunks()
    names = found[G].combine_chunks().dictionary_encode()
    return names.dictionary.to_pylist(), names.indices.to_numpy().astype(np.int64), found["src"].to_numpy().astype(np.int64), found["dst"].to_numpy().astype(np.int64)


def _dealt(spark: SparkSession, n: int, f, schema: str) -> DataFrame:
    """Rows that f makes of numbers under n, which are dealt to tasks in turn."""
    ship(spark)
    tasks = max(1, min(n, 8 * spark.sparkContext.defaultParallelism))

    def work(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from f(range(k, n, tasks))

    return spark.range(0, tasks if n else 0, 1, tasks).mapInArrow(work, schema)


def cycles(edges: DataFrame, on_first=None) -> DataFrame:
    """(graph_id, start, cycle): the shortest cycle through each node of a
    component; of a chain, through the node of the least index."""
    spark = edges.sparkSession
    names, *rows = _collected(edges)
    folded = Folded(*rows)
    if on_first and len(folded):
        g, nodes = folded.cycle(0)
        on_first(spark.createDataFrame([(names[g], int(nodes[0]), nodes.tolist())], f"{G} string, start long, cycle array<long>"))
    sent = spark.sparkContext.broadcast((names, folded))

    def search(units):
        names, folded = sent.value
        ids, parts, held = [], [], 0

        def rows():
            at = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([int(p[0]) for p in parts], pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts)))], names=[G, "start", "cycle"])

        for unit in units:
            g, nodes = folded.cycle(unit)
            ids.append(names[g])
            parts.append(nodes)
            held += len(nodes)
            if held >= BATCH_STEPS:
                yield rows()
                ids, parts, held = [], [], 0
        if parts:
            yield rows()

    return _dealt(spark, len(folded), search, f"{G} string, start long, cycle array<long>")


def lengths(edges: DataFrame) -> DataFrame:
    """(graph_id, idx, length) of every node on a cycle."""
    spark = edges.sparkSession
    names, *rows = _collected(edges)
    folded = Folded(*rows)
    sent = spark.sparkContext.broadcast((names, folded))

    def search(units):
        names, folded = sent.value
        for unit in units:
            g, own, n = folded.length(unit)
            yield pa.RecordBatch.from_arrays([pa.array([names[g]] * len(own)), pa.array(own), pa.array([n] * len(own), pa.int32())], names=[G, "idx", "length"])

    return _dealt(spark, len(folded), search, f"{G} string, idx long, length int")


def chains(wanted: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(graph_id, start, goal, group) of wanted (graph_id, start, goal): nodes of
    owner start on the first shortest way from start to a node of owner goal."""
    spark = edges.sparkSession
    names, graph, src, dst = _collected(edges.join(owner.select(G, F.col("idx").alias("dst")), [G, "dst"], "left_semi"))
    code = {name: k for k, name in enumerate(names)}
    reps, links, goals = {}, {}, {}
    for g, idx, rep in owner.select(G, "idx", "rep").toArrow().to_pandas().itertuples(index=False):
        if g in code:
            reps[code[g], idx] = rep
    for g, a, b in zip(graph.tolist(), src.tolist(), dst.tolist()):
        links.setdefault((g, a), []).append(b)
    for g, a, b in wanted.select(G, "start", "goal").toArrow().to_pandas().itertuples(index=False):
        if g in code:
            goals.setdefault((code[g], a), set()).add(b)
    sent = spark.sparkContext.broadcast((names, links, reps, list(goals.items())))

    def search(units):
        names, links, reps, goals = sent.value
        for unit in units:
            (g, start), left = goals[unit]
            left, found, came, queue = set(left), {}, {start: None}, deque([start])
            while queue and left:
                u = queue.popleft()
                for v in links.get((g, u), ()):
                    rep = reps[g, v]
                    if rep in left:
                        left.discard(rep)
                        way, at = [], u
                        while at is not None:
                            way.append(at)
                            at = came[at]
                        found[rep] = way[::-1]
                    if rep == start and v not in came:
                        came[v] = u
                        queue.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([names[g]] * len(found), pa.string()), pa.array([start] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=[G, "start", "goal", "group"])

    return _dealt(spark, len(goals), search, f"{G} string, start long, goal long, group array<long>")


def owners(edges: DataFrame) -> DataFrame:
    """(graph_id, idx, rep) of hidden nodes that have an owner, by the rule of
    contract.owners. edges: graph_id, eidx, src, dst, h_src (whether src is
    hidden), of edges into hidden nodes."""
    spark = edges.sparkSession
    found = edges.orderBy(G, "eidx").select(G, "src", "dst", "h_src").toArrow().combine_chunks()
    code = found[G].combine_chunks().dictionary_encode()
    names, graph = code.dictionary.to_pylist(), code.indices.to_numpy().astype(np.int64)
    n = len(graph)
    of, idx, node = _numbered(np.concatenate((graph, graph)), np.concatenate([found[c].to_numpy() for c in ("src", "dst")]))
    src, dst, inner = node[:n], node[n:], found["h_src"].to_numpy()
    # the first edge from a visible node is the earliest arrival, at pass 0
    at = np.flatnonzero(~inner)
    rep = np.full(len(idx), -1, np.int64)
    first, where = np.unique(dst[at], return_index=True)
    rep[first] = src[at[where]]
    # edges between hidden nodes by source, then in edge order
    inside = np.flatnonzero(inner)
    inside = inside[np.argsort(src[inside], kind="stable")]
    place, rank, to = _offsets(src[inside], len(idx)).tolist(), inside.tolist(), dst[inside].tolist()
    queue = [(1, rank[k], u, to[k]) for u in first.tolist() for k in range(place[u], place[u + 1])]
    heapify(queue)
    own = rep.tolist()
    while queue:
        turn, edge, u, v = heappop(queue)
        if own[v] < 0:
            own[v] = own[u]
            for k in range(place[v], place[v + 1]):
                if own[to[k]] < 0:
                    heappush(queue, (turn if rank[k] > edge else turn + 1, rank[k], v, to[k]))
    rep = np.array(own, np.int64)
    hit = np.flatnonzero(rep >= 0)
    sent = spark.sparkContext.broadcast((names, of[hit], idx[hit], idx[rep[hit]]))

    def rows(units):
        names, *columns = sent.value
        graph, idx, rep = (c[units.start : units.stop : units.step] for c in columns)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(graph)), pa.array(idx), pa.array(rep)], names=[G, "idx", "rep"])

    return _dealt(spark, len(hit), rows, f"{G} string, idx long, rep long")
