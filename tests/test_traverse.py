import random

from graphs import arrows, graph, names, node
from meshquill.model import GraphView
from meshquill.operators import bundle, contract, filters, lookups, traverse, walks


def test_orphans(spark):
    cases = {"a>b b>c": "abc", "a>b b>a": "", "s>a a>b b>a": "s", "a>b c>b": "abc", "x a>b b>a": "x"}
    for text, expected in cases.items():
        t = arrows(spark, text)
        assert "".join(names(t, traverse.orphans(t.nodes, t.edges))) == expected, text
        assert traverse.has_any_orphan(t.nodes, t.edges).first()["has_orphan"] == bool(expected)
    t = arrows(spark, "s>m m>e")
    roots = filters.roots(t, GraphView(rootNodes=("s", "unknown")))
    assert names(t, traverse.orphans(t.nodes, t.edges, roots)) == []
    t = arrows(spark, "a>b b>a", types="test")
    hidden = filters.edge_type_filter(t.edges, frozenset({1}))
    assert names(t, traverse.orphans(t.nodes, hidden)) == ["a", "b"]
    assert traverse.has_any_cycle(t.nodes, hidden).first()["has_cycle"] is False


def _cycles(t, edges=None):
    ids = {r["idx"]: r["id"] for r in t.nodes.collect()}
    rows = traverse.shortest_cycles(t.edges if edges is None else edges).orderBy("seq").collect()
    return ["".join(ids[x] for x in r["cycle"]) for r in rows]


def test_cycles(spark):
    for text, expected in {"a>b b>c": [], "a>a": [], "a>b b>a": ["ab"], "a>b b>c c>a": ["abc"], "a>b b>a b>c c>d d>c": ["ab", "cd"]}.items():
        t = arrows(spark, text)
        assert _cycles(t) == expected, text
        assert traverse.has_any_cycle(t.nodes, t.edges).first()["has_cycle"] == bool(expected)


def _queue_search(n, edges, comp):
    """Shortest cycle through each node by a plain queue in edge order."""
    out = []
    for s in range(n):
        if s not in comp:
            continue
        seen, queue, done = {s: None}, [s], None
        while queue and done is None:
            u = queue.pop(0)
            for a, b in edges:
                if a != u or comp.get(b) != comp[s]:
                    continue
                if b == s:
                    done = u
                    break
                if b not in seen:
                    seen[b] = u
                    queue.append(b)
        path = []
        while done is not None:
            path.append(done)
            done = seen[done]
        out.append(path[::-1])
    return out


def test_random_graphs_against_sequential_rules(spark):
    rng = random.Random(5)
    n = 9
    nodes = []
    for v in range(n):
        nodes.append(node(f"n{v}", [f"n{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 2, 3]))], type=rng.choice(["f", "p"])))
    t = graph(spark, *nodes)
    edges = [(r["src"], r["dst"]) for r in t.edges.orderBy("eidx").collect()]
    reach = {v: set() for v in range(n)}
    for v in range(n):
        todo = [v]
        while todo:
            u = todo.pop()
            for a, b in edges:
                if a == u and b not in reach[v]:
                    reach[v].add(b)
                    todo.append(b)
    comp = {v: max(u for u in reach[v] if v in reach[u]) for v in range(n) if v in reach[v]}
    assert {r["idx"]: r["scc"] for r in traverse.components(t.edges).collect()} == comp
    raw = traverse.lexmin_paths(traverse.components(t.edges).selectExpr("graph_id", "idx start", "idx goal"), t.edges.select("graph_id", "eidx", "src", "dst"))
    found = {r["start"]: [s["src"] for s in r["path"]] for r in raw.collect()}
    assert [found[s] for s in sorted(found)] == _queue_search(n, edges, comp)
    # owners, by passes over the edges in place
    hidden = [r["type"] == "f" for r in t.nodes.orderBy("idx").collect()]
    owner = [-1] * n
    for a, b in edges:
        if hidden[b] and not hidden[a] and owner[b] < 0:
            owner[b] = a
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if hidden[a] and hidden[b] and owner[a] >= 0 and owner[b] < 0:
                owner[b], moved = owner[a], True
    fid = t.node_types.filter("name = 'f'").first()["type_id"]
    con = contract.contraction(t, GraphView(hiddenNodeTypes=frozenset({fid})), lookups.radii(t))
    reps = {r["idx"]: -1 if r["rep"] is None else r["rep"] for r in con.collect()}
    assert reps == {v: owner[v] if hidden[v] else v for v in range(n)}


def _view(t, kind="file", **more):
    hit = t.node_types.filter(f"name = '{kind}'").first()
    return GraphView(hiddenNodeTypes=frozenset({hit["type_id"]}), **more)


def _reps(spark, t, view):
    ids = {r["idx"]: r["id"] for r in t.nodes.collect()}
    con = contract.contraction(t, view, lookups.radii(t))
    return con, {ids[r["idx"]]: ids.get(r["rep"]) for r in con.collect()}


def test_contraction(spark):
    t = graph(spark, node("pkg", ["f"], type="package"), node("f", type="file"), node("g", type="file"))
    assert contract.contraction(t, GraphView(), lookups.radii(t)) is None
    con, reps = _reps(spark, t, _view(t))
    assert reps == {"pkg": "pkg", "f": "pkg", "g": None}
    assert [round(r["eff_radius"] ** 2, 6) for r in con.orderBy("idx").collect()] == [50.0, 0.0, 0.0]
    assert _reps(spark, t, _view(t, collapsed=("pkg",)))[1]["f"] == "f"
    assert _reps(spark, t, GraphView(hiddenNodes=("pkg",)))[1] == {"pkg": None, "f": "f", "g": "g"}
    t = graph(spark, node("a", ["ghost"], type="p"), node("b", ["ghost"], type="p"))
    assert _reps(spark, t, _view(t, "missing"))[1]["ghost"] is None


def test_contraction_may_invent_cycles(spark):
    f = {"type": "file"}
    t = graph(spark, node("A", ["a1", "a2"]), node("B", ["b1", "b2"]), node("a1", ["b1"], **f), node("a2", **f), node("b1", **f), node("b2", ["a2"], **f))
    con, _ = _reps(spark, t, _view(t))
    assert _cycles(t) == []
    assert _cycles(t, contract.contracted_edges(t.edges, con)) == ["AB"]


def test_bundles(spark):
    f = {"type": "file"}
    t = graph(spark, node("a", ["b", "c"]), node("b", ["c"], **f), node("c", ["e"], **f), node("d", ["e", "f"]), node("e", ["b"], **f), node("f", **f))
    con, _ = _reps(spark, t, _view(t))
    ids = {r["idx"]: r["id"] for r in t.nodes.collect()}
    rows = bundle.bundle_raw(traverse.shortest_cycles(t.edges), con).collect()
    assert [sorted(ids[x] for x in r["cycle"]) for r in rows] == [["a", "d"]]
    t = graph(spark, node("p", ["x"]), node("q", ["y"]), node("x", ["q"], **f), node("y", ["p"], **f))
    con, _ = _reps(spark, t, _view(t))
    ids = {r["idx"]: r["id"] for r in t.nodes.collect()}
    inner = contract.contracted_edges(t.edges, con)
    named = bundle.named(bundle.bundle_contracted(traverse.shortest_cycles(inner), t.edges, con))
    row = named.collect()
    assert [[[ids[x] for x in g] for g in r["groups"]] for r in row] == [[["p", "x"], ["q", "y"]]]
    entry = bundle.entries(named, t.nodes).first()
    assert entry["ids"] == ["p", "q"] and entry["files"] == [["x"], ["y"]] and entry["label"] == ""
    assert bundle.internal_cycles(traverse.shortest_cycles(t.edges), con, 0).count() == 0


def test_chains_bare_cycles_and_ties(spark, monkeypatch):
    """Of equal ways back the first by edge order; a bare cycle once, from its
    first node; no round of joins."""
    monkeypatch.setattr(traverse, "settle", None)
    t = arrows(spark, "a>b b>c c>d d>a b>e e>d d>f f>b p>q q>r r>s s>t t>u u>p x>y y>x y>z")
    assert _cycles(t) == ["xy", "abcd", "edab", "fbcd", "pqrstu"]
    assert sorted(r["length"] for r in traverse.shortest_cycle_lengths(t.edges).collect()) == [2] * 2 + [4] * 6 + [6] * 6


def test_long_cycle_is_one_search(spark, monkeypatch):
    """Two cycles of 700 nodes that share one: nothing is written on the way."""
    monkeypatch.setattr(traverse, "settle", None)
    n = 700
    rows = [("g", (k * 7) % 1399, (k * 7) % 1399, (k * 7 + 7) % 1399 if k + 1 < n else 0) for k in range(n)] + [("g", (k * 7) % 1399 if k >= n else 2000, (k * 7) % 1399 if k >= n else 0, (k * 7 + 7) % 1399 if k + 1 < 1399 else 0) for k in range(n - 1, 1399)]
    edges = spark.createDataFrame(rows, "graph_id string, eidx long, src long, dst long")
    found = traverse.shortest_cycles(edges).collect()
    assert sorted(len(r["cycle"]) for r in found)[0] == 700 and traverse.shortest_cycle_lengths(edges).count() == 1399
    assert all(len(set(r["cycle"])) == len(r["cycle"]) for r in found)


def test_owners_along_a_long_chain(spark, monkeypatch):
    """A chain whose edges stand against their order takes a pass a node, but
    nothing is written in between; the joins give the same owners."""
    calls, settle = [], contract.settle
    monkeypatch.setattr(contract, "settle", lambda df: calls.append(1) or settle(df))
    n = 40
    mask = spark.createDataFrame([(g, v, False, v > 0) for g in "gh" for v in range(n + 2)], "graph_id string, idx long, id_hidden boolean, hidden boolean")
    rows = [("g", n - v, v, v + 1) for v in range(n)] + [("h", v, v, v + 1) for v in range(n)]
    edges = spark.createDataFrame(rows, "graph_id string, eidx long, src long, dst long")
    found = sorted(map(tuple, contract.owners(mask, edges).collect()))
    assert found == [(g, v, 0) for g in "gh" for v in range(1, n + 1)]
    assert len(calls) < 4
    assert contract.owners(mask, edges.limit(0)).count() == 0
    few = edges.filter("src < 5")
    here = sorted(map(tuple, contract.owners(mask, few).collect()))
    monkeypatch.setattr(walks, "KERNEL_EDGES", -1)
    assert sorted(map(tuple, contract.owners(mask, few).collect())) == here
