import math
import threading

from graphs import arrows, graph, node
from meshquill.model import GraphView
from meshquill.operators import bundle, contract, filters, geometry, lookups, traverse
from meshquill.plans.session import LatestWins
from meshquill.sources import json_graph


def test_latest_request_wins(spark):
    s, gate, ran = LatestWins(spark), threading.Event(), []
    first = s.submit(lambda: gate.wait(20) and "first")
    middle, newest = s.submit(lambda: ran.append("middle")), s.submit(lambda: spark.range(5).count())
    gate.set()
    assert first.result(20) == "first" and newest.result(60) == 5
    assert middle.cancelled() and not ran and s.last == 5
    assert isinstance(s.submit(lambda: 1 / 0).exception(20), ZeroDivisionError) and s.last == 5


def test_stale_results_are_dropped(spark):
    s, gate = LatestWins(spark), threading.Event()
    old = s.submit(lambda: gate.wait(20) and "old")
    s.invalidate()
    gate.set()
    assert old.result(20) is None and s.last is None
    assert s.submit(lambda: "new").result(20) == "new" and s.last == "new"


def test_first_cycle_signal_comes_once(spark):
    t, seen = arrows(spark, "a>b b>a c>d d>e e>c x>y"), []
    found = traverse.shortest_cycles(t.edges, on_first=lambda first: seen.append(first.count())).collect()
    assert sorted(len(r["cycle"]) for r in found) == [2, 3] and len(seen) == 1
    assert traverse.shortest_cycles(arrows(spark, "a>b").edges, on_first=seen.append).count() == 0 and len(seen) == 1


def test_cycles_only_looks_at_the_contraction(spark):
    """p1 and p2 form a cycle through their files; p3 has one inside it only."""
    file = lambda n, *to: node(n, to, type="file")
    t = graph(spark, node("p1", ["f"], type="pkg"), node("p2", ["g"], type="pkg"), node("p3", ["h"], type="pkg"), file("f", "p2"), file("g", "p1"), file("h", "i"), file("i", "h"))
    view = GraphView(hiddenNodeTypes=frozenset({2}), cyclesOnly=True)
    con = contract.contraction(t, view, lookups.radii(t))
    names = {r["idx"]: r["id"] for r in t.nodes.collect()}
    assert {names[r["idx"]] for r in filters.cycles_only(t, view, con).collect()} == {"p1", "p2"}
    assert filters.cycles_only(t, GraphView(), None).count() == 7


def test_owners_follow_the_edge_that_came_first(spark):
    """y's owner is that of the node whose edge reached it, however that node's
    own owner was found."""
    t = graph(spark, node("A", ["m"], type="v"), node("B", ["n"], type="v"), node("n", ["x"], type="h"), node("m", ["z"], type="h"), node("z", ["x"], type="h"), node("x", ["y"], type="h"), node("y", type="h"))
    con = contract.contraction(t, GraphView(hiddenNodeTypes=frozenset({2})), lookups.radii(t))
    names = {r["idx"]: r["id"] for r in t.nodes.collect()}
    assert {names[r["idx"]]: names[r["rep"]] for r in con.collect() if r["hidden"]} == {"n": "B", "m": "A", "z": "A", "x": "B", "y": "B"}


def test_headers_and_frames(spark):
    rows = [("a", "1", True), ("a", "2", True), ("b", "1", True), ("b", "2", False), ("c", None, None), ("d", "1", None)]
    got = bundle.all_collapsed(spark.createDataFrame(rows, "graph_id string, cycle_id string, collapsed boolean")).collect()
    assert {r["graph_id"]: r["all_collapsed"] for r in got} == {"a": True, "b": False, "c": False, "d": False}
    move = spark.createDataFrame([(0.0, 0.0, 1.0, 8.0, -4.0, 16.0)], "from_x double, from_y double, from_zoom double, to_x double, to_y double, to_zoom double")
    frames = [(r["x"], r["y"], r["zoom"]) for r in geometry.eased_frames(move, 4).orderBy("frame").collect()]
    expected = [(8 * t, -4 * t, 16**t) for t in (0, 1 / 16, 0.5, 15 / 16, 1)]
    assert all(math.isclose(a, b, abs_tol=1e-9) for x, y in zip(frames, expected) for a, b in zip(x, y))


def test_named_datasets(spark):
    assert json_graph.load_named(spark, "hub").nodes.count() > 0
