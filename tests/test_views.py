import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import arrows, graph, node
from meshquill.functions import display, globs, keys
from meshquill.model import GraphView
from meshquill.operators import community, geometry, layout, lookups
from meshquill.sources import generators
from meshquill.streaming import ingest


def test_globs(spark):
    cases = [("src/*", "src/a/b/c.ts", True), ("?.ts", "a.ts", True), ("?.ts", "ab.ts", False), ("foo.ts", "fooxts", False), ("a*", "a\nb\n", True), ("a", "a\n", False), ("[x](1)+", "[x](1)+", True)]
    df = spark.createDataFrame([(p, s) for p, s, _ in cases], "p string, s string")
    for p, s, expected in cases:
        got = df.filter((F.col("p") == p) & (F.col("s") == s)).select(globs.matches_any(F.col("s"), [p]).alias("m")).first()["m"]
        assert got == expected, (p, s)
    assert df.filter(globs.filtered_out(F.col("s"), [], ["*"])).count() == len(cases)
    assert globs.normalize_glob(" a ") == "a" and globs.normalize_glob("a|b") is None and globs.normalize_glob(" ") is None


def test_view_codec():
    v = GraphView(hiddenEdgeTypes=frozenset({3, 1}), collapsed=("a", "b"), includeGlobs=("x*",), cyclesOnly=True, repulsion=8.5, edges=False, segments=2)
    assert GraphView.from_dict(v.to_dict()) == v
    assert GraphView().to_dict() == {}
    assert v.to_dict()["hiddenEdgeTypes"] == "1,3"
    assert v.toggled("hiddenEdgeTypes", 3).toggled("collapsed", "c").to_dict()["collapsed"] == "a,b,c"
    assert GraphView.from_dict({"repulsion": "8px", "nodeDistance": "x"}).repulsion == 8 and GraphView.from_dict({"nodeDistance": "x"}).nodeDistance == 18
    assert v.add_glob("includeGlobs", "x*") == v and v.opened(2000).collapsed == () and not v.opened(2000).edges


def test_keys(spark):
    df = spark.createDataFrame([([5, 2, 9],), ([7, 1, 2, 3, 4, 5],)], "c array<bigint>")
    rows = df.select(keys.canonical_key(F.col("c")).alias("k"), keys.visual_key(F.col("c")).alias("v"), keys.fnv1a(F.lit("a")).alias("h")).collect()
    assert [(r["k"], r["v"]) for r in rows] == [("2,9,5", "2,9,5"), ("1,2,3,4,5,7", "1|2|7|6")]
    assert rows[0]["h"] == "e40c292c"
    lists = spark.createDataFrame([(list(range(n)),) for n in (0, 5, 6, 10)], "l array<bigint>").select(keys.collapse_list(F.col("l")).alias("x")).collect()
    assert [(len(r["x"]["head"]), r["x"]["n_hidden"], len(r["x"]["tail"])) for r in lists] == [(0, 0, 0), (5, 0, 0), (2, 3, 1), (2, 7, 1)]


@pytest.mark.parametrize("strings,segments,groups", [
    (["io.disk.read", "io.disk.seek", "io.net.open", "ui.draw", "ui.dim"], None, [0, 0, 1, 2, 2]),
    (["river", "lake", "lagoon"], None, [0, 1, 1]),
    (["tie", "tie"], None, [0, 0]),
    (["alone"], None, [0]),
    (["io.disk.read", "io.disk.seek", "io.net.open", "io.net.shut", "ui.draw", "ui.dim"], 1, [0, 0, 0, 0, 1, 1]),
    (["io.disk.read", "io.disk.seek", "io.net.open", "io.net.shut", "ui.draw", "ui.dim"], 2, [0, 0, 1, 1, 2, 2]),
    (["io.disk.read", "io.disk.seek", "io.net.open", "io.net.shut", "ui.draw", "ui.dim"], 9, [0, 0, 1, 1, 2, 2]),
])
def test_prefix_clusters(spark, strings, segments, groups):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(strings)], "graph_id string, idx long, s string")
    assert [r["community"] for r in community.prefix_clusters(df, segments).orderBy("idx").collect()] == groups


def test_cluster_modes(spark):
    assert all(map(community.is_cluster_mode, ("id", "label", "type", "meta.team", "meta.a.b"))) and not any(map(community.is_cluster_mode, (None, "", "meta", "meta.", "louvain")))
    t = graph(spark, node("a", meta={"team": "infra"}), node("b"), node("c", meta={"x": 1}))
    ids = [r["community"] for r in community.communities(t, GraphView(cluster="meta.team")).orderBy("idx").collect()]
    assert ids == [0, 1, 1]


def plain_louvain(n, pairs, gamma):
    """Louvain from its definition: a node's gain is what modularity of the
    whole matrix says, up to what does not depend on the move."""
    w = np.zeros((n, n))
    for a, b in pairs:
        if a != b:
            w[a, b] += 1
            w[b, a] += 1
    label = np.arange(n)
    while True:
        k, of = w.sum(1), np.arange(len(w))
        for _ in range(50):
            moved = False
            for v in range(len(w)):
                value = lambda c: sum(w[v, u] for u in range(len(w)) if u != v and of[u] == c) - gamma * k[v] * sum(k[u] for u in range(len(w)) if u != v and of[u] == c) / k.sum()  # noqa: B023, E731
                top, best = value(of[v]), of[v]
                for c in sorted({of[u] for u in range(len(w)) if u != v and w[v, u]}):
                    if value(c) > top + 1e-12:
                        top, best = value(c), c
                moved |= bool(best != of[v])
                of[v] = best
            if not moved:
                break
        order = list(dict.fromkeys(of.tolist()))
        of = np.array([order.index(c) for c in of])
        label = of[label]
        if len(order) == len(w):
            return label.tolist()
        member = np.eye(len(order))[of]
        w = member.T @ w @ member


def test_louvain(spark):
    clique = " ".join(f"{a}>{b}" for g in ("abcd", "efgh") for a in g for b in g if a < b) + " d>e"
    t = arrows(spark, clique)
    found = community.louvain(t.nodes, t.edges)
    assert [r["community"] for r in found.orderBy("idx").collect()] == [0] * 4 + [1] * 4
    assert community.modularity(t.edges, found).first()["modularity"] == pytest.approx(12 / 13 - 0.5, abs=1e-9)
    other = community.distributed_louvain(t.nodes, t.edges)
    assert community.modularity(t.edges, other).first()["modularity"] > 0.3
    for gamma in (0.5, 1.0, 2.0):  # the labels of a small graph, by plain gains
        pairs = [(i, (i * 7 + 3) % 23) for i in range(23)] + [(i, (i + 1) % 23) for i in range(0, 23, 2)]
        assert community.louvain_labels(23, pairs, gamma) == plain_louvain(23, pairs, gamma)
    t = arrows(spark, "a b c")
    assert [r["community"] for r in community.louvain(t.nodes, t.edges).orderBy("idx").collect()] == [0, 1, 2]


def test_radii(spark):
    df = spark.createDataFrame([(0, 0), (4, 9), (100, 2), (400, 0)], "i long, o long").select(display.radius(F.col("i"), F.col("o")).alias("r"))
    assert [round(r["r"], 6) for r in df.collect()] == [5.0, 6.8, 18.0, 34.0]


def test_geometry(spark):
    points = [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 4.0), (3, 0.0, 4.0), (4, 2.0, 2.0), (5, math.nan, 1.0)]
    pos = spark.createDataFrame([("g", i, x, y) for i, x, y in points], "graph_id string, idx long, x double, y double")
    com = pos.select("graph_id", "idx", F.lit(0).alias("community"))
    hull = geometry.hulls(pos.filter("idx < 5"), com)
    row = hull.select(F.size("hull").alias("n"), F.size(geometry.fan(F.col("hull"))).alias("t"), geometry.inflate(F.col("hull"), math.sqrt(2)).alias("i")).first()
    assert (row["n"], row["t"]) == (4, 2) and sorted((round(p["x"], 6), round(p["y"], 6)) for p in row["i"]) == [(-1, -1), (-1, 5), (5, -1), (5, 5)]
    assert geometry.hulls(pos.filter("idx < 2"), com).count() == 0
    b = geometry.scene_bounds(pos)
    assert b.first()[1:] == (0.0, 0.0, 4.0, 4.0)
    fit = 100 / (4 * 1.08)
    plan = geometry.focus_plan(b, (2.0, 2.0, 1.0), (2.0, 3.0), 100, 100).first()
    assert plan["to_zoom"] == pytest.approx(4 * fit) and plan["via_zoom"] is None
    assert geometry.focus_plan(b, (2.0, 2.0, 500.0), (90.0, 3.0), 100, 100).first()["via_zoom"] is not None


def test_layout(spark):
    t = arrows(spark, " ".join(f"{a}>{b}" for g in ("abcdef", "ghijkl") for a in g for b in g if a < b) + " f>g")
    com = community.louvain(t.nodes, t.edges)
    members = com.join(lookups.radii(t), ["graph_id", "idx"])
    found = layout.layout(members, t.edges).cache()
    assert geometry.layout_is_sane(found).first()["sane"]
    assert geometry.separation(found, com).first()["separation"] > 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, layout.layout(members, t.edges).collect()))


def test_search(spark):
    t = graph(spark, node("xabc"), node("abc"), node("z", label="ABCD"), node("q"))
    assert [r["id"] for r in lookups.search(t, " abc ").orderBy("bucket", "idx").collect()] == ["abc", "z", "xabc"]
    assert lookups.search(t, "ab").count() == 0


def test_generators(spark):
    t = generators.monorepo(spark, packages=20, files=10)
    assert t.nodes.count() == 220 and t.nodes.filter("not declared").count() == 0
    assert generators.clustered(spark, 100).nodes.count() == 100
    assert generators.hub(spark, 20, 30, 5).nodes.count() == 50


def test_stream(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([("g", 1, 2, "x", 1), ("g", 1, 2, "y", 2), ("g", 3, 3, "x", 3), ("g", 2, 1, "z", 4)], "graph_id string, src long, dst long, type string, at long").write.parquet(source)
    for _ in range(2):
        links = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        ingest.edge_stream(links, out, f"file://{tmp_path}/ck").awaitTermination()
        edges = ingest.stored_edges(spark, out)
        assert sorted((r["src"], r["dst"], r["type"]) for r in edges.collect()) == [(1, 2, "x"), (2, 1, "z")]
        spark.createDataFrame([("g", 1, 2, "late", 9)], "graph_id string, src long, dst long, type string, at long").write.mode("append").parquet(source)
    assert ingest.degree_table(edges).count() == 2
