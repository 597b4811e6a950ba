import pytest

from graphs import documents, graph, node
from meshquill.model import SchemaError
from meshquill.sources import json_graph
from meshquill.sources.normalise import degrees, diagnostics

ENTRY = "entry-7"
BAD = [
    "[]", "3.5", "true", '{"graph": []}', {"nodes": {}}, {"nodes": [[]]}, {"nodes": [False]}, '{"nodes": [',
    {"nodes": [{"type": "t"}]}, {"nodes": [{"id": False}]}, {"nodes": [{"id": [ENTRY]}]}, {"nodes": [node(ENTRY, label=["l"])]}, {"nodes": [node(ENTRY, label=False)]},
    {"nodes": [node(ENTRY, type={"t": 1})]}, {"nodes": [{"id": ENTRY, "edges": {"0": "z"}}]},
    {"nodes": [node(ENTRY, [{"nodeId": "z"}])]}, {"nodes": [node(ENTRY, [{"edgeType": "t"}])]}, {"nodes": [node(ENTRY, [{"nodeId": ["z"], "edgeType": "t"}])]}, {"nodes": [node(ENTRY, [{"nodeId": "z", "edgeType": ["t"]}])]},
    {"nodes": [node(ENTRY, [["z"]])]}, {"nodes": [node(ENTRY), node("z"), node(ENTRY)]}, {"nodes": [node("12"), node(12)]},
]


def test_schema_errors(spark):
    found = {r["graph_id"] for r in json_graph.first_violations(documents(spark, *BAD)).collect()}
    assert found == {f"g{i}" for i in range(len(BAD))}
    with pytest.raises(SchemaError):
        json_graph.load_graphs(documents(spark, BAD[0]))


def test_mixed_edges_and_numeric_ids(spark):
    t = graph(spark, node(1, ["b", 7, {"nodeId": 2, "edgeType": "calls"}]), node(2), node("b"), node(7))
    assert [r["id"] for r in t.nodes.orderBy("idx").collect()] == ["1", "2", "b", "7"]
    assert [(r["src"], r["dst"], r["type"]) for r in t.edges.orderBy("eidx").collect()] == [(0, 2, ""), (0, 3, ""), (0, 1, "calls")]


def test_numbers_as_text(spark):
    t = graph(spark, node(1.0), node(1.5), node(1e21))
    assert [r["id"] for r in t.nodes.orderBy("idx").collect()] == ["1", "1.5", "1e+21"]


def test_placeholders_self_loops_and_parallel_edges(spark):
    t = graph(spark, node("a", ["a", "ghost", {"nodeId": "b", "edgeType": "calls"}, {"nodeId": "b", "edgeType": "test"}]), node("b", ["ghost", "late"]))
    assert [(r["id"], r["label"], r["type"], r["declared"]) for r in t.nodes.orderBy("idx").collect()][2:] == [("ghost", "ghost", "missing", False), ("late", "late", "missing", False)]
    assert [(r["eidx"], r["src"], r["dst"], r["type"]) for r in t.edges.orderBy("eidx").collect()] == [(0, 0, 2, ""), (1, 0, 1, "calls"), (2, 1, 2, ""), (3, 1, 3, "")]
    assert [r["name"] for r in t.edge_types.orderBy("type_id").collect()] == ["", "calls"]
    raw = json_graph.raw_tables(documents(spark, {"nodes": [node("a", ["a", "g", "g"])]}))
    assert diagnostics(*raw).first().asDict() == {"graph_id": "g0", "created_missing": 1, "edges_to_missing": 2, "dropped_self": 1}


def test_type_dictionary(spark):
    t = graph(spark, node("a", type="file"), node("b", type="package"), node("c", type="file"), node("d"))
    assert [r["name"] for r in t.node_types.orderBy("type_id").collect()] == ["", "file", "package", "missing"]
    assert [r["type_id"] for r in t.nodes.orderBy("idx").collect()] == [1, 2, 1, 0]
    t = graph(spark, node("a", ["x"], type="missing"))
    assert [r["name"] for r in t.node_types.orderBy("type_id").collect()] == ["", "missing"]


def test_degrees_labels_meta(spark):
    t = graph(spark, node("a", ["b", "c"], label="A"), node("b", ["c"], meta={"k": [1]}), node("c"))
    assert [(r["in_degree"], r["out_degree"]) for r in degrees(t).orderBy("idx").collect()] == [(0, 2), (1, 1), (2, 0)]
    assert [r["label"] for r in t.nodes.orderBy("idx").collect()] == ["A", "b", "c"]


def test_store_round_trip(spark, tmp_path):
    docs = documents(spark, {"nodes": [node("a", ["b"])]})
    path = f"file://{tmp_path}/kept"
    assert json_graph.restore(spark, path) is None
    assert json_graph.persist(docs, path)
    assert json_graph.restore(spark, path).nodes.count() == 2
    json_graph.clear(spark, path)
    assert json_graph.restore(spark, path) is None
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "edges": ["b"]}]}')
    assert json_graph.to_document(json_graph.load_graph(spark, f"file://{tmp_path}/g.json")).first()["edges_flat"] == [0, 1]


def test_empty_graph(spark):
    t = json_graph.load_graphs(documents(spark, {"nodes": []}))
    assert t.nodes.count() == t.edges.count() == 0
