"""Small graphs for tests, always through the real reader."""

import json

from meshquill.sources.json_graph import load_graphs


def documents(spark, *docs):
    rows = [(f"g{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "graph_id string, text string")


def node(id_, edges=(), **more):
    return {"id": id_, "edges": list(edges), **more}


def graph(spark, *nodes):
    return load_graphs(documents(spark, {"nodes": list(nodes)}))


def arrows(spark, text, types=None):
    """A graph of "a>b a>c", in which single letters are nodes."""
    names, links = [], {}
    for part in text.split():
        a, *b = part.split(">")
        for x in (a, *b):
            if x not in names:
                names.append(x)
        if b:
            links.setdefault(a, []).append(b[0] if types is None else {"nodeId": b[0], "edgeType": types})
    return graph(spark, *[node(n, links.get(n, [])) for n in names])


def names(tables, df, column="idx"):
    ids = {r["idx"]: r["id"] for r in tables.nodes.collect()}
    return sorted(ids[r[column]] for r in df.collect())
