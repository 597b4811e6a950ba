"""Named queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, keys
from ..functions.display import community_rgb
from ..model import GraphTables, GraphView
from ..operators import bundle, community, contract, filters, geometry, layout, lookups, traverse
from ..runtime import settle
from ..sources import generators, json_graph, normalise, tables

G = "graph_id"
STEP = tables.STEP
FOLD = GraphView(hiddenNodeTypes=frozenset({3, 6}))  # customers and orders
FOLD_CLIENTS = GraphView(hiddenNodeTypes=frozenset({2}))
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The graphs in SQL, from the same tables.
_NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT {k} * {STEP}::BIGINT + {key} AS idx, '{t}/' || {key} AS id, {label or f"'{t}/' || {key}"} AS label, {k + 1} AS type_id, '{t}' AS type FROM {t}" for k, (t, key, label) in enumerate(tables.PURCHASE)) + ")"
_P = {t: f"{k} * {STEP}::BIGINT + " for k, (t, _, _) in enumerate(tables.PURCHASE)}
_EDGES = f"""edges AS (SELECT DISTINCT * FROM (
  SELECT {_P['region']}n_regionkey AS src, {_P['nation']}n_nationkey AS dst, 1 AS type_id, 'contain' AS type FROM nation
  UNION ALL SELECT {_P['nation']}c_nationkey, {_P['customer']}c_custkey, 1, 'contain' FROM customer
  UNION ALL SELECT {_P['nation']}s_nationkey, {_P['supplier']}s_suppkey, 1, 'contain' FROM supplier
  UNION ALL SELECT {_P['customer']}o_custkey, {_P['orders']}o_orderkey, 2, 'places' FROM orders
  UNION ALL SELECT {_P['orders']}l_orderkey, {_P['part']}l_partkey, 3, 'item' FROM lineitem
  UNION ALL SELECT {_P['supplier']}l_suppkey, {_P['part']}l_partkey, 4, 'supplies' FROM lineitem))"""
_PURCHASE = f"WITH RECURSIVE {_NODES}, {_EDGES}"
_DEGREES = "deg AS (SELECT idx, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes LEFT JOIN (SELECT dst AS idx, count(*) AS i FROM edges GROUP BY 1) USING (idx) LEFT JOIN (SELECT src AS idx, count(*) AS o FROM edges GROUP BY 1) USING (idx))"


_STEPS = """WITH RECURSIVE steps AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dst, event_type, ts, event_id FROM events),
 met AS (SELECT * FROM steps WHERE dst IS NOT NULL AND src <> dst),
 nodes AS (SELECT DISTINCT user_id AS idx FROM events),
 """
_REACH = """,
 reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM reach JOIN edges ON b = src)"""
_HANDOFF = _STEPS + "edges AS (SELECT src, dst, first(event_type ORDER BY ts, event_id) AS type FROM met GROUP BY src, dst)" + _REACH
_CONTACT = _STEPS + """ends AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY src ORDER BY ts, event_id) = 1 OR row_number() OVER (PARTITION BY src ORDER BY ts DESC, event_id DESC) = 1),
 edges AS (SELECT src, dst, first(event_type ORDER BY ts, event_id) AS type FROM ends GROUP BY src, dst)""" + _REACH
# Shortest distances, and of the shortest ways back to each node the least by its nodes.
_CYCLES = """, far(a, b, d) AS (SELECT src, dst, 1 FROM edges UNION SELECT a, dst, d + 1 FROM far JOIN edges ON b = src WHERE d < 60 AND a <> b),
 dist AS (SELECT a, b, min(d) AS d FROM far GROUP BY a, b), len AS (SELECT a, d FROM dist WHERE a = b),
 way(a, tip, path) AS (SELECT a, a, [a] FROM len UNION ALL SELECT way.a, e.dst, list_append(path, e.dst) FROM way JOIN len USING (a) JOIN edges e ON e.src = way.tip JOIN dist ON dist.a = e.dst AND dist.b = way.a WHERE e.dst <> way.a AND len(path) + dist.d = len.d),
 least AS (SELECT way.a AS start, min(path) AS cycle FROM way JOIN len USING (a) WHERE len(path) = len.d GROUP BY way.a),
 turned AS (SELECT start, cycle, list_concat(cycle[list_position(cycle, list_min(cycle)):], cycle[:list_position(cycle, list_min(cycle)) - 1]) AS r FROM least),
 keyed AS (SELECT start, cycle, CASE WHEN len(r) <= 5 THEN array_to_string(r, ',') ELSE concat_ws('|', r[1], r[2], r[-1], len(r)) END AS key FROM turned),
 cycles AS (SELECT start, cycle FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY start) = 1)"""
# Owners of folded clients: the earliest arrival over (pass, edge), then owners along the edges that gave it.
_OWNERS = """, cl AS (SELECT idx, idx % 25 <> 0 AS hidden FROM nodes), ce AS (SELECT src, dst, s.hidden AS h FROM edges JOIN cl s ON s.idx = src JOIN cl d ON d.idx = dst WHERE d.hidden),
 arr(idx, r, es, ed) AS (SELECT dst, 0, min(src), dst FROM ce WHERE NOT h GROUP BY dst UNION SELECT ce.dst, CASE WHEN r > 0 AND (ce.src, ce.dst) > (es, ed) THEN r ELSE r + 1 END, ce.src, ce.dst FROM arr JOIN ce ON ce.src = arr.idx AND ce.h WHERE r < 40),
 got AS (SELECT idx, r, es FROM arr QUALIFY row_number() OVER (PARTITION BY idx ORDER BY r, es, ed) = 1),
 own(idx, rep) AS (SELECT idx, es FROM got WHERE r = 0 UNION SELECT got.idx, own.rep FROM own JOIN got ON got.es = own.idx AND got.r > 0),
 remap AS (SELECT cl.idx, cl.hidden, CASE WHEN cl.hidden THEN own.rep ELSE cl.idx END AS rep FROM cl LEFT JOIN own USING (idx)),
 cedges AS (SELECT DISTINCT a.rep AS src, b.rep AS dst FROM edges JOIN remap a ON a.idx = src JOIN remap b ON b.idx = dst WHERE a.rep <> b.rep)"""

# Cycles between owners: runs of one owner are one step, also round the end; then
# first of each key, ids by FNV-1a, and the smallest cycle of each node.
_BUNDLES = _CYCLES + _OWNERS + """, step AS (SELECT start, p.i, cycle[p.i] AS idx, rep FROM cycles, LATERAL (SELECT unnest(range(1, len(cycle) + 1)) AS i) p JOIN remap ON remap.idx = cycle[p.i]),
 part AS (SELECT *, rep IS DISTINCT FROM lag(rep) OVER (PARTITION BY start ORDER BY i) AS turn FROM step WHERE start NOT IN (SELECT start FROM step WHERE rep IS NULL)),
 runs AS (SELECT start, run, any_value(rep) AS rep, list(idx ORDER BY i) AS g FROM (SELECT *, sum(turn::INT) OVER (PARTITION BY start ORDER BY i) AS run FROM part) GROUP BY start, run),
 folded AS MATERIALIZED (SELECT start, list(rep ORDER BY run) AS reps, list(g ORDER BY run) AS gs FROM runs GROUP BY start),
 round AS (SELECT start, CASE WHEN len(reps) > 1 AND reps[1] = reps[-1] THEN reps[:-2] ELSE reps END AS cycle, CASE WHEN len(reps) > 1 AND reps[1] = reps[-1] THEN list_concat([list_concat(gs[-1], gs[1])], gs[2:-2]) ELSE gs END AS groups FROM folded),
 spun AS (SELECT *, list_concat(cycle[list_position(cycle, list_min(cycle)):], cycle[:list_position(cycle, list_min(cycle)) - 1]) AS r FROM round WHERE len(cycle) >= 2),
 unlike AS (SELECT *, array_to_string(r, ',') AS key FROM spun QUALIFY row_number() OVER (PARTITION BY CASE WHEN len(r) <= 5 THEN array_to_string(r, ',') ELSE concat_ws('|', r[1], r[2], r[-1], len(r)) END ORDER BY start) = 1),
 firsts AS (SELECT * FROM unlike QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(cycle), start) = 1),
 named AS (SELECT row_number() OVER (ORDER BY len(cycle), start) AS seq, start, cycle, groups, key, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS cycle_id FROM firsts),
 mem AS (SELECT cycle_id, seq, p.i AS pos, cycle[p.i] AS idx FROM named, LATERAL (SELECT unnest(range(1, len(cycle) + 1)) AS i) p),
 tiny AS (SELECT idx, arg_min(cycle_id, seq) AS other FROM mem GROUP BY idx),
 refs AS (SELECT cycle_id, count(DISTINCT other) FILTER (other <> cycle_id) AS n FROM mem JOIN tiny USING (idx) GROUP BY cycle_id)"""


_LINKS = """WITH raw AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS epos FROM pages),
 unknown AS (SELECT target, min(page_id * 1000000 + epos) AS seen FROM raw WHERE target NOT IN (SELECT url FROM pages) GROUP BY target),
 nodes AS (SELECT page_id AS idx, url AS id, url AS label, 'page' AS type FROM pages
   UNION ALL SELECT (SELECT max(page_id) + 1 FROM pages) + row_number() OVER (ORDER BY seen) - 1, target, target, 'missing' FROM unknown)"""


def purchase(spark: SparkSession, sf_dir: str) -> GraphTables:
    return tables.purchase_graph(spark, sf_dir)


def handoff(spark: SparkSession, sf_dir: str) -> GraphTables:
    return tables.handoff_graph(spark, sf_dir)


def contact(spark: SparkSession, sf_dir: str) -> GraphTables:
    return tables.contact_graph(spark, sf_dir)


def _radii(t: GraphTables) -> DataFrame:
    return lookups.radii(t)


# -- tables of the graphs

@query(_PURCHASE + " SELECT idx, id, label, type_id::INT AS type_id, type FROM nodes")
def graph_nodes(spark, sf_dir):
    return purchase(spark, sf_dir).nodes.select("idx", "id", "label", "type_id", "type")


@query(_PURCHASE + " SELECT src, dst, type_id::INT AS type_id, type FROM edges")
def graph_edges(spark, sf_dir):
    return purchase(spark, sf_dir).edges.select("src", "dst", "type_id", "type")


@query("SELECT * FROM (VALUES (0, ''), (1, 'page'), (2, 'missing')) v(type_id, name)")
def node_types(spark, sf_dir):
    return tables.link_graph(spark, sf_dir).node_types.select("type_id", "name")


@query("SELECT * FROM (VALUES (0, ''), (1, 'href')) v(type_id, name)")
def edge_types(spark, sf_dir):
    return tables.link_graph(spark, sf_dir).edge_types.select("type_id", "name")


@query(_LINKS + " SELECT idx, id, label, type FROM nodes")
def link_nodes(spark, sf_dir):
    return tables.link_graph(spark, sf_dir).nodes.select("idx", "id", "label", "type")


@query(_LINKS + """, first AS (SELECT page_id AS src, n.idx AS dst, min(epos) AS epos FROM raw JOIN nodes n ON n.id = target WHERE n.idx <> page_id GROUP BY 1, 2)
 SELECT row_number() OVER (ORDER BY src, epos) - 1 AS eidx, src, dst FROM first""")
def link_edges(spark, sf_dir):
    return tables.link_graph(spark, sf_dir).edges.select("eidx", "src", "dst")


@query(_LINKS + " SELECT idx, id FROM nodes WHERE type = 'missing'")
def missing_nodes(spark, sf_dir):
    return normalise.placeholders(*tables.link_tables(spark, sf_dir)).select("idx", "id")


@query(_LINKS + " SELECT (SELECT count(*) FROM unknown) AS created_missing, count(*) FILTER (p.url IS NULL) AS edges_to_missing, count(*) FILTER (p.page_id = raw.page_id) AS dropped_self FROM raw LEFT JOIN pages p ON p.url = target")
def load_diagnostics(spark, sf_dir):
    return normalise.diagnostics(*tables.link_tables(spark, sf_dir)).drop(G)


# -- adjacency-list documents, one a nation

def documents(spark, sf_dir, spoilt: bool = False) -> DataFrame:
    """(graph_id, text): a nation's customers, by key, point to themselves, to
    their orders, and to the first one again. Spoilt ones break a rule each."""
    t = lambda n: tables.read(spark, sf_dir, n)
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.struct(name.alias("nodeId"), F.lit("places").alias("edgeType")).alias("e")))).alias("o"))
    some = F.transform("o", lambda x: F.to_json(x["e"]))
    again = F.transform(F.slice("o", F.lit(1), F.lit(1)), lambda x: F.concat(F.lit('"'), x["e"]["nodeId"], F.lit('"')))
    own = F.array(F.col("c_custkey").cast("string"))
    edges = F.concat(F.lit("["), F.array_join(F.when(F.col("o").isNull(), own).otherwise(F.concat(own, some, again)), ","), F.lit("]"))
    label = F.when((F.col("c_nationkey") % 5 == 2) & F.lit(spoilt), "7").otherwise(F.concat(F.lit('"'), F.col("c_name"), F.lit('"')))
    key = F.when((F.col("c_nationkey") % 5 == 3) & F.lit(spoilt), F.lit(1)).otherwise(F.col("c_custkey"))
    node = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"label":'), label, F.lit(',"type":"customer","edges":'), F.when((F.col("c_nationkey") % 5 == 4) & F.lit(spoilt), F.lit('"none"')).otherwise(edges), F.lit("}"))
    listed = t("customer").join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", node.alias("n")))), lambda x: x["n"]), ",").alias("n"))
    end = F.when((F.col("c_nationkey") % 5 == 1) & F.lit(spoilt), F.lit("]")).otherwise(F.lit("]}"))
    return listed.select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("graph_id"), F.concat(F.lit('{"nodes":['), "n", end).alias("text"))


_JSON = """WITH cust AS (SELECT 'nation/' || c_nationkey AS graph_id, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, count(*) OVER (PARTITION BY c_nationkey) AS n0 FROM customer),
 made AS (SELECT graph_id, idx AS src, n0 + row_number() OVER (PARTITION BY graph_id ORDER BY idx, o_orderkey) - 1 AS dst, 'o' || o_orderkey AS id FROM cust JOIN orders ON o_custkey = c_custkey)"""


@query(_JSON + " SELECT graph_id, idx, c_custkey::VARCHAR AS id, c_name AS label, 'customer' AS type, true AS declared FROM cust UNION ALL SELECT graph_id, dst, id, id, 'missing', false FROM made")
def json_nodes(spark, sf_dir):
    return json_graph.load_graphs(documents(spark, sf_dir)).nodes.select(G, "idx", "id", "label", "type", "declared")


@query(_JSON + " SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS eidx, src, dst, 'places' AS type FROM made")
def json_edges(spark, sf_dir):
    return json_graph.load_graphs(documents(spark, sf_dir)).edges.select(G, "eidx", "src", "dst", "type")


@query("SELECT 'nation/' || c_nationkey AS graph_id, CASE c_nationkey % 5 WHEN 1 THEN 'Invalid JSON' WHEN 2 THEN 'nodes[0].label must be a string' WHEN 3 THEN 'duplicate node id 1' ELSE 'nodes[0].edges must be an array' END AS message FROM customer GROUP BY c_nationkey HAVING c_nationkey % 5 IN (1, 2, 4) OR (c_nationkey % 5 = 3 AND count(*) > 1)")
def json_errors(spark, sf_dir):
    return json_graph.first_violations(documents(spark, sf_dir, spoilt=True))


@query(_JSON + ", n AS (SELECT graph_id, count(*) AS customers FROM cust GROUP BY 1), m AS (SELECT graph_id, count(*) AS orders, list(src ORDER BY src, dst) AS s, list(dst ORDER BY src, dst) AS d FROM made GROUP BY 1) SELECT graph_id, customers + coalesce(orders, 0) AS node_count, coalesce(flatten(list_transform(range(1, orders + 1), lambda i: [s[i], d[i]])), []) AS edges_flat FROM n LEFT JOIN m USING (graph_id)")
def json_export(spark, sf_dir):
    return json_graph.to_document(json_graph.load_graphs(documents(spark, sf_dir))).select(G, "node_count", "edges_flat")


@query(_JSON + " SELECT graph_id, count(*) AS created_missing, count(*) + count(DISTINCT src) AS edges_to_missing FROM made GROUP BY 1")
def json_diagnostics(spark, sf_dir):
    return normalise.diagnostics(*json_graph.raw_tables(documents(spark, sf_dir))).filter("created_missing > 0").drop("dropped_self")


# -- degrees, counts, histograms

@query(_PURCHASE + f", {_DEGREES} SELECT idx, in_degree, out_degree FROM deg")
def degrees(spark, sf_dir):
    return normalise.degrees(purchase(spark, sf_dir)).drop(G)


@query(_PURCHASE + f", {_DEGREES} SELECT idx, round(greatest(5.0, 2 + 1.6 * sqrt(greatest(in_degree, out_degree))), 6)::DOUBLE AS radius FROM deg")
def radii(spark, sf_dir):
    return _radii(purchase(spark, sf_dir)).select("idx", F.round("radius", 6).alias("radius"))


@query(_PURCHASE + " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark, sf_dir):
    return lookups.graph_counts(purchase(spark, sf_dir)).drop(G)


@query(_PURCHASE + " SELECT type_id::INT AS type_id, type AS name, count(*) AS n, type_id IN (3, 6) AS hidden FROM nodes GROUP BY ALL")
def node_type_histogram(spark, sf_dir):
    t = purchase(spark, sf_dir)
    return lookups.type_histogram(t.nodes, t.node_types, FOLD.hiddenNodeTypes).drop(G)


@query(_PURCHASE + " SELECT type_id::INT AS type_id, type AS name, count(*) AS n, type_id = 2 AS hidden FROM edges GROUP BY ALL")
def edge_type_histogram(spark, sf_dir):
    t = purchase(spark, sf_dir)
    return lookups.type_histogram(t.edges, t.edge_types, frozenset({2})).drop(G)


# -- lookups

_PART1 = 4 * STEP + 1


@query(_PURCHASE + f" SELECT DISTINCT n.idx, id, label FROM edges e JOIN nodes n ON n.idx = e.src WHERE e.dst = {_PART1}")
def in_neighbors(spark, sf_dir):
    return lookups.in_neighbours(purchase(spark, sf_dir), _PART1).drop(G)


@query(_PURCHASE + f" SELECT DISTINCT n.idx, id, label FROM edges e JOIN nodes n ON n.idx = e.dst WHERE e.src = {STEP + 3}")
def out_neighbors(spark, sf_dir):
    return lookups.out_neighbours(purchase(spark, sf_dir), STEP + 3).drop(G)


@query(_HANDOFF + ", x AS (SELECT 1) SELECT n.idx, (SELECT count(*) FROM edges e WHERE e.dst = n.idx) AS n_in, (SELECT count(*) FROM edges e WHERE e.src = n.idx) AS n_out FROM nodes n")
def neighbor_counts(spark, sf_dir):
    return lookups.neighbour_counts(handoff(spark, sf_dir)).drop(G)


@query(_PURCHASE + " SELECT idx, id, label, type FROM nodes WHERE id = 'customer/7'")
def node_detail(spark, sf_dir):
    return lookups.node_detail(purchase(spark, sf_dir), "customer/7").select("idx", "id", "label", "type")


@query("SELECT event_id AS idx, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def meta_entries(spark, sf_dir):
    nodes = tables.read(spark, sf_dir, "events").select(F.lit("events").alias(G), F.col("event_id").alias("idx"), F.try_parse_json("props").alias("meta"))
    return lookups.meta_entries(nodes).drop(G)


@query(_PURCHASE + """, hits AS (SELECT idx, id, label, CASE WHEN starts_with(lower(id), 'supp') OR starts_with(lower(label), 'supp') THEN 0 WHEN contains(lower(id), 'supp') OR contains(lower(label), 'supp') THEN 1 END AS bucket FROM nodes)
 SELECT idx, id, label, bucket::INT AS bucket FROM hits WHERE bucket IS NOT NULL ORDER BY bucket, idx LIMIT 20""")
def search(spark, sf_dir):
    return lookups.search(purchase(spark, sf_dir), " Supp ").drop(G)


# -- filters

_GLOBS = GraphView(includeGlobs=("http*/en/*", "*page=?*"), excludeGlobs=("*#top",))


@query(_LINKS + r" SELECT idx, id FROM nodes WHERE (regexp_full_match(label, 'http[\s\S]*/en/[\s\S]*') OR regexp_full_match(label, '[\s\S]*page=[\s\S][\s\S]*')) AND NOT regexp_full_match(label, '[\s\S]*#top')")
def glob_filter(spark, sf_dir):
    return filters.glob_filter(tables.link_graph(spark, sf_dir).nodes, _GLOBS).select("idx", "id")


@query(_PURCHASE + " SELECT idx, id FROM nodes WHERE id IN ('nation/3', 'nope') OR label LIKE 'A%'")
def effective_hidden(spark, sf_dir):
    return filters.effective_hidden(purchase(spark, sf_dir), GraphView(hiddenNodes=("nation/3", "nope"), excludeGlobs=("A*",))).drop(G)


@query(_PURCHASE + " SELECT src, dst, type FROM edges WHERE type_id NOT IN (3, 4)")
def edge_type_filter(spark, sf_dir):
    return filters.edge_type_filter(purchase(spark, sf_dir).edges, frozenset({3, 4})).select("src", "dst", "type")


@query(_PURCHASE + f" SELECT src, dst, type FROM edges WHERE src = {STEP + 3} OR dst = {STEP + 3}")
def incident_edges(spark, sf_dir):
    return filters.incident_edges(purchase(spark, sf_dir).edges, STEP + 3).select("src", "dst", "type")


@query(_HANDOFF + " SELECT src, dst, src % 7 <> dst % 7 AS cross FROM edges")
def cross_community_edges(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return lookups.cross_community(t.edges, _by_remainder(t)).select("src", "dst", "cross")


def _by_remainder(t: GraphTables, n: int = 7) -> DataFrame:
    """A fixed partition of the hand-off graph's users."""
    return t.nodes.select(G, "idx", (F.col("idx") % n).cast("int").alias("community"))


# -- orphans and cycles

@query(_PURCHASE + " SELECT EXISTS (SELECT 1 FROM nodes WHERE idx NOT IN (SELECT dst FROM edges)) AS has_orphan")
def has_any_orphan(spark, sf_dir):
    t = purchase(spark, sf_dir)
    return traverse.has_any_orphan(t.nodes, t.edges).drop(G)


_ORPHANS = ", ok AS (SELECT a AS idx FROM reach WHERE a = b UNION SELECT r.b FROM reach r JOIN reach c ON c.a = c.b AND c.a = r.a)"


@query(_CONTACT + _ORPHANS + " SELECT idx FROM nodes WHERE idx NOT IN (SELECT idx FROM ok)")
def orphans(spark, sf_dir):
    t = contact(spark, sf_dir)
    return traverse.orphans(t.nodes, t.edges).select("idx")


@query(_CONTACT + _ORPHANS + ", roots AS (SELECT idx FROM nodes WHERE idx IN (3, 5, 8) UNION SELECT b FROM reach WHERE a IN (3, 5, 8)) SELECT idx FROM nodes WHERE idx NOT IN (SELECT idx FROM ok) AND idx NOT IN (SELECT idx FROM roots)")
def orphans_with_roots(spark, sf_dir):
    t = contact(spark, sf_dir)
    return traverse.orphans(t.nodes, t.edges, filters.roots(t, GraphView(rootNodes=("user/3", "user/5", "user/8", "user/x")))).select("idx")


@query(_CONTACT.replace("FROM ends GROUP BY src, dst)", "FROM ends GROUP BY src, dst HAVING first(event_type ORDER BY ts, event_id) <> 'error')") + _ORPHANS + " SELECT idx FROM nodes WHERE idx NOT IN (SELECT idx FROM ok)")
def orphans_edge_filtered(spark, sf_dir):
    t = contact(spark, sf_dir)
    hidden = frozenset(r["type_id"] for r in t.edge_types.filter("name = 'error'").collect())  # a dictionary: a few rows
    return traverse.orphans(t.nodes, filters.edge_type_filter(t.edges, hidden)).select("idx")


@query(_CONTACT + _ORPHANS + " SELECT idx, 'User ' || idx AS label FROM nodes WHERE idx NOT IN (SELECT idx FROM ok) AND 'User ' || idx NOT LIKE 'User 1%'")
def orphans_minus_hidden(spark, sf_dir):
    t = contact(spark, sf_dir)
    hidden = filters.effective_hidden(t, GraphView(excludeGlobs=("User 1*",)))
    found = traverse.orphans(t.nodes, t.edges).join(hidden, [G, "idx"], "left_anti")
    return found.join(t.nodes, [G, "idx"]).select("idx", "label").orderBy(*lookups.by_label())


@query(_HANDOFF + " SELECT EXISTS (SELECT 1 FROM reach WHERE a = b) AS has_cycle")
def has_any_cycle(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return traverse.has_any_cycle(t.nodes, t.edges).drop(G)


@query(_CONTACT + ", mutual AS (SELECT x.a, max(x.b) AS scc FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT a AS idx, scc FROM mutual")
def scc(spark, sf_dir):
    return traverse.components(contact(spark, sf_dir).edges).drop(G)


@query(_CONTACT + _OWNERS + ", again(a, b) AS (SELECT src, dst FROM cedges UNION SELECT a, dst FROM again JOIN cedges ON b = src) SELECT a AS idx FROM again WHERE a = b")
def cycles_only_nodes(spark, sf_dir):
    t = contact(spark, sf_dir)
    view = replace(FOLD_CLIENTS, cyclesOnly=True)
    con = settle(contract.contraction(t, view, _radii(t)))
    return filters.cycles_only(t, view, con).select("idx")


@query(_CONTACT + _OWNERS + " SELECT idx, hidden, rep FROM remap")
def client_owners(spark, sf_dir):
    t = contact(spark, sf_dir)
    return contract.contraction(t, FOLD_CLIENTS, _radii(t)).select("idx", "hidden", "rep")


@query(_CONTACT + _CYCLES + " SELECT a AS idx, d::INT AS length FROM len")
def shortest_cycle_length(spark, sf_dir):
    return traverse.shortest_cycle_lengths(contact(spark, sf_dir).edges).drop(G)


def _cycles(spark, sf_dir) -> tuple[GraphTables, DataFrame]:
    t = contact(spark, sf_dir)
    return t, settle(traverse.shortest_cycles(t.edges))


@query(_CONTACT + _CYCLES + " SELECT start, cycle FROM cycles")
def shortest_cycles(spark, sf_dir):
    return _cycles(spark, sf_dir)[1].select("start", "cycle")


@query(_CONTACT + """, any_cycle AS (SELECT EXISTS (SELECT 1 FROM reach WHERE a = b) AS yes) SELECT view, CASE WHEN NOT yes OR view = 'no edges' THEN 'graph' WHEN view = 'plain' THEN 'none' ELSE 'scoped' END AS reason FROM any_cycle, (VALUES ('plain'), ('no users'), ('no edges')) v(view)""")
def empty_reason(spark, sf_dir):
    """Why the list of cycles of three views is (not) empty."""
    t, cycles = _cycles(spark, sf_dir)
    out = None
    every = frozenset(r["type_id"] for r in t.edge_types.collect())  # a dictionary: a few rows
    for name, view in (("plain", GraphView()), ("no users", GraphView(excludeGlobs=("User *",))), ("no edges", GraphView(hiddenEdgeTypes=every))):
        edges = filters.edge_type_filter(t.edges, view.hiddenEdgeTypes)
        listed = bundle.bundle_raw(cycles if not view.hiddenEdgeTypes else settle(traverse.shortest_cycles(edges)), contract.contraction(t, view, _radii(t)))
        one = traverse.empty_reason(t.nodes, edges, listed).select(F.lit(name).alias("view"), "reason")
        out = one if out is None else out.unionByName(one)
    return out


# -- contraction

_MASK = ", mask AS (SELECT idx, type_id IN (3, 6) AS hidden FROM nodes)"
_OWN = """, own1 AS (SELECT dst AS idx, first(src ORDER BY src) AS rep FROM edges JOIN mask s ON s.idx = src AND NOT s.hidden JOIN mask d ON d.idx = dst AND d.hidden GROUP BY 1),
 own2 AS (SELECT dst AS idx, first(rep ORDER BY src) AS rep FROM edges JOIN own1 ON own1.idx = src JOIN mask d ON d.idx = dst AND d.hidden WHERE dst NOT IN (SELECT idx FROM own1) GROUP BY 1),
 remap AS (SELECT m.idx, m.hidden, CASE WHEN NOT m.hidden THEN m.idx ELSE coalesce(own1.rep, own2.rep) END AS rep FROM mask m LEFT JOIN own1 USING (idx) LEFT JOIN own2 USING (idx))"""


@query(_PURCHASE + _MASK + " SELECT idx, hidden FROM mask")
def contraction_mask(spark, sf_dir):
    return contract.visibility(purchase(spark, sf_dir), FOLD).select("idx", "hidden")


@query(_PURCHASE + _MASK + _OWN + " SELECT idx, coalesce(rep, -1) AS rep FROM remap")
def contraction_remap(spark, sf_dir):
    t = purchase(spark, sf_dir)
    return contract.contraction(t, FOLD, _radii(t)).select("idx", F.coalesce("rep", F.lit(-1)).alias("rep"))


@query(_PURCHASE + f", {_DEGREES}" + _MASK + _OWN + """, r AS (SELECT idx, greatest(5.0, 2 + 1.6 * sqrt(greatest(in_degree, out_degree)))::DOUBLE AS radius FROM deg),
 area AS (SELECT rep AS idx, sum(radius * radius) AS area FROM remap JOIN r USING (idx) WHERE hidden AND rep IS NOT NULL GROUP BY 1)
 SELECT m.idx, round(CASE WHEN hidden THEN 0 ELSE sqrt(radius * radius + coalesce(area, 0)) END, 4)::DOUBLE AS eff_radius FROM remap m JOIN r USING (idx) LEFT JOIN area USING (idx)""")
def effective_radii(spark, sf_dir):
    t = purchase(spark, sf_dir)
    return contract.contraction(t, FOLD, _radii(t)).select("idx", F.round("eff_radius", 4).alias("eff_radius"))


@query(_PURCHASE + _MASK + _OWN + " SELECT DISTINCT a.rep AS src, b.rep AS dst FROM edges JOIN remap a ON a.idx = src JOIN remap b ON b.idx = dst WHERE a.rep <> b.rep")
def contracted_edges(spark, sf_dir):
    t = purchase(spark, sf_dir)
    return contract.contracted_edges(t.edges, contract.contraction(t, FOLD, _radii(t))).select("src", "dst")


@query(_PURCHASE + f" SELECT idx, (type_id IN (3, 6)) <> (idx IN (SELECT dst FROM edges WHERE src = {STEP + 3})) AS hidden FROM nodes")
def collapse_toggle(spark, sf_dir):
    return contract.visibility(purchase(spark, sf_dir), GraphView(hiddenNodeTypes=FOLD.hiddenNodeTypes, collapsed=("nation/3",))).select("idx", "hidden")


# -- bundles of cycles, on the contact graph with clients folded into agents

_HIDE = GraphView(hiddenNodes=tuple(f"user/{i}" for i in range(0, 40, 5)))


def _bundles(spark, sf_dir):
    t, cycles = _cycles(spark, sf_dir)
    con = settle(contract.contraction(t, FOLD_CLIENTS, _radii(t)))
    return t, cycles, con, settle(bundle.named(bundle.bundle_raw(cycles, con)))


@query(_CONTACT + _BUNDLES + " SELECT cycle_id, cycle, groups FROM named")
def bundled_cycles(spark, sf_dir):
    return _bundles(spark, sf_dir)[3].select("cycle_id", "cycle", "groups")


@query()
def contracted_bundles(spark, sf_dir):
    t, _, con, _ = _bundles(spark, sf_dir)
    inner = settle(contract.contracted_edges(t.edges, con))
    return bundle.named(bundle.bundle_contracted(traverse.shortest_cycles(inner), t.edges, con)).select("cycle_id", "cycle", "groups")


@query(_CONTACT + _BUNDLES + " SELECT cycle_id, key FROM named")
def cycle_ids(spark, sf_dir):
    return _bundles(spark, sf_dir)[3].select("cycle_id", "key")


@query(_CONTACT + _BUNDLES + " SELECT cycle_id, cycle FROM named WHERE list_contains(cycle, 25)")
def cycles_through_node(spark, sf_dir):
    return bundle.through_node(_bundles(spark, sf_dir)[3], 25).select("cycle_id", "cycle")


@query(_CONTACT + _CYCLES + _OWNERS + ", inside AS (SELECT start FROM (SELECT start, unnest(cycle) AS idx FROM cycles) JOIN remap USING (idx) GROUP BY start HAVING bool_and(coalesce(rep = 0, false))) SELECT start, cycle FROM cycles SEMI JOIN inside USING (start)")
def internal_cycles(spark, sf_dir):
    t, cycles = _cycles(spark, sf_dir)
    return bundle.internal_cycles(cycles, settle(contract.contraction(t, FOLD_CLIENTS, _radii(t))), 0).select("start", "cycle")


@query(_CONTACT + _BUNDLES + """, cut AS (SELECT *, CASE WHEN lag(other) OVER (PARTITION BY cycle_id ORDER BY pos) = other THEN 0 ELSE 1 END AS turn FROM mem JOIN tiny USING (idx)), seg AS (SELECT *, sum(turn) OVER (PARTITION BY cycle_id ORDER BY pos) AS segment FROM cut)
 SELECT cycle_id, segment::BIGINT AS segment, other, other || '-' || (segment - 1)::BIGINT AS key, min(pos)::INT AS first, max(pos)::INT AS last FROM seg GROUP BY cycle_id, segment, other""")
def cycle_segments(spark, sf_dir):
    return bundle.segments(_bundles(spark, sf_dir)[3]).drop(G)


@query(_CONTACT + _BUNDLES + ", votes AS (SELECT other AS cycle_id, count(DISTINCT cycle_id) AS votes FROM mem JOIN tiny USING (idx) WHERE other <> cycle_id GROUP BY other) SELECT cycle_id, votes FROM votes JOIN named USING (cycle_id) ORDER BY votes DESC, seq LIMIT 3")
def top_referenced_cycles(spark, sf_dir):
    return bundle.top_referenced(_bundles(spark, sf_dir)[3]).drop(G)


@query(_CONTACT + _BUNDLES + " SELECT cycle_id, list_transform(cycle, lambda i: 'user/' || i) AS ids, list_transform(range(1, len(cycle) + 1), lambda k: list_transform(list_filter(groups[k], lambda g: g <> cycle[k]), lambda g: 'user/' || g)) AS files, CASE n WHEN 0 THEN '' WHEN 1 THEN '1 cycle' ELSE n || ' cycles' END AS label FROM named JOIN refs USING (cycle_id)")
def cycle_entries(spark, sf_dir):
    t, _, _, named = _bundles(spark, sf_dir)
    return bundle.entries(named, t.nodes).select("cycle_id", "ids", "files", "label")


# -- clusters and communities

_STRINGS = "s AS (SELECT page_id AS idx, url AS s FROM pages), n AS (SELECT s, count(*) AS n FROM s GROUP BY s), cut AS (SELECT s, n, unnest(range(1, length(s) + 1)) AS k FROM n), pre AS (SELECT s, n, k, s[1:k] AS p, s[k + 1:k + 1] AS nx FROM cut), br AS (SELECT p FROM pre GROUP BY p HAVING count(DISTINCT nx) > 1 OR max(CASE WHEN nx = '' THEN n END) > 1), d AS (SELECT s, list_sort(list(DISTINCT k)) AS d FROM pre SEMI JOIN br USING (p) GROUP BY s)"
_DENSE = ", first AS (SELECT key, row_number() OVER (ORDER BY min(idx)) - 1 AS community FROM keyed GROUP BY key) SELECT idx, community::INT AS community FROM keyed JOIN first USING (key)"


def _pages(spark, sf_dir) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").select(F.lit("pages").alias(G), F.col("page_id").alias("idx"), F.col("url").alias("id"))


@query(f"WITH {_STRINGS}, keyed AS (SELECT idx, CASE WHEN d IS NULL THEN s.s ELSE s.s[1:d[-1]] END AS key FROM s LEFT JOIN d USING (s))" + _DENSE)
def lcp_clusters_natural(spark, sf_dir):
    return community.prefix_clusters(community.cluster_strings(_pages(spark, sf_dir), "id")).drop(G)


@query(f"WITH {_STRINGS}, keyed AS (SELECT idx, CASE WHEN d IS NULL THEN s.s ELSE s.s[1:d[least(2, len(d))]] END AS key FROM s LEFT JOIN d USING (s))" + _DENSE)
def lcp_clusters_segments(spark, sf_dir):
    return community.prefix_clusters(community.cluster_strings(_pages(spark, sf_dir), "id"), 2).drop(G)


@query("WITH s AS (SELECT event_id AS idx, json_extract_string(props, '$.k') AS s FROM events), n AS (SELECT s, count(*) AS n FROM s GROUP BY s), cut AS (SELECT s, n, unnest(range(1, length(s) + 1)) AS k FROM n), pre AS (SELECT s, n, k, s[1:k] AS p, s[k + 1:k + 1] AS nx FROM cut), br AS (SELECT p FROM pre GROUP BY p HAVING count(DISTINCT nx) > 1 OR max(CASE WHEN nx = '' THEN n END) > 1), d AS (SELECT s, max(k) AS d FROM pre SEMI JOIN br USING (p) GROUP BY s), keyed AS (SELECT idx, CASE WHEN d IS NULL THEN s.s ELSE s.s[1:d] END AS key FROM s LEFT JOIN d USING (s))" + _DENSE)
def cluster_by_meta(spark, sf_dir):
    nodes = tables.read(spark, sf_dir, "events").select(F.lit("events").alias(G), F.col("event_id").alias("idx"), F.try_parse_json("props").alias("meta"))
    return community.prefix_clusters(community.cluster_strings(nodes, "meta.k")).drop(G)


@query()
def louvain(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return community.louvain(t.nodes, t.edges).drop(G)


@query()
def distributed_louvain(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return community.distributed_louvain(t.nodes, t.edges, max_rounds=4, levels=1).drop(G)


@query(_HANDOFF + """, simple AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), m AS (SELECT count(*) AS m FROM simple),
 l AS (SELECT a % 7 AS c, count(*) AS l FROM simple WHERE a % 7 = b % 7 GROUP BY 1), d AS (SELECT c, count(*) AS d FROM (SELECT a % 7 AS c FROM simple UNION ALL SELECT b % 7 FROM simple) GROUP BY 1)
 SELECT round(sum(coalesce(l, 0) / m - (d / (2.0 * m)) ** 2), 8)::DOUBLE AS modularity FROM d LEFT JOIN l USING (c), m""")
def modularity(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return community.modularity(t.edges, _by_remainder(t)).select(F.round("modularity", 8).alias("modularity"))


@query("SELECT count(DISTINCT user_id % 7) AS n_communities FROM events")
def community_counts(spark, sf_dir):
    return community.community_counts(_by_remainder(handoff(spark, sf_dir))).drop(G)


@query("SELECT DISTINCT user_id AS idx, (CASE WHEN user_id % 2 = 0 THEN user_id % 7 ELSE 0 END)::INT AS community FROM events")
def custom_communities(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return community.custom(t.nodes, _by_remainder(t).filter("idx % 2 = 0")).drop(G)


# -- layout and geometry

def _members(t: GraphTables) -> DataFrame:
    return _by_remainder(t).join(_radii(t), [G, "idx"])


_SEED = f""", deg AS (SELECT idx, (SELECT count(*) FROM edges WHERE dst = idx) AS i, (SELECT count(*) FROM edges WHERE src = idx) AS o FROM nodes),
 mem AS (SELECT idx, idx % 7 AS c, greatest(5.0, 2 + 1.6 * sqrt(greatest(i, o)))::DOUBLE AS radius FROM deg),
 com AS (SELECT c, count(*) AS n, sqrt(count(*)) * (avg(radius) * 1.5 + 2) AS r FROM mem GROUP BY c),
 cen AS (SELECT c, n, r, (row_number() OVER (ORDER BY n DESC, c) - 1) * {layout.GOLDEN} AS ang, coalesce(sum(n) OVER (ORDER BY n DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc, sum(n) OVER () AS tot, sum(r) OVER () AS reach FROM com),
 pos AS (SELECT idx, c, cos(ang) * far + cos(k * {layout.GOLDEN}) * r * sqrt((k + 0.5) / n) AS x, sin(ang) * far + sin(k * {layout.GOLDEN}) * r * sqrt((k + 0.5) / n) AS y
   FROM (SELECT m.idx, m.c, n, r, ang, greatest(sqrt(tot) * 18, reach * 0.8) * sqrt(acc / tot + 0.02) AS far, row_number() OVER (PARTITION BY m.c ORDER BY m.idx) - 1 AS k FROM mem m JOIN cen USING (c)))"""


@query(_HANDOFF + _SEED + " SELECT idx, round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y FROM pos")
def layout_seed(spark, sf_dir):
    return layout.seed(_members(handoff(spark, sf_dir))).select("idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_HANDOFF + _SEED + " SELECT idx, round(x + 0.5 * (avg(x) OVER (PARTITION BY c) - avg(x) OVER ()), 4)::DOUBLE AS x, round(y + 0.5 * (avg(y) OVER (PARTITION BY c) - avg(y) OVER ()), 4)::DOUBLE AS y FROM pos")
def cluster_spread(spark, sf_dir):
    t = handoff(spark, sf_dir)
    moved = layout.spread(layout.seed(_members(t)), _by_remainder(t), 1.5)
    return moved.select("idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_HANDOFF + _SEED + " SELECT round(min(x), 4)::DOUBLE AS min_x, round(min(y), 4)::DOUBLE AS min_y, round(max(x), 4)::DOUBLE AS max_x, round(max(y), 4)::DOUBLE AS max_y FROM pos")
def scene_bounds(spark, sf_dir):
    b = geometry.scene_bounds(layout.seed(_members(handoff(spark, sf_dir))))
    return b.select(*[F.round(c, 4).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(_HANDOFF + _SEED + """, cen2 AS (SELECT c, avg(x) AS cx, avg(y) AS cy FROM pos GROUP BY c), sp AS (SELECT c, greatest(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)), 1) AS s FROM pos JOIN cen2 USING (c) GROUP BY c),
 near AS (SELECT a.c, min(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS d FROM cen2 a JOIN cen2 b ON a.c <> b.c GROUP BY a.c) SELECT round(avg(d / s), 5)::DOUBLE AS separation FROM near JOIN sp USING (c)""")
def cluster_separation(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return geometry.separation(layout.seed(_members(t)), _by_remainder(t)).select(F.round("separation", 5).alias("separation"))


@query(_HANDOFF + _SEED + " SELECT round(median(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)), 4)::DOUBLE AS length FROM edges JOIN pos a ON a.idx = src JOIN pos b ON b.idx = dst")
def median_edge_length(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return geometry.median_edge_length(t.edges, layout.seed(_members(t))).select(F.round("length", 4).alias("length"))


@query(_HANDOFF + _SEED + """, z AS (SELECT min(800 / (greatest(1e-6, x) * 1.08), 600 / (greatest(1e-6, y) * 1.08)) AS fit FROM (SELECT max(x) - min(x) AS x, max(y) - min(y) AS y FROM pos))
 SELECT round(greatest(0.5, 4 * fit), 6)::DOUBLE AS to_zoom FROM (SELECT least(800 / (greatest(1e-6, x) * 1.08), 600 / (greatest(1e-6, y) * 1.08)) AS fit FROM (SELECT max(x) - min(x) AS x, max(y) - min(y) AS y FROM pos))""".replace(""", z AS (SELECT min(800 / (greatest(1e-6, x) * 1.08), 600 / (greatest(1e-6, y) * 1.08)) AS fit FROM (SELECT max(x) - min(x) AS x, max(y) - min(y) AS y FROM pos))""", ""))
def focus_plan(spark, sf_dir):
    b = geometry.scene_bounds(layout.seed(_members(handoff(spark, sf_dir))))
    return geometry.focus_plan(b, (0.0, 0.0, 0.5), (5000.0, 0.0), 800, 600).select(F.round("to_zoom", 6).alias("to_zoom"))


def _drawn(spark, sf_dir):
    t = handoff(spark, sf_dir)
    sizes = contract.contraction(t, _HIDE, _radii(t))
    return t, settle(layout.seed(_members(t))), _by_remainder(t), settle(sizes)


@query(_HANDOFF + _SEED + " SELECT idx, round(x, 4)::DOUBLE AS x, CASE WHEN idx IN (0, 5, 10, 15, 20, 25, 30, 35) THEN 0 ELSE round(radius, 4) END::DOUBLE AS r, (CASE WHEN idx IN (0, 5, 10, 15, 20, 25, 30, 35) THEN 0 ELSE 1 END)::INT AS a, (CASE WHEN idx IN (SELECT a FROM reach WHERE a = b) THEN 4 ELSE 0 END + CASE WHEN idx <> 8 AND idx NOT IN (SELECT src FROM edges WHERE dst = 8 UNION SELECT dst FROM edges WHERE src = 8) THEN 8 ELSE 0 END)::INT AS flags FROM pos JOIN mem USING (idx)")
def node_instances(spark, sf_dir):
    t, positions, members, sizes = _drawn(spark, sf_dir)
    rows = geometry.node_instances(positions, sizes, members, traverse.components(t.edges), geometry.dimmed(t.nodes, t.edges, 8))
    return rows.select("idx", F.round("x", 4).alias("x"), F.round("r", 4).alias("r"), "a", "flags")


@query(_HANDOFF + _SEED + " SELECT src, dst, round(a.x, 4)::DOUBLE AS x0, round(b.y, 4)::DOUBLE AS y1, (CASE WHEN a.c <> b.c THEN 56 ELSE 31 END)::BIGINT AS alpha FROM edges JOIN pos a ON a.idx = src JOIN pos b ON b.idx = dst")
def edge_vertices(spark, sf_dir):
    t, positions, members, _ = _drawn(spark, sf_dir)
    rows = geometry.edge_vertices(t.edges, positions, members)
    return rows.select("src", "dst", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1"), F.shiftright("colour0", 24).alias("alpha"))


@query(_HANDOFF + _SEED + " SELECT src, dst, round(a.x, 4)::DOUBLE AS x0, (CASE WHEN a.c <> b.c THEN 179 ELSE 140 END)::BIGINT AS alpha FROM edges JOIN pos a ON a.idx = src JOIN pos b ON b.idx = dst")
def arrows(spark, sf_dir):
    t, positions, members, sizes = _drawn(spark, sf_dir)
    rows = geometry.arrows(t.edges, positions, members, sizes)
    return rows.select("src", "dst", F.round("x0", 4).alias("x0"), F.shiftright("colour", 24).alias("alpha"))


@query(_CONTACT + _CYCLES + " SELECT DISTINCT x.path[1] AS src, x.path[2] AS dst FROM (SELECT unnest(list_transform(range(1, len(cycle) + 1), lambda i: [cycle[i], cycle[CASE WHEN i = len(cycle) THEN 1 ELSE i + 1 END]])) AS path FROM cycles) x")
def cycle_highlight(spark, sf_dir):
    return geometry.cycle_edges(_cycles(spark, sf_dir)[1]).select("src", "dst")


@query("""WITH h AS (SELECT c, ((c * 137.508) % 360) / 60 AS t, (1 - abs(2 * 0.66 - 1)) * 0.85 AS s FROM (SELECT unnest(range(0, 50)) AS c)),
 l AS (SELECT c, 0.66 - s / 2 AS m, s, t FROM h), ch AS (SELECT c, [floor((m + s * greatest(0, least(1, abs(((k + t) % 6) - 3) - 1))) * 255 + 0.5) FOR k IN [0, 4, 2]] AS v FROM l)
 SELECT c::INT AS community, (v[1] + v[2] * 256 + v[3] * 65536)::BIGINT AS rgb FROM ch""")
def community_colors(spark, sf_dir):
    return spark.range(50).select(F.col("id").cast("int").alias("community")).withColumn("rgb", community_rgb(F.col("community")))


@query()
def hulls(spark, sf_dir):
    t = handoff(spark, sf_dir)
    return geometry.hulls(layout.seed(_members(t)), _by_remainder(t)).select("community", geometry.inflate(F.col("hull"), 12.0).alias("hull"), F.size(geometry.fan(F.col("hull"))).alias("triangles"))


@query()
def force_layout(spark, sf_dir):
    t = contact(spark, sf_dir)
    return layout.layout(_members(t), t.edges).drop(G)


# -- lists and parameters

@query("SELECT o_custkey AS idx, len(l)::BIGINT AS n, CASE WHEN len(l) <= 5 THEN l ELSE l[1:2] END AS head, (CASE WHEN len(l) <= 5 THEN 0 ELSE len(l) - 3 END)::INT AS n_hidden, CASE WHEN len(l) <= 5 THEN [] ELSE l[-1:] END AS tail FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)")
def collapse_list(spark, sf_dir):
    lists = tables.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("idx")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    return lists.select("idx", F.size("l").cast("long").alias("n"), keys.collapse_list(F.col("l")).alias("x")).select("idx", "n", "x.head", "x.n_hidden", "x.tail")


@query("SELECT c_custkey AS idx, list_filter(string_split(replace(c_name, '#', '||'), '|'), lambda g: g <> '') AS globs, array_to_string(list_filter(string_split(replace(c_name, '#', '||'), '|'), lambda g: g <> ''), '|') AS text FROM customer")
def param_codec(spark, sf_dir):
    t = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), globs.parse_globs_col(F.replace("c_name", F.lit("#"), F.lit("||"))).alias("globs"))
    return t.select("idx", "globs", globs.serialize_globs_col(F.col("globs")).alias("text"))


# -- generated graphs

@query()
def generated_monorepo(spark, sf_dir):
    return generators.monorepo(spark).edges.select("eidx", "src", "dst", "type")


@query()
def generated_clustered(spark, sf_dir):
    return generators.clustered(spark).edges.select("eidx", "src", "dst")


@query()
def generated_hub(spark, sf_dir):
    return generators.hub(spark).edges.select("eidx", "src", "dst")
