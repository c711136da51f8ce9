"""All queries of the code-flow engine on the driver's tables, and their SQL equivalents.

The tables hold no source code, so each query runs an engine operator on a graph or rule table derived from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspar.functions import text as T
from flowspar.operators import discovery as D
from flowspar.operators import findings as N
from flowspar.operators import label as L
from flowspar.operators import match as M
from flowspar.operators import search as G
from flowspar.operators.dominance import dominance, reachable
from flowspar.plans import code_queries
from flowspar.plans.graph import reference_chains, state_edges
from flowspar.sources.durable import durable
from flowspar.sources.tables import read

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return {**_QUERIES, **code_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **code_queries.SQL}


# --- the event graph: an edge from each event to the user's next; signups are sources, purchases sinks


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        F.format_string("e%d", "event_id").alias("node_id"), "event_id", "user_id", "ts", F.lit("assignment").alias("node_type"), F.col("event_type").alias("text"), F.format_string("u%d", "user_id").alias("file_path"),
        F.col("event_id").cast("int").alias("line"), F.col("event_type").alias("function"), F.lit(None).cast("string").alias("var_name"), F.lit(None).cast("array<string>").alias("call_args"),
    )


def event_edges(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = nodes.select("user_id", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.col("event_id").alias("seq"))
    return step.where("dst is not null").withColumn("edge_type", F.lit("DATA_FLOW"))


def event_rules(spark: SparkSession) -> DataFrame:
    rows = [("sources", "signup_flow", "signup", 0), ("sinks", "purchase_flow", "purchase", 0), ("sanitizers", "error_check", "error", 0)]
    return spark.createDataFrame(rows, "section string, category string, pattern string, ord int")


def _event_paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = durable(L.label_nodes(event_nodes(spark, d), event_rules(spark)), "labelled")  # searches filter it by label
    return G.taint_paths_within(nodes.where("taint_source is not null"), nodes.where("taint_sink is not null"), event_edges(event_nodes(spark, d)), "user_id", 20, 5), nodes


_ORDERED = "o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
_PAIRS = f"{_ORDERED}, p AS (SELECT a.event_id AS a, b.event_id AS b, a.user_id, a.rn AS ra, b.rn AS rb, (b.rn - a.rn)::INT AS hops FROM o a JOIN o b ON a.user_id = b.user_id AND b.rn > a.rn AND b.rn - a.rn <= 19 WHERE a.event_type = 'signup' AND b.event_type = 'purchase')"


@query(f"WITH {_ORDERED[0:]}, p AS (SELECT a.event_id AS source_id, b.event_id AS sink_id, (b.rn - a.rn)::INT AS hops FROM o a JOIN o b ON a.user_id = b.user_id AND b.rn > a.rn AND b.rn - a.rn <= 19 WHERE a.event_type = 'signup' AND b.event_type = 'purchase') SELECT source_id, sink_id, hops, 'purchase_flow' AS category, 'medium' AS severity FROM p")
def event_taint_reach(spark, d):
    """G1: breadth-first taint search of at most 20 nodes."""
    paths, _ = _event_paths(spark, d)
    number = lambda c: F.substring(c, 2, 20).cast("bigint")
    rows = paths.select(number("source").alias("source_id"), number("sink").alias("sink_id"), "hops", F.lit("purchase_flow").alias("category"))
    return rows.withColumn("severity", N.severity("category"))


@query(f"WITH {_PAIRS} SELECT a AS source_id, b AS sink_id, string_agg('e' || o.event_id, '>' ORDER BY o.rn) AS path FROM p JOIN o ON o.user_id = p.user_id AND o.rn BETWEEN ra AND rb GROUP BY a, b")
def event_path_string(spark, d):
    """The steps of each path, rendered."""
    paths, nodes = _event_paths(spark, d)
    rows = N.steps(paths, nodes, ["source", "sink"])
    out = rows.groupBy("source", "sink").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("s"))
    return out.select(F.substring("source", 2, 20).cast("bigint").alias("source_id"), F.substring("sink", 2, 20).cast("bigint").alias("sink_id"), F.array_join(F.transform("s", lambda x: x["node_id"]), ">").alias("path"))


@query(f"WITH {_PAIRS} SELECT a AS source_id, b AS sink_id, bool_or(o.event_type = 'error') AS sanitized FROM p JOIN o ON o.user_id = p.user_id AND o.rn BETWEEN ra AND rb GROUP BY a, b")
def event_sanitized(spark, d):
    """T5: sanitizers met on the way."""
    paths, nodes = _event_paths(spark, d)
    clean = N.sanitizers(N.steps(paths, nodes, ["source", "sink"]), event_rules(spark), ["source", "sink"])
    rows = paths.select("source", "sink").join(clean, ["source", "sink"], "left")
    return rows.select(F.substring("source", 2, 20).cast("bigint").alias("source_id"), F.substring("sink", 2, 20).cast("bigint").alias("sink_id"), F.col("sanitizers").isNotNull().alias("sanitized"))


@query(f"WITH {_ORDERED}, s AS (SELECT user_id, rn FROM o WHERE event_type = 'purchase') SELECT o.event_id, min(s.rn - o.rn)::INT AS depth FROM o JOIN s ON s.user_id = o.user_id AND s.rn - o.rn BETWEEN 0 AND 15 WHERE o.event_type = 'signup' GROUP BY o.event_id")
def backward_sources(spark, d):
    """Backward search from the sinks, 15 deep, down to the sources."""
    nodes = event_nodes(spark, d)
    found = G.trace(nodes.where("text = 'purchase'"), event_edges(nodes), 15, backward=True)
    return found.join(nodes.where("text = 'signup'"), "node_id").select("event_id", "depth")


@query(f"WITH {_ORDERED}, s AS (SELECT user_id, rn FROM o WHERE event_type = 'signup') SELECT o.event_id, min(o.rn - s.rn)::INT AS depth FROM o JOIN s ON s.user_id = o.user_id AND o.rn - s.rn BETWEEN 0 AND 15 WHERE o.event_type = 'purchase' GROUP BY o.event_id")
def forward_sinks(spark, d):
    """Forward search from the sources, 15 deep, to the sinks."""
    nodes = event_nodes(spark, d)
    found = G.trace(nodes.where("text = 'signup'"), event_edges(nodes), 15)
    return found.join(nodes.where("text = 'purchase'"), "node_id").select("event_id", "depth")


@query(f"WITH {_PAIRS}, f AS (SELECT a, b, hops, row_number() OVER (PARTITION BY b ORDER BY hops DESC, a) AS n FROM p), u AS (SELECT b, min(a) AS a FROM p GROUP BY b) SELECT user_id, count(*) AS pairs, max(hops) AS longest FROM p GROUP BY user_id")
def reach_by_user(spark, d):
    """A1: paths by file (here: user)."""
    paths, nodes = _event_paths(spark, d)
    return paths.join(nodes.select(F.col("node_id").alias("source"), "user_id"), "source").groupBy("user_id").agg(F.count("*").alias("pairs"), F.max("hops").alias("longest"))


@query("""WITH t AS (SELECT conv_id, min(turn) AS a, max(turn) AS b, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, (n - 1)::INT AS hops FROM t WHERE n > 1""")
def call_chain(spark, d):
    """The chain of calls from the first turn of a conversation to its last."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.format_string("%d:%d", "conv_id", "turn").alias("node_id"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    edges = c.select(F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.col("turn").alias("seq"), F.lit("CALLS").alias("edge_type")).where("dst is not null")
    ends = c.groupBy("conv_id").agg(F.min_by("node_id", "turn").alias("first"), F.max_by("node_id", "turn").alias("last"))
    paths = G.taint_paths(ends.select(F.col("first").alias("node_id")), ends.select(F.col("last").alias("node_id")), edges, 20, 1)
    return paths.select(F.substring_index("source", ":", 1).cast("bigint").alias("conv_id"), "hops")


_STEPS = "s AS (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)"


def _nation_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nations, segments, edges): nation -> customer -> market segment, successors by customer key."""
    c = read(spark, d, "customer")
    nation, customer, segment = F.format_string("n%02d", "c_nationkey"), F.format_string("c%d", "c_custkey"), F.concat(F.lit("s"), "c_mktsegment")
    one = lambda a, b: c.select(a.alias("src"), b.alias("dst"), F.lit("DATA_FLOW").alias("edge_type"), F.col("c_custkey").alias("seq"))
    ids = lambda a: c.select(a.alias("node_id")).distinct()
    return ids(nation), ids(segment), one(nation, customer).unionByName(one(customer, segment))


@query(f"WITH {_STEPS} SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS custkey FROM s WHERE CASE WHEN n <= 5 THEN true ELSE rn BETWEEN 2 AND 6 END")
def paths_per_pair(spark, d):
    """A branching graph. A sink that is queued already is recorded again at once, and itself only when it is
    popped; so of more than five ways the second to the sixth are kept."""
    nations, segments, edges = _nation_graph(spark, d)
    paths = G.taint_paths(nations, segments, edges)
    return paths.select(F.substring("source", 2, 9).cast("int").alias("nation"), F.substring("sink", 2, 99).alias("segment"), F.substring(F.col("path")[1], 2, 20).cast("bigint").alias("custkey"))


@query(f"WITH {_STEPS} SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS custkey, 2 AS hops FROM s WHERE rn = 1 AND c_nationkey = (SELECT min(c_nationkey) FROM customer c WHERE c.c_mktsegment = s.c_mktsegment)")
def find_path(spark, d):
    """One visited set for all sources: the first nation that gets to a segment takes it."""
    nations, segments, edges = _nation_graph(spark, d)
    paths = G.find_path(nations, segments, edges)
    return paths.select(F.substring("source", 2, 9).cast("int").alias("nation"), F.substring("sink", 2, 99).alias("segment"), F.substring(F.col("path")[1], 2, 20).cast("bigint").alias("custkey"), "hops")


@query(f"WITH {_PAIRS}, c AS (SELECT a, b, hops, row_number() OVER (PARTITION BY hops ORDER BY a, b) AS n FROM p) SELECT a AS source_id, b AS sink_id, hops FROM c WHERE n <= 50")
def reach_capped(spark, d):
    """At most 50 findings of each category (here: path length)."""
    paths, _ = _event_paths(spark, d)
    rows = paths.select(F.substring("source", 2, 20).cast("bigint").alias("source_id"), F.substring("sink", 2, 20).cast("bigint").alias("sink_id"), "hops")
    return N.capped(rows, "hops", ["source_id", "sink_id"], 50)


@query(f"WITH {_PAIRS} SELECT hops, count(*) - 50 AS truncated FROM p GROUP BY hops HAVING count(*) > 50")
def truncated_by_category(spark, d):
    """A2: how many a cap leaves out."""
    return N.truncated(_event_paths(spark, d)[0].select("hops"), "hops", 50)


# --- rules over pages and documents


def page_rules(spark: SparkSession) -> DataFrame:
    rows = [
        ("sources", "tracking", 'lang="es"', 0), ("sources", "tracking", "utm_source", 1), ("sources", "query", 'lang="fr"', 2), ("sinks", "markup", "<script", 0), ("sinks", "markup", '<a href="/and"', 1),
        ("sinks", "anchor", '<a href="/the"', 2), ("sinks", "meta", '<a href="/of"', 3), ("sink_excludes", "", r"<b>\w+%%%", 0), ("sanitizers", "escape", "&amp;", 0),
    ]
    return spark.createDataFrame(rows, "section string, category string, pattern string, ord int")


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.col("page_id"), F.format_string("p%d", "page_id").alias("node_id"), F.lit("assignment").alias("node_type"), F.col("html").alias("text"), "url")


_RULES = "r(section, category, pattern, ord) AS (VALUES ('sinks','markup','<script',0),('sinks','markup','<a href=\"/and\"',1),('sinks','anchor','<a href=\"/the\"',2),('sinks','meta','<a href=\"/of\"',3))"


@query(f"WITH {_RULES} SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM pages JOIN r ON section = 'sinks' AND contains(html, pattern) GROUP BY page_id")
def rule_label_pages(spark, d):
    """Substring theta-join with the rules, categories as a sorted set."""
    n = L.with_matches(page_nodes(spark, d), page_rules(spark), "sinks").where("size(_m) > 0")
    return n.select("page_id", F.array_join(L.category_set(), ",").alias("categories"))


@query(f"WITH {_RULES}, m AS (SELECT page_id, category, pattern, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, category, ord) AS n FROM pages JOIN r ON section = 'sinks' AND contains(html, pattern)) SELECT page_id, category, pattern FROM m WHERE n = 1")
def label_longest(spark, d):
    """The longest pattern wins."""
    n = L.with_matches(page_nodes(spark, d), page_rules(spark), "sinks").where("size(_m) > 0").withColumn("best", L.longest())
    return n.select("page_id", "best.category", "best.pattern")


@query("SELECT page_id FROM pages WHERE contains(html, '<script') AND NOT regexp_matches(html, '<b>[0-9A-Za-z_]+%%%')")
def label_exclude(spark, d):
    """Sinks without those that an exclusion is found in."""
    n = page_nodes(spark, d).where(F.contains("text", F.lit("<script")))
    return L.with_excluded(n, page_rules(spark)).where("not _out").select("page_id")


@query("SELECT page_id, CASE WHEN contains(html, 'lang=\"es\"') OR contains(html, 'utm_source') OR contains(html, 'lang=\"fr\"') THEN 'source' WHEN contains(html, '<script') AND NOT regexp_matches(html, '<b>[0-9A-Za-z_]+%%%') THEN 'sink' ELSE 'none' END AS label FROM pages")
def source_priority(spark, d):
    """A node with a source label gets no sink label, and an excluded one none."""
    n = L.label_nodes(page_nodes(spark, d), page_rules(spark))
    return n.select("page_id", F.when(F.col("taint_source").isNotNull(), "source").when(F.col("taint_sink").isNotNull(), "sink").otherwise("none").alias("label"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_$])(the)([^A-Za-z0-9_$]|$)')")
def word_boundary_docs(spark, d):
    """P5: whole identifiers."""
    return read(spark, d, "documents").where(L.identifier_in("text", F.lit("the"))).select("doc_id")


@query("SELECT page_id FROM pages WHERE contains(html, '&amp;')")
def sanitizer_match(spark, d):
    """Sanitizers."""
    return L.with_matches(page_nodes(spark, d), page_rules(spark), "sanitizers").where("size(_m) > 0").select("page_id")


@query("""SELECT page_id FROM pages WHERE contains(url, '<a href="/and"') OR contains(html, '<a href="/and"') ORDER BY page_id LIMIT 200""")
def attribute_search(spark, d):
    """P10: substring search in any attribute, at most 200 (the operator's limit)."""
    n = page_nodes(spark, d).withColumn("node_id", F.format_string("p%012d", "page_id"))
    return L.search_nodes(n, '<a href="/and"', ["text", "url"]).select("page_id")


# --- joins


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch(ts)::BIGINT AS at, (epoch(ts)::BIGINT + (1 + event_id % 5) * (1 + event_id % 7) * 3600 * (1 + 20 * (event_id % 11 = 0)::INT)) AS until FROM events)
SELECT s.event_id, count(*) AS events FROM e s JOIN e p ON p.user_id = s.user_id AND p.at BETWEEN s.at AND s.until WHERE s.event_type = 'signup' GROUP BY s.event_id""")
def span_join(spark, d):
    """Points in spans of the same key, of very different widths, joined by buckets."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("at"))  # epoch(ts)::BIGINT rounds
    hours = F.expr("(1 + event_id % 5) * (1 + event_id % 7) * (1 + 20 * cast(event_id % 11 = 0 as int))")
    spans = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("at").alias("s"), (F.col("at") + hours * 3600).alias("e"))
    return M.in_span(e.select("user_id", "at"), spans, ["user_id"], "at", "s", "e", 3600).groupBy("event_id").agg(F.count("*").alias("events"))


@query("""WITH s AS (SELECT p_partkey, p_size, p_retailprice - p_size AS a, p_retailprice + p_size AS b, p_brand FROM part),
j AS (SELECT l.p_partkey, s.p_partkey AS span_key, row_number() OVER (PARTITION BY l.p_partkey ORDER BY s.b - s.a, s.p_partkey) AS n FROM part l JOIN s ON s.p_brand = l.p_brand AND l.p_retailprice BETWEEN s.a AND s.b AND s.p_partkey <> l.p_partkey)
SELECT p_partkey, span_key FROM j WHERE n = 1""")
def smallest_span(spark, d):
    """The narrowest span that holds a point."""
    p = read(spark, d, "part")
    spans = p.select(F.col("p_partkey").alias("span_key"), "p_brand", (F.col("p_retailprice") - F.col("p_size")).alias("a"), (F.col("p_retailprice") + F.col("p_size")).alias("b"))
    rows = M.smallest_span(p.select("p_partkey", "p_brand", "p_retailprice"), spans, ["p_brand"], "p_retailprice", "a", "b", ["span_key"], ["p_partkey"], 50, ("span_key", "p_partkey"))
    return rows.select("p_partkey", "span_key")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS cn FROM customer), s AS (SELECT s_suppkey, s_nationkey, regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT AS sn FROM supplier),
a AS (SELECT c_custkey, s_suppkey FROM c JOIN s ON cn = sn), b AS (SELECT c_custkey, s_suppkey FROM c JOIN s ON c_nationkey = s_nationkey WHERE c_custkey NOT IN (SELECT c_custkey FROM a) AND s_suppkey % 7 = c_custkey % 7),
x AS (SELECT c_custkey, s_suppkey FROM c JOIN s ON s_suppkey % 20 = c_custkey % 20 WHERE c_custkey NOT IN (SELECT c_custkey FROM a) AND c_custkey NOT IN (SELECT c_custkey FROM b))
SELECT *, 'high' AS tier FROM a UNION ALL SELECT *, 'medium' FROM b UNION ALL SELECT *, 'low' FROM x""")
def three_tier_match(spark, d):
    """By name, else by position, else loosely."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", number("c_name").alias("cn"))
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", number("s_name").alias("sn"))
    high, low = ([F.col("cn")], [F.col("sn")]), ([F.col("c_custkey") % 20], [F.col("s_suppkey") % 20])
    medium = [F.col("c_nationkey"), F.col("c_custkey") % 7], [F.col("s_nationkey"), F.col("s_suppkey") % 7]
    return M.tiers(c, s, ["c_custkey"], [("high", *high), ("medium", *medium), ("low", *low)], ["s_suppkey"])


@query("""WITH e AS (SELECT l.doc_id, b.doc_id AS linked FROM labels l JOIN documents a ON a.doc_id = l.doc_id JOIN documents b ON b.source = a.source AND b.lang = a.lang AND b.doc_id = l.doc_id + 20),
g AS (SELECT source, lang, min(doc_id) AS linked FROM documents WHERE n_chars < 2000 OR doc_id % 7 = 0 GROUP BY source, lang)
SELECT l.doc_id, coalesce(e.linked, g.linked) AS linked, CASE WHEN e.linked IS NOT NULL THEN 'exact' WHEN g.linked IS NOT NULL THEN 'group' ELSE 'none' END AS match
FROM labels l JOIN documents a ON a.doc_id = l.doc_id LEFT JOIN (SELECT e.* FROM e JOIN documents d ON d.doc_id = e.linked WHERE d.n_chars < 2000 OR d.doc_id % 7 = 0) e ON e.doc_id = l.doc_id LEFT JOIN g ON g.source = a.source AND g.lang = a.lang""")
def tiered_link(spark, d):
    """Exact match, else the first of the same group, else none."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    left = read(spark, d, "labels").select("doc_id").join(docs, "doc_id").select("doc_id", "source", "lang", (F.col("doc_id") + 20).alias("at"))
    right = docs.where("n_chars < 2000 or doc_id % 7 = 0").select(F.col("doc_id").alias("linked"), F.col("doc_id").alias("at"), "source", "lang")
    return M.exact_or_first(left, right, ["doc_id"], ["source", "lang", "at"], ["source", "lang"], ["linked"], ["linked"]).select("doc_id", "linked", "match")


@query("""SELECT e.event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.user_id = e.user_id AND f.ts::DATE = e.ts::DATE)""")
def alias_suppress(spark, d):
    """Pattern findings that a taint finding of the same place and aliased category covers are left out."""
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    pattern = e.where("event_type = 'error'").withColumn("category", F.lit("weak_crypto"))
    taint = e.where("event_type = 'purchase'").withColumn("category", F.lit("crypto_weakness"))
    return N.suppress_aliases(pattern, taint, ["user_id", "day"]).select("event_id")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = s_suppkey AND o_orderpriority LIKE '1%' AND l_quantity > 49)""")
def exposed_no_source(spark, d):
    """Endpoints whose handler has no labelled source."""
    urgent = read(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    held = read(spark, d, "lineitem").where("l_quantity > 49").join(urgent, "l_orderkey", "left_semi")
    nodes = held.select(F.lit("shop").alias("file_path"), F.col("l_suppkey").cast("string").alias("function"), F.array(F.lit("injection_general")).alias("taint_source"))
    ends = read(spark, d, "supplier").select(F.lit("shop").alias("file_path"), F.col("s_suppkey").cast("string").alias("handler"), F.col("s_name").alias("route"), F.array().cast("array<string>").alias("methods"), F.lit(1).alias("line"))
    return N.exposed_without_source(ends, nodes).select(F.col("handler").cast("long").alias("s_suppkey"), F.col("route").alias("s_name"))


@query("""WITH e AS (SELECT *, 'k' || (floor(value)::BIGINT % 7) AS slot, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'A' ELSE 'B' END AS scope FROM events)
SELECT w.event_id AS write_id, r.event_id AS read_id FROM e w JOIN e r ON w.user_id = r.user_id AND w.slot = r.slot AND (w.scope IS NULL OR r.scope IS NULL OR w.scope = r.scope) WHERE w.event_type = 'signup' AND r.event_type = 'view'""")
def state_bridge(spark, d):
    """Writes of a slot to its reads in the same file, where an unknown class matches any."""
    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("file_path"), "event_type", F.concat(F.lit("k"), (F.floor("value") % 7).cast("string")).alias("slot"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("function"))
    wrote = F.col("event_type") == "signup"
    text = F.when(wrote, F.concat(F.lit("self."), "slot", F.lit(" = 1"))).otherwise(F.concat(F.lit("use(self."), "slot", F.lit(")")))
    nodes = e.where("event_type in ('signup', 'view')").select(F.col("event_id").cast("string").alias("node_id"), "file_path", "function", text.alias("text"), F.when(wrote, "assignment").otherwise("call_site").alias("node_type"), F.when(wrote, "self").alias("var_name"))
    slots = e.select("file_path", F.concat(F.lit("self."), "slot").alias("slot")).distinct()
    functions = e.select("file_path", F.col("function").alias("name"), F.when(F.col("function") == "f1", "A").when(F.col("function") == "f2", "B").alias("class_name")).distinct()
    out = state_edges(nodes, slots, functions)
    return out.select(F.col("src").cast("long").alias("write_id"), F.col("dst").cast("long").alias("read_id"))


@query("""SELECT l_orderkey, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY l_orderkey""")
def first_assignment(spark, d):
    """The earliest of each group."""
    return M.earliest(read(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", ["l_shipdate", "l_linenumber", "l_partkey"], "first_part")


# --- shaping


@query("""WITH c(category, sev) AS (VALUES ('sql_injection', 3), ('xss', 1), ('ssrf', 2)), d AS (SELECT doc_id, 'sql_injection' AS category, 3 AS sev, length('the') AS n FROM documents WHERE contains(text, 'the') UNION ALL SELECT doc_id, 'xss', 1, 2 FROM documents WHERE contains(text, 'en') UNION ALL SELECT doc_id, 'ssrf', 2, 4 FROM documents WHERE contains(text, 'tion')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sev DESC, n DESC, category) AS k FROM d)
SELECT doc_id, max(CASE WHEN k = 1 THEN category END) AS main, coalesce(string_agg(CASE WHEN k > 1 THEN category END, ',' ORDER BY category), '') AS related FROM r GROUP BY doc_id""")
def merge_categories(spark, d):
    """A3: one finding for a place; the severest category leads, the others are related."""
    rules = spark.createDataFrame([("sinks", "sql_injection", "the", 0), ("sinks", "xss", "en", 1), ("sinks", "ssrf", "tion", 2)], "section string, category string, pattern string, ord int")
    docs = read(spark, d, "documents").select("doc_id", "text")
    hits = L.with_matches(docs, rules, "sinks").select("doc_id", F.explode("_m").alias("m")).select("doc_id", "m.category", F.length("m.pattern").alias("pattern_length"))
    return N.merge_categories(hits, ["doc_id"]).select("doc_id", "main", F.array_join("related", ",").alias("related"))


@query("""WITH l AS (SELECT event_id, user_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, event_type FROM l WHERE b IS DISTINCT FROM event_type""")
def chain_fold(spark, d):
    """Successive steps of the same function fold (here: a user's successive events of one type)."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    return M.folded(e, ["user_id"], "n", "event_type").select("event_id", "user_id", "event_type")


@query("""WITH d AS (SELECT user_id, event_type, min(event_id) AS def_line FROM events GROUP BY ALL), u AS (SELECT e.user_id, e.event_type, def_line, event_id AS use_line FROM events e JOIN d USING (user_id, event_type) WHERE event_id <> def_line)
SELECT user_id, event_type, def_line, use_line, lag(use_line) OVER (PARTITION BY user_id, event_type ORDER BY use_line) AS before FROM u""")
def use_chain(spark, d):
    """The uses of a definition, each chained to the one before."""
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), F.lit("f").alias("function"), F.lit(1).alias("fn_line"), F.col("event_type").alias("var_name"), F.col("event_id").alias("line"))
    defs = e.groupBy("file_path", "function", "fn_line", "var_name").agg(F.min("line").alias("line")).withColumn("enhanced_for", F.lit(False))
    return reference_chains(defs, e).select(F.col("file_path").cast("long").alias("user_id"), F.col("var_name").alias("event_type"), "def_line", "use_line", "before")


@query(r"""SELECT page_id, regexp_extract_all(html, '([A-Za-z_$][0-9A-Za-z_$]*)\s*\(', 1)[-1] AS last_call FROM pages""")
def last_call_name(spark, d):
    """The last call of a chain."""
    return read(spark, d, "pages").select("page_id", L.last_call("html").alias("last_call"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS route, '/api/' || ltrim(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/') AS merged FROM pages""")
def route_merge(spark, d):
    """Route merging."""
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("route"))
    return p.withColumn("merged", T.merge_route(F.lit("/api/"), "route"))


@query(r"""WITH r AS (SELECT page_id, '/{' || regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '\.', '}/{', 'g') || '}' AS route FROM pages) SELECT page_id, array_to_string(regexp_extract_all(route, '\{([0-9A-Za-z_]+)\}', 1), ',') AS params FROM r""")
def route_params(spark, d):
    """Parameters of a route."""
    r = read(spark, d, "pages").select("page_id", F.concat(F.lit("/{"), F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), r"\.", "}/{"), F.lit("}")).alias("route"))
    return r.select("page_id", F.array_join(T.path_params("route", "fastapi"), ",").alias("params"))


@query("""SELECT doc_id, quality, toxic, 'a' AS side FROM (SELECT * FROM labels WHERE quality = 1 EXCEPT ALL SELECT * FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, quality, toxic, 'b' FROM (SELECT * FROM labels WHERE toxic = 1 EXCEPT ALL SELECT * FROM labels WHERE quality = 1)""")
def fingerprint_diff(spark, d):
    """Symmetric difference of two reports."""
    x = read(spark, d, "labels")
    return M.symmetric_difference(x.where("quality = 1"), x.where("toxic = 1"))


@query("""WITH j AS (SELECT lang, quality = 1 AS t, contains(text, '%%%') = false AND contains(text, '!!') = false AS f FROM labels JOIN documents USING (doc_id)),
c AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS lang, count(*) FILTER (t AND f) AS tp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (NOT t AND NOT f) AS tn FROM j GROUP BY ROLLUP (lang))
SELECT *, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp * 100.0 / (tp + fn), 1) END::DOUBLE AS tpr, CASE WHEN fp + tn = 0 THEN 0.0 ELSE round(fp * 100.0 / (fp + tn), 1) END::DOUBLE AS fpr FROM c""")
def confusion_matrix(spark, d):
    """Expected results against found ones, with a total."""
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    j = j.select("lang", (F.col("quality") == 1).alias("t"), (~F.contains("text", F.lit("%%%")) & ~F.contains("text", F.lit("!!"))).alias("f"))
    out = D.confusion(j, "lang", "t", "f")
    return out.withColumn("tpr", F.col("tpr").cast("double")).withColumn("fpr", F.col("fpr").cast("double"))


@query("""SELECT source, count(*) AS docs, count(*) FILTER (contains(text, 'the')) AS hits, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (contains(text, 'the')) / count(*), 3) END AS ratio FROM documents GROUP BY source""")
def coverage_ratio(spark, d):
    """A5: coverage to three places."""
    x = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.contains("text", F.lit("the"))).alias("hits"))
    return x.withColumn("ratio", M.ratio(F.col("hits"), F.col("docs")))


_SCORE = "least(100, (CASE WHEN {any} THEN 20 ELSE 0 END) + least(30, 8 * ({words})) + (CASE {modules} ELSE 0 END))".format(
    any=" OR ".join("contains(html, '%s')" % m.replace("'", "''") for m in D.JOINED),
    words=" + ".join("contains(lower(html), '%s')::INT" % k for k in D.KEYWORDS),
    modules=" ".join("WHEN contains(lower(html), '%s') THEN %d" % (m.lower(), w) for m, w in D.MODULES),
)


@query(f"SELECT page_id, ({_SCORE})::INT AS score FROM pages")
def heuristic_score(spark, d):
    """Heuristic score of code text."""
    return read(spark, d, "pages").select("page_id", D.heuristic_score("html").cast("int").alias("score"))


_BLOCKS = "o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), b AS (SELECT user_id, rn FROM o), e AS (SELECT a.user_id, a.rn AS s, c.rn AS t FROM b a JOIN b c ON a.user_id = c.user_id AND (c.rn = a.rn + 1 AND a.rn % 4 <> 2 OR c.rn = a.rn + 2 AND a.rn % 4 IN (1, 2) OR c.rn = a.rn - 3 AND a.rn % 4 = 0))"


def _user_blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A control-flow graph for each user over all events: of every four, a branch at the first, a jump at the second and a loop at the last."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    o = read(spark, d, "events").withColumn("rn", rn).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).select(F.col("user_id").cast("string").alias("fn"), "rn", "n")
    name = lambda c: F.format_string("b%02d", c)
    blocks = o.select("fn", name("rn").alias("block_id"), F.when(F.col("rn") == 1, "entry").otherwise("normal").alias("block_type"))
    to = F.expr("filter(array(if(rn % 4 <> 2, rn + 1, 0), if(rn % 4 in (1, 2), rn + 2, 0), if(rn % 4 = 0, rn - 3, 0)), t -> t between 1 and n)")
    return blocks, o.where("fn is not null").select("fn", name("rn").alias("src"), F.explode(to).alias("t")).select("fn", "src", name("t").alias("dst"))


@query(f"""WITH RECURSIVE {_BLOCKS}, x AS (SELECT user_id, rn AS removed FROM b UNION ALL SELECT DISTINCT user_id, 0 FROM b),
r AS (SELECT user_id, removed, 1 AS rn FROM x WHERE removed <> 1 UNION SELECT r.user_id, r.removed, e.t FROM r JOIN e ON e.user_id = r.user_id AND e.s = r.rn AND e.t <> r.removed)
SELECT u.user_id::VARCHAR AS fn, printf('b%02d', x.removed::BIGINT) AS a, printf('b%02d', u.rn::BIGINT) AS b FROM (SELECT user_id, rn FROM r WHERE removed = 0) u JOIN x ON x.user_id = u.user_id AND x.removed > 0
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.removed = x.removed AND r.rn = u.rn)""")
def dominators(spark, d):
    """A dominates b if b can't be reached without a."""
    blocks, edges = _user_blocks(spark, d)
    return dominance(blocks, edges, only_dom=True).select("fn", "a", "b")


@query(None)
def control_dependence(spark, d):
    """Post-dominators, trees and control dependence (tests/test_graph.py holds it against brute force)."""
    blocks, edges = _user_blocks(spark, d)
    return dominance(blocks, edges).where("relation <> 'dom'")


@query(f"""WITH RECURSIVE {_BLOCKS}, r AS (SELECT user_id, 1 AS rn FROM b WHERE rn = 1 UNION SELECT r.user_id, e.t FROM r JOIN e ON e.user_id = r.user_id AND e.s = r.rn) SELECT user_id::VARCHAR AS fn, count(*) AS blocks FROM r GROUP BY user_id""")
def reachable_blocks(spark, d):
    """Blocks that control can reach, the entry included."""
    blocks, edges = _user_blocks(spark, d)
    found = reachable(blocks.where("block_type = 'entry'").select("fn", "block_id"), edges, 1_000_000)
    return found.groupBy("fn").agg(F.count("*").alias("blocks"))


@query("""WITH a(section, category, pattern, src, ord) AS (SELECT 'sinks', p_type, p_brand, 0, min(p_partkey) FROM part WHERE p_size < 25 GROUP BY ALL UNION ALL SELECT 'sinks', p_type, p_brand, 1, min(p_partkey) FROM part WHERE p_size > 20 GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY section, category, pattern ORDER BY src, ord) AS n FROM a)
SELECT section, category, pattern, row_number() OVER (PARTITION BY section, category ORDER BY src, ord, pattern)::INT AS place FROM d WHERE n = 1""")
def rules_merge(spark, d):
    """Rule files append, earlier ones first, each pattern once."""
    from flowspar.sources.rules import merge_rules

    p = read(spark, d, "part")
    part = lambda cond, src: p.where(cond).groupBy(F.lit("sinks").alias("section"), F.col("p_type").alias("category"), F.col("p_brand").alias("pattern")).agg(F.min("p_partkey").alias("ord")).withColumn("src", F.lit(src))
    return merge_rules(part("p_size < 25", 0).unionByName(part("p_size > 20", 1))).select("section", "category", "pattern", "place")


@query("""SELECT c_mktsegment, count(*) || '-' || sum(('0x' || substr(sha256(c_name), 1, 15))::BIGINT)::HUGEINT AS fingerprint FROM customer GROUP BY c_mktsegment""")
def content_fingerprint(spark, d):
    """A digest of all entries, in any order."""
    from flowspar.sources.rules import fingerprint

    return fingerprint(read(spark, d, "customer"), ["c_mktsegment"], "c_name")


@query("""SELECT l_orderkey, l_returnflag, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1""")
def last_wins(spark, d):
    """Nodes with the same id merge; the last one's attributes stay."""
    return M.last_wins(read(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_partkey", "l_quantity"], ["l_shipdate", "l_linenumber"])


@query("""SELECT lang, count(*) AS docs FROM documents GROUP BY lang ORDER BY docs DESC, lang LIMIT 1""")
def dominant_language(spark, d):
    """The most common language."""
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(1)


@query("""SELECT DISTINCT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def category_gap(spark, d):
    """Known categories without active ones."""
    active = read(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return read(spark, d, "nation").join(active, "n_nationkey", "left_anti").select("n_name").distinct()


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) SELECT doc_id, n::INT AS line, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM l""")
def source_lines(spark, d):
    """Lines by number, stripped."""
    from flowspar.sources.files import lines

    return lines(read(spark, d, "documents"), "doc_id", "text")
