"""What a scan can't see: coverage ratios and the blind-spot manifest; and the query API on labelled graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspar import schema as S
from flowspar.operators import findings as N
from flowspar.operators import label as L
from flowspar.operators import search as G
from flowspar.sources.durable import durable

_STRUCTURAL = """idor_no_structural_signature/high business_logic_no_sink/medium race_condition_not_modeled/medium second_order_not_modeled/medium
prototype_pollution_not_modeled/low negative_space_validation/high auth_implementation_quality/high authorization_granularity/high data_protection_lifecycle/medium
crypto_implementation_correctness/medium http_security_headers/medium network_defense_config/medium deploy_config_gaps/high logging_security/medium client_side_js_security/medium
injection_edge_cases/medium sql_advanced/medium file_security_gaps/medium ssrf_defense_depth/high ssti_xss_defense_depth/medium misc_security_gaps/low supply_chain_gaps/low"""
STRUCTURAL = [tuple(x.split("/")) for x in _STRUCTURAL.split()]
MANIFEST = "kind string, category string, location string, reason string, severity string, cwe string"


def category_gap(known: DataFrame, active: DataFrame, key: str = "category") -> DataFrame:
    """Known categories without an active one."""
    return known.select(key).distinct().join(active.select(key).distinct(), key, "left_anti")


def blind_spot_manifest(endpoints: DataFrame, nodes: DataFrame, rules: DataFrame, found: DataFrame | None, phase3: DataFrame | None = None) -> DataFrame:
    """Everything a reviewer has to look at by hand (T11), as one table: endpoints without a source, endpoints without
    authentication, what no graph shows (fixed rows), categories with sinks in the rules but none in the code or no
    finding, and the open items of a phase-3 manifest (category, id, name, severity, cwe, status, needs_llm, reason). Without
    ``found`` there are no rows on what findings leave uncovered."""
    spark = nodes.sparkSession
    place = F.format_string("%s:%d", "file_path", "line")
    none = F.lit(None).cast("string")
    row = lambda df, kind, category, location, reason, severity, cwe=none: df.select(F.lit(kind).alias("kind"), category.alias("category"), location.alias("location"), reason.alias("reason"), severity.alias("severity"), cwe.alias("cwe"))
    bare = row(N.exposed_without_source(endpoints, nodes), "endpoint_no_source", none, place, F.concat_ws(" ", "method_list", "route"), F.lit("medium"))
    unguarded = row(endpoints.where("not coalesce(auth_required, false)"), "endpoint_no_auth", none, place, F.concat_ws(" ", F.array_join("methods", ","), "route"), F.lit("high"))
    fixed = spark.createDataFrame([("structural", None, None, reason, severity, None) for reason, severity in STRUCTURAL], MANIFEST)
    known = rules.where("section = 'sinks'").select("category").distinct()
    active = nodes.select(F.explode("taint_sink").alias("category")).distinct()
    cwe = N.mapped(S.CWE, "category", none)
    gaps = row(category_gap(known, active), "category_gap", F.col("category"), none, F.lit("no sink of this category in the code"), N.severity("category"), cwe)
    out = bare.unionByName(unguarded).unionByName(fixed).unionByName(gaps)
    if found is not None:
        reached = found.select(F.explode(F.concat(F.array("vuln_type"), "related_categories")).alias("category")).distinct()
        out = out.unionByName(row(category_gap(active, reached), "category_uncovered", F.col("category"), none, F.lit("sinks, but no finding"), N.severity("category"), cwe))
    if phase3 is not None:
        open_items = phase3.where("coalesce(status, '') <> 'covered' or coalesce(needs_llm, false)")
        out = out.unionByName(row(open_items, "phase3", F.col("category"), F.col("id"), F.coalesce("reason", "name"), F.coalesce("severity", F.lit("medium")), F.col("cwe")))
    return out


def path_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The steps of found paths (T12): (source, sink, pos, file_path, line, function, node_type, code), code cut to 80."""
    rows = N.steps(paths, nodes, ["source", "sink"])
    return rows.select("source", "sink", "pos", "edge_type", "file_path", "line", "function", "node_type", F.substring("text", 1, 80).alias("code"))


def path_text(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, sink, text): each path as an indented tree of its steps."""
    step = F.concat(F.repeat(F.lit("  "), F.col("pos")), F.when(F.col("pos") == 0, "").otherwise("└ "), F.format_string("%s:%d ", "file_path", "line"), F.coalesce("code", "function", F.lit("")))
    held = path_nodes(paths, nodes).withColumn("_t", step)
    return held.groupBy("source", "sink").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), "\n").alias("text"))


FALLBACKS = "int( float( str( escape( sanitize filter validate".split()


def path_sanitizers(paths: DataFrame, nodes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(source, sink, sanitizers): sanitizer patterns of any category in the texts on each path (T6), in order; without rules
    a few general ones are looked for."""
    spark = nodes.sparkSession
    if rules is None:
        rules = spark.createDataFrame([("sanitizers", "general", p, i) for i, p in enumerate(FALLBACKS)], "section string, category string, pattern string, ord int")
    rows = L.with_matches(N.steps(paths, nodes, ["source", "sink"]), rules, "sanitizers").select("source", "sink", F.explode("_m").alias("m"))
    return rows.groupBy("source", "sink").agg(F.array_sort(F.collect_set("m.pattern")).alias("sanitizers"))


def find_path(nodes: DataFrame, edges: DataFrame, rules: DataFrame, source_pattern: str, sink_pattern: str, max_depth: int = S.MAX_NODES) -> DataFrame:
    """``search.find_path`` between what two patterns mean (see ``label.taint_nodes``)."""
    return G.find_path(L.taint_nodes(nodes, rules, source_pattern, "source"), L.taint_nodes(nodes, rules, sink_pattern, "sink"), edges, max_depth)


def find_sources(nodes: DataFrame, edges: DataFrame, rules: DataFrame, sink_pattern: str, max_depth: int = 15) -> DataFrame:
    """Assignments and labelled nodes that lead to what the pattern means, those themselves included."""
    back = G.trace(L.taint_nodes(nodes, rules, sink_pattern, "sink"), edges, max_depth, backward=True)
    return nodes.where("node_type = 'assignment' or taint_source is not null or taint_sink is not null").join(back, "node_id")


def find_sinks(nodes: DataFrame, edges: DataFrame, rules: DataFrame, source_pattern: str, max_depth: int = 15) -> DataFrame:
    """Labelled nodes that what the pattern means leads to."""
    ahead = G.trace(L.taint_nodes(nodes, rules, source_pattern, "source"), edges, max_depth)
    return nodes.where("taint_source is not null or taint_sink is not null").join(ahead, "node_id")


def endpoint_paths(nodes: DataFrame, edges: DataFrame, endpoints: DataFrame, max_depth: int = S.MAX_NODES) -> DataFrame:
    """(file_path, handler, source, sink, path, hops): for each handler the flows from its own sources to any sink, the
    shortest for each pair of ends (G12)."""
    own = nodes.where("taint_source is not null").select("node_id", "file_path", F.col("function").alias("handler")).join(endpoints.select("file_path", "handler").distinct(), ["file_path", "handler"])
    own = durable(own, "handler_sources")
    paths = G.taint_paths(own.select("node_id"), nodes.where("taint_sink is not null"), edges, max_depth, 1)
    return paths.join(own.withColumnRenamed("node_id", "source"), "source").select("file_path", "handler", "source", "sink", "path", "hops")


def return_derivation(defs: DataFrame, functions: DataFrame, depth: int = 20) -> DataFrame:
    """(file_path, function, var_name, derived): variables that values of var_name flow into inside a function, over any
    number of assignments (G13), var_name itself included. Transitive closure by doubling, at most 2 ** depth steps."""
    d = defs.where("not is_param").select("file_path", "function", F.col("var_name").alias("derived"), "text").distinct()
    names = defs.select("file_path", "function", "var_name").distinct()
    step = durable(names.join(d, ["file_path", "function"]).where((F.col("var_name") != F.col("derived")) & L.identifier_in("text", "var_name")).select("file_path", "function", "var_name", "derived").distinct().unionByName(names.withColumn("derived", F.col("var_name"))), "derived")
    size = step.count()
    for _ in range(depth):
        more = step.withColumnRenamed("derived", "_m").join(step.select("file_path", "function", F.col("var_name").alias("_m"), "derived"), ["file_path", "function", "_m"])
        step = durable(more.select("file_path", "function", "var_name", "derived").distinct(), "derived")
        now = step.count()
        if now == size:
            break
        size = now
    return step


def trace_cross_function(var: str, caller: str, callee: str, calls: DataFrame, params: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(pos, kind, file_path, function, var_name, line): a variable from a call's argument into the callee (G14): the call_arg,
    the callee's parameter at that place (the first if the argument is no plain name), its uses there, and the call_return,
    the variable that the caller assigns the result to."""
    site = calls.where((F.col("caller") == caller) & (F.col("callee") == callee)).where(F.exists("call_args", lambda a: L.identifier_in(a, F.lit(var))))
    site = site.withColumn("_n", F.greatest(F.array_position("call_args", var) - 1, F.lit(0)))
    arg = site.select(F.lit(0).alias("pos"), F.lit("call_arg").alias("kind"), "file_path", F.lit(caller).alias("function"), F.lit(var).alias("var_name"), "line")
    entered = site.select(F.col("_n").alias("param_index")).distinct().join(params.where(F.col("function") == callee), "param_index")
    param = entered.select(F.lit(1).alias("pos"), F.lit("param").alias("kind"), "file_path", "function", F.col("name").alias("var_name"), "line")
    use = param.select("file_path", "function", "var_name").distinct().join(uses, ["file_path", "function", "var_name"]).select(F.lit(2).alias("pos"), F.lit("use").alias("kind"), "file_path", "function", "var_name", "line")
    back = site.select("file_path", "line").distinct().join(defs.where(F.col("function") == caller), ["file_path", "line"]).select(F.lit(3).alias("pos"), F.lit("call_return").alias("kind"), "file_path", "function", "var_name", "line")
    return arg.unionByName(param).unionByName(use).unionByName(back).distinct()


def name_index(functions: DataFrame) -> DataFrame:
    """(name, files): where functions of a name are defined (A9), for names in few files; ``files`` is sorted."""
    return functions.groupBy("name").agg(F.array_sort(F.collect_set("file_path")).alias("files"))


def function_blocks(blocks: DataFrame, function: str, path: str | None = None) -> DataFrame:
    """The blocks of a function by line (G15, L8); the entry block is the one of that type."""
    held = blocks.where(F.col("function") == function)
    return (held if path is None else held.where(F.col("file_path") == path)).orderBy("file_path", "start_line", "block_index")


def enclosing(found: DataFrame, functions: DataFrame, near: int = 5) -> DataFrame:
    """(id, name, start_line, end_line): the smallest function around each finding's sink, or the lines around it where it is in
    none (J18). found: id, file_path, line."""
    from flowspar.operators.match import in_span

    spans = functions.select("file_path", "name", "start_line", "end_line").distinct()
    held = in_span(found.select("id", "file_path", "line"), spans, ["file_path"], "line", "start_line", "end_line", 32)
    order = Window.partitionBy("id").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "name")
    best = held.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("id", "name", "start_line", "end_line")
    rows = found.select("id", "line").join(best, "id", "left")
    return rows.select("id", "name", F.coalesce("start_line", F.greatest(F.lit(1), F.col("line") - near)).alias("start_line"), F.coalesce("end_line", F.col("line") + near).alias("end_line"))
