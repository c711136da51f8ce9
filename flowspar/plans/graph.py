"""The property graph of fact tables: nodes and edges, every edge kind by one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspar import schema as S
from flowspar.operators import label as L
from flowspar.operators.match import in_span, last_wins
from flowspar.plans import resolve
from flowspar.sources.durable import durable
from flowspar.sources.facts import FactTables

_NODE_COLUMNS = [c.strip().split(" ")[0] for c in S.NODES.split(", ")]
_LINES = 32  # width of the narrowest line bucket


def _id(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def _nodes(df: DataFrame, **values: Column | str) -> DataFrame:
    """df as node rows; columns that aren't given are null."""
    kinds = dict(c.strip().split(" ", 1) for c in S.NODES.split(", "))
    out = [(F.col(values[c]) if isinstance(values.get(c), str) else values[c] if c in values else F.lit(None)).cast(kinds[c]).alias(c) for c in _NODE_COLUMNS]
    return df.select(*out, F.col("language"), F.col("seq").alias("_seq"))


def reference_chains(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(file_path, function, var_name, def_line, use_line, before): every use of a definition, and the line of the use
    before it (null for the first), by line (F14, W3). A use on the definition's own line counts only in an enhanced for."""
    d = defs.select("file_path", "function", "fn_line", "var_name", F.col("line").alias("def_line"), "enhanced_for").distinct()
    pairs = d.join(uses.select("file_path", "function", "fn_line", "var_name", F.col("line").alias("use_line")), ["file_path", "function", "fn_line", "var_name"]).where("use_line <> def_line or enhanced_for")
    order = Window.partitionBy("file_path", "function", "fn_line", "var_name", "def_line").orderBy("use_line")
    return pairs.drop("enhanced_for").distinct().withColumn("before", F.lag("use_line").over(order))


def call_sites(calls: DataFrame) -> DataFrame:
    """calls with call_id; of calls with equal ids the last one counts."""
    named = calls.withColumn("call_id", _id("call_site", "file_path", F.col("line").cast("string"), "caller", "callee"))
    return last_wins(named, ["call_id"], [c for c in calls.columns if c != "seq"], ["seq"])


def argument_edges(refs: DataFrame, params: DataFrame, sites: DataFrame, targets: DataFrame) -> DataFrame:
    """(call_id, src, dst, confidence): arguments to parameters (J13) by equal names (high), else by position (medium), and
    only where a call has neither, all to all (low).

    refs(node_id, file_path, function, line, var_name); params(node_id, file_path, function, var_name, param_index);
    sites(call_id, file_path, caller, callee, line, call_args); targets(call_id, target_file)."""
    args = sites.join(refs.select("file_path", F.col("function").alias("caller"), "line", F.col("node_id").alias("src"), F.col("var_name").alias("_arg")), ["file_path", "caller", "line"])
    formal = params.select(F.col("file_path").alias("target_file"), F.col("function").alias("callee"), F.col("node_id").alias("dst"), F.col("var_name").alias("_param"), "param_index")
    pairs = args.select("call_id", "callee", "call_args", "src", "_arg").join(targets, "call_id").join(formal, ["target_file", "callee"])
    by_call = Window.partitionBy("call_id")
    pairs = pairs.withColumn("_high", F.col("_arg") == F.col("_param")).withColumn("_named", F.max("_high").over(Window.partitionBy("call_id", "_arg")))
    place = F.coalesce(F.try_element_at("call_args", F.col("param_index") + 1) == F.col("_arg"), F.lit(False))
    fits = F.size("call_args") <= F.max("param_index").over(by_call) + 1
    pairs = pairs.withColumn("_medium", ~F.col("_named") & place & F.coalesce(fits, F.lit(False)))
    pairs = pairs.withColumn("_any", F.max(F.col("_high") | F.col("_medium")).over(by_call)).where("_high or _medium or not _any")
    level = F.when(F.col("_high"), "high").when(F.col("_medium"), "medium").otherwise("low")
    return pairs.select("call_id", "src", "dst", level.alias("confidence")).distinct()


def container_edges(sites: DataFrame, refs: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst): from a call that writes into a container to every reference of the container in that function (J11),
    unless a sanitizer of any category stands in the call (P7, case ignored)."""
    low = rules.where("section = 'sanitizers'").withColumn("pattern", F.lower("pattern"))
    writes = sites.withColumn("var_name", L.container_write("expression")).where("var_name is not null")
    writes = L.with_matches(writes.withColumn("_low", F.lower("expression")), low, "sanitizers", "_low").where("size(_m) = 0")
    hosts = writes.select("file_path", F.col("caller").alias("function"), "var_name", F.col("call_id").alias("src"))
    return hosts.join(refs.select("file_path", "function", "var_name", F.col("node_id").alias("dst")), ["file_path", "function", "var_name"]).select("src", "dst").distinct()


_FIELD = r"(?:this|self)\.(\w+)"


def state_edges(nodes: DataFrame, slots: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst): from an assignment to a slot (this.x, self.x, or a class's or module's own name) to what reads it in the
    same file (J12). this and self are of the class of the function; an unknown class matches any."""
    owner = functions.select("file_path", F.col("name").alias("function"), "class_name").groupBy("file_path", "function").agg(F.min("class_name").alias("scope"))
    held = nodes.where("node_type in ('assignment', 'call_site', 'variable_ref')").join(owner, ["file_path", "function"], "left")
    known = slots.select("file_path", F.regexp_replace("slot", r"^self\.", "").alias("slot")).distinct()
    head = F.regexp_extract("text", r"^\s*" + _FIELD + r"\s*[-+*/|&]?=(?!=)", 1)
    writes = held.where("node_type = 'assignment'").withColumn("slot", F.when(head != "", head).otherwise(F.col("var_name"))).join(known, ["file_path", "slot"], "left_semi").select("file_path", "slot", F.col("scope").alias("_w"), F.col("node_id").alias("src"))
    rest = F.regexp_replace("text", r"^\s*" + _FIELD + r"\s*=(?!=)", "")
    told = held.where("text is not null").select("file_path", "scope", "node_id", F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(_FIELD), F.lit(1)))).alias("slot"))
    bare = held.where("node_type = 'variable_ref'").select("file_path", "scope", "node_id", F.col("var_name").alias("slot"))
    reads = told.unionByName(bare).select("file_path", "slot", F.col("scope").alias("_r"), F.col("node_id").alias("dst")).distinct()
    return writes.join(reads, ["file_path", "slot"]).where("src <> dst and (_w is null or _r is null or _w = _r)").select("src", "dst").distinct()


def build_graph(tables: FactTables, files: DataFrame, rules: DataFrame, container_bridge: bool = False, state_bridge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files(path, ...), as written tables; nodes are not labelled yet.

    Nodes with equal ids merge, and the last one's attributes stay. Edges carry seq, the order in which a node's
    successors are taken: by kind, then by line, then by a hash of the ends, so it doesn't depend on partitioning."""
    functions, params, defs, uses = tables.functions(), tables.params(), tables.defs(), tables.uses()
    line = lambda c: F.col(c).cast("string")
    fn = functions.withColumn("node_id", _id("function", "file_path", "name"))
    pm = params.withColumn("node_id", _id("parameter", "file_path", "function", "name"))
    df = defs.withColumn("node_id", _id("assignment", "file_path", line("line"), "var_name"))
    sites = durable(call_sites(tables.calls()), "call_sites")
    resolved = durable(resolve.resolve_imports(resolve.virtual_imports(tables.imports(), tables.field_types(), functions), files), "imports")
    targets = durable(resolve.resolve_calls(sites, functions, resolved), "targets")
    met = targets.groupBy("call_id").agg(F.array_sort(F.collect_set("target_file")).alias("callee_files"))
    linked = sites.join(met, "call_id", "left").withColumn("is_resolved", F.col("callee_files").isNotNull())
    cross = F.col("is_resolved") & ~F.coalesce(F.array_contains("callee_files", F.col("file_path")), F.lit(False))
    linked = linked.withColumn("seq", F.lit(0))
    chains = durable(reference_chains(defs, uses), "chains")
    ref_id = lambda c: _id("variable_ref", "file_path", line(c), "var_name")
    spoken = functions.select("file_path", "language").distinct()
    refs_all = chains.join(spoken, "file_path").select("file_path", "language", "function", "var_name", F.col("use_line").alias("line"), F.col("fn_line").alias("seq"))
    kinds = [
        _nodes(fn, node_id="node_id", node_type=F.lit("function"), file_path="file_path", line="start_line", end_line="end_line", function="name", name="name", class_name="class_name", text="signature"),
        _nodes(pm, node_id="node_id", node_type=F.lit("parameter"), file_path="file_path", line="line", end_line="line", function="function", name="name", var_name="name", param_index="param_index", text="segment"),
        _nodes(df, node_id="node_id", node_type=F.lit("assignment"), file_path="file_path", line="line", end_line="end_line", function="function", var_name="var_name", text="text"),
        _nodes(refs_all, node_id=_id("variable_ref", "file_path", line("line"), "var_name"), node_type=F.lit("variable_ref"), file_path="file_path", line="line", end_line="line", function="function", var_name="var_name"),
        _nodes(linked, node_id="call_id", node_type=F.lit("call_site"), file_path="file_path", line="line", end_line="end_line", function="caller", name="callee", text="expression", call_args="call_args", caller="caller", callee="callee", is_resolved="is_resolved", cross_file=cross, callee_files="callee_files"),
        _nodes(tables.blocks(), node_id="block_id", node_type=F.lit("basic_block"), file_path="file_path", line="start_line", end_line="end_line", function="function", name="block_type", text=F.array_join("statements", "\n")),
    ]
    nodes = durable(last_wins(reduce(DataFrame.unionByName, kinds), ["node_id"], [c for c in [*_NODE_COLUMNS, "language"] if c != "node_id"], ["_seq"]), "nodes")

    of = lambda kind: nodes.where(F.col("node_type") == kind)
    refs = of("variable_ref").select("node_id", "file_path", "function", "line", "var_name")
    assigned = of("assignment").select(F.col("node_id").alias("dst"), "file_path", F.col("line").alias("_a"), F.col("end_line").alias("_b"), F.col("var_name").alias("_var"), "text", "function")
    called = of("call_site").select(F.col("node_id").alias("dst"), "file_path", F.col("line").alias("_a"), F.col("end_line").alias("_b"), "text")
    point = refs.select(F.col("node_id").alias("src"), "file_path", "line", "var_name")
    params_of = of("parameter").select("node_id", "file_path", "function", "var_name", "param_index")
    fn_id = lambda path, name: _id("function", path, name)
    first_target = targets.groupBy("call_id").agg(F.min("target_file").alias("target_file"))
    arguments = durable(argument_edges(refs, params_of, sites, targets), "arguments")
    passed = arguments.select("call_id").distinct()
    through = sites.join(passed, "call_id", "left_semi").join(first_target, "call_id").withColumn("callee_id", fn_id("target_file", "callee"))
    spans = in_span(point, assigned, ["file_path"], "line", "_a", "_b", _LINES).where("var_name <> _var").where((F.coalesce("text", F.lit("")) == "") | L.identifier_in("text", "var_name"))
    crossing = in_span(point, called, ["file_path"], "line", "_a", "_b", _LINES).where(L.identifier_in("text", "var_name"))
    earliest = params_of.join(of("assignment").select("file_path", "function", "var_name", F.col("node_id").alias("dst"), F.col("line").alias("_l")), ["file_path", "function", "var_name"]).groupBy("node_id").agg(F.min_by("dst", F.struct("_l", "dst")).alias("dst"))
    local = targets.join(sites.select("call_id", "file_path", "callee"), "call_id").where("target_file = file_path")
    call_fn = sites.join(functions.select("file_path", F.col("name").alias("caller")).distinct(), ["file_path", "caller"], "left_semi")
    both = lambda a, b: (a.alias("src"), b.alias("dst"))
    chain = chains.select(*both(F.when(F.col("before").isNull(), _id("assignment", "file_path", line("def_line"), "var_name")).otherwise(_id("variable_ref", "file_path", line("before"), "var_name")), ref_id("use_line")))
    data = [
        ("X1", S.DATA_FLOW, pm.select(*both(fn_id("file_path", "function"), F.col("node_id")))),
        ("X2", S.CALLS, call_fn.select(*both(fn_id("file_path", "caller"), F.col("call_id")))),
        ("X3", S.CALLS, local.select(*both(F.col("call_id"), fn_id("target_file", "callee")))),
        ("X4", S.DATA_FLOW, df.select(*both(fn_id("file_path", "function"), F.col("node_id")))),
        ("X5", S.DATA_FLOW, chain),
        ("X6", S.DATA_FLOW, spans.select("src", "dst")),
        ("X7", S.DATA_FLOW, crossing.select("src", "dst")),
        ("X9", S.DATA_FLOW, earliest.select(*both(F.col("node_id"), F.col("dst")))),
        ("X10", S.DATA_FLOW, tables.blocks().where("block_type = 'entry'").select(*both(fn_id("file_path", "function"), F.col("block_id")))),
        ("X12", S.CALLS, first_target.join(sites.select("call_id", "file_path", "callee"), "call_id").where("target_file <> file_path").select(*both(F.col("call_id"), fn_id("target_file", "callee")))),
        ("X14", S.DATA_FLOW, arguments.select("src", F.col("call_id").alias("dst")).unionByName(through.select(*both(F.col("call_id"), F.col("callee_id"))))),
        ("X15", S.DATA_FLOW, through.select("callee_id", "file_path", F.col("caller").alias("function"), "line").join(assigned.select("file_path", "function", F.col("_a").alias("line"), "dst"), ["file_path", "function", "line"]).select(*both(F.col("callee_id"), F.col("dst")))),
    ]
    if container_bridge:
        data.append(("X8", S.DATA_FLOW, container_edges(sites, refs, rules)))
    if state_bridge:
        data.append(("X16", S.DATA_FLOW, state_edges(nodes, tables.slots(), functions)))
    none = F.lit(None).cast("string")
    rows = [df_.distinct().select("src", "dst", F.lit(kind).alias("edge_type"), none.alias("ctrl_type"), none.alias("confidence"), F.lit(int(x[1:])).alias("_phase")) for x, kind, df_ in data]
    rows.append(arguments.select("src", "dst", F.lit(S.DATA_FLOW).alias("edge_type"), none.alias("ctrl_type"), "confidence", F.lit(13).alias("_phase")).distinct())
    rows.append(tables.cfg_edges().select("src", "dst", F.lit(S.CTRL_FLOW).alias("edge_type"), F.col("kind").alias("ctrl_type"), none.alias("confidence"), F.lit(11).alias("_phase")).distinct())
    every = reduce(DataFrame.unionByName, rows)
    at = F.coalesce(F.regexp_extract("dst", r":(\d+)(?::|$)", 1).try_cast("long"), F.lit(0))
    seq = F.col("_phase").cast("bigint") * (1 << 56) + F.least(at, F.lit((1 << 24) - 1)) * (1 << 32) + F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 32))
    return nodes, durable(every.select("src", "dst", "edge_type", "ctrl_type", "confidence", seq.alias("seq")), "edges")


def mark_route_parameters(nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Labelled nodes with the parameters of handlers as sources (T2, J16): those an endpoint names, or all of a handler
    of which some endpoint names none."""
    wanted = endpoints.where("handler is not null and handler <> ''").groupBy("file_path", F.col("handler").alias("function")).agg(F.array_distinct(F.flatten(F.collect_list(F.transform("params", lambda p: p["name"])))).alias("_names"), F.max(F.coalesce(F.size("params"), F.lit(0)) <= 0).alias("_all"))
    held = nodes.join(wanted, ["file_path", "function"], "left")
    hit = (F.col("node_type") == "parameter") & F.coalesce(F.col("_all") | F.array_contains("_names", F.col("var_name")), F.lit(False))
    return held.withColumn("taint_source", F.when(hit, F.array(F.lit(S.GENERIC))).otherwise(F.col("taint_source"))).drop("_names", "_all").select(*nodes.columns)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges by type."""
    n = nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


def in_file(nodes: DataFrame, node_type: str, path: str | None = None) -> DataFrame:
    """Nodes of a type, of one file if given, by place."""
    held = nodes.where(F.col("node_type") == node_type)
    return (held if path is None else held.where(F.col("file_path") == path)).orderBy("file_path", "line", "node_id")
