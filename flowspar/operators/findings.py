"""From labelled nodes and paths to findings: caps, dedup, merging, gates, sanitizers, chains, links and summaries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspar import schema as S
from flowspar.operators import label as L
from flowspar.operators.match import exact_or_first, first_by, ratio
from flowspar.sources.durable import durable, small


def mapped(values: dict, key: str | Column, default: Column) -> Column:
    """A constant dictionary as an expression."""
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(sorted(values.items())))), k), default)


def severity(category: str | Column, overrides: dict[str, str] | None = None) -> Column:
    return mapped(S.SEVERITY | (overrides or {}), category, F.lit("medium"))


def severity_rank(level: str | Column) -> Column:
    return mapped(S.RANK, level, F.lit(0))


def capped(df: DataFrame, category: str, order: list, cap: int = S.PER_CATEGORY) -> DataFrame:
    """The first ``cap`` rows of each category."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def truncated(df: DataFrame, category: str, cap: int = S.PER_CATEGORY) -> DataFrame:
    """(category, truncated): how many rows a cap leaves out, where it does."""
    return df.groupBy(category).agg((F.count("*") - cap).alias("truncated")).where("truncated > 0")


def merge_categories(df: DataFrame, keys: list[str], category: str = "category", pattern_length: str = "pattern_length") -> DataFrame:
    """One row for each place: the category of highest severity (then longest pattern, then name), the others related."""
    order = [F.desc(severity_rank(severity(category))), F.desc(pattern_length), category]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rest = F.array_sort(F.collect_set(F.when(F.col("_n") > 1, F.col(category))))
    main = F.max(F.when(F.col("_n") == 1, F.col(category)))
    return ranked.groupBy(*keys).agg(main.alias("main"), rest.alias("_rest")).withColumn("related", F.filter("_rest", lambda x: x != F.col("main"))).drop("_rest")


def suppress_aliases(patterns: DataFrame, taints: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """Pattern findings without those that a taint finding of the same place and (alias of the) category covers."""
    plain = lambda df: df.withColumn("_c", mapped(S.ALIASES, category, F.col(category)))
    return plain(patterns).join(plain(taints).select(*keys, "_c").distinct(), [*keys, "_c"], "left_anti").drop("_c")


def position_gate(category: Column, args: Column, variable: Column) -> Column:
    """False where the category only minds the first argument and the variable is a later one (alone or as x.variable).
    Unknown places pass."""
    place = F.array_position(F.transform(args, lambda a: (a == variable) | a.endswith(F.concat(F.lit("."), variable))), True)
    return ~(category.isin(*sorted(S.POSITION_GATED)) & F.coalesce(place > 1, F.lit(False)))


def steps(paths: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each node of paths(keys, path, etypes): its place, its edge type (the last repeats the one before), and
    the node's columns; prev_var is the variable of the node before."""
    on = paths.select(*keys, "etypes", F.posexplode("path").alias("pos", "node_id"))
    n = F.size("etypes")
    edge = F.when(n == 0, F.lit(None)).otherwise(F.try_element_at("etypes", F.least(F.col("pos") + 1, n)))
    held = on.withColumn("edge_type", edge).drop("etypes").join(nodes, "node_id")
    return held.withColumn("prev_var", F.lag("var_name").over(Window.partitionBy(*keys).orderBy("pos")))


def sanitizers(chain_steps: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sanitizers): categories of sanitizers on a path. Only statements count; a call whose arguments are known must
    have the variable before among them."""
    stated = chain_steps.where(F.col("node_type").isin("assignment", "call_site"))
    known = (F.col("node_type") == "call_site") & F.col("prev_var").isNotNull() & (F.size(F.coalesce("call_args", F.array())) > 0)
    through = F.exists("call_args", lambda a: L.identifier_in(a, F.col("prev_var")))
    used = stated.where(~known | F.coalesce(through, F.lit(True)))
    hits = L.with_matches(used, rules, "sanitizers").where("size(_m) > 0").select(*keys, F.explode(L.category_set()).alias("category"))
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("sanitizers"))


def build(paths: DataFrame, nodes: DataFrame, rules: DataFrame, cap: int = S.PER_CATEGORY, overrides: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of taint paths, and truncated counts by category.

    paths as from ``search.taint_paths``; nodes labelled. Each category of the sink gives a candidate; generic ones go
    where there are specific ones; the position gate, distinct places and the cap follow; then categories merge."""
    mini = nodes.select("node_id", "file_path", "line", "function", "text", "var_name", "call_args", "taint_source", "taint_sink", "node_type")
    side = lambda p: mini.select(*(F.col(c).alias(f"{p}_{c}") for c in mini.columns))
    before = F.try_element_at("path", F.lit(-2))
    rows = paths.withColumn("before", before).join(side("source"), F.col("source") == F.col("source_node_id")).join(side("sink"), F.col("sink") == F.col("sink_node_id"))
    rows = rows.join(mini.select(F.col("node_id").alias("before"), F.col("var_name").alias("tainted")), "before", "left")
    rows = rows.withColumn("category", F.explode(L.without_generic("sink_taint_sink")))
    rows = rows.where(position_gate(F.col("category"), F.coalesce("sink_call_args", F.array().cast("array<string>")), F.coalesce("tainted", F.lit(""))))
    place = ["source_file_path", "source_line", "sink_file_path", "sink_line"]
    one = first_by(rows, ["category", *place], ["source", "event", "sink"])
    one = durable(one, "candidates")  # the cap and its count both read them
    cut = truncated(one, "category", cap)
    kept = capped(one, "category", ["source", "event", "sink"], cap)
    own = F.filter("_m", lambda r: r["category"] == F.col("category"))
    length = F.coalesce(F.array_max(F.transform(own, lambda r: F.length(r["pattern"]))), F.lit(0))
    kept = durable(L.with_matches(kept, rules, "sinks", "sink_text").withColumn("pattern_length", length).drop("_m"), "kept")
    merged = merge_categories(kept, place)
    on = kept.join(merged, place).where(F.col("category") == F.col("main"))
    clean = sanitizers(steps(on, mini, ["source", "sink", "nth"]), rules, ["source", "sink", "nth"])
    out = on.join(clean, ["source", "sink", "nth"], "left").withColumn("sanitizers", F.coalesce("sanitizers", F.array().cast("array<string>")))
    ref = lambda p, c: F.struct(F.col(f"{p}_file_path").alias("file_path"), F.col(f"{p}_line").alias("line"), F.col(f"{p}_function").alias("function"), F.col(f"{p}_text").alias("code"), c.alias("category"))
    found = out.select(
        F.sha2(F.concat_ws("|", "category", *place), 256).substr(1, 16).alias("id"), F.col("category").alias("vuln_type"), severity("category", overrides).alias("severity"),
        ref("source", F.array_join("source_taint_source", ",")).alias("source"), ref("sink", F.col("category")).alias("sink"), "path", "etypes",
        "sanitizers", (F.size("sanitizers") > 0).alias("sanitized"), F.col("related").alias("related_categories"), F.lit(False).alias("is_pattern"),
    )
    return found, cut


def pattern_findings(nodes: DataFrame, rules: DataFrame, taints: DataFrame, cap: int = S.PER_CATEGORY, overrides: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings that need no source: nodes labelled with a pattern category, unless a taint finding covers the place; and
    how many of each category the cap leaves out."""
    wanted = rules.where("section = 'pattern_sinks'").select(F.col("pattern").alias("category")).distinct()
    rows = nodes.withColumn("category", F.explode("taint_sink")).join(F.broadcast(wanted) if small(wanted, L.RULES_SENT) else wanted, "category", "left_semi")
    rows = first_by(rows, ["category", "file_path", "line"], ["node_id"])
    covered = taints.select(F.col("sink.file_path").alias("file_path"), F.col("sink.line").alias("line"), F.explode(F.concat(F.array("vuln_type"), "related_categories")).alias("category"))
    open_rows = durable(suppress_aliases(rows, covered, ["file_path", "line"]), "patterns")
    rows, cut = capped(open_rows, "category", ["file_path", "line", "node_id"], cap), truncated(open_rows, "category", cap)
    ref = F.struct("file_path", "line", "function", F.col("text").alias("code"), "category")
    empty = F.array().cast("array<string>")
    found = rows.select(
        F.sha2(F.concat_ws("|", F.lit("pattern"), "category", "file_path", "line"), 256).substr(1, 16).alias("id"), F.col("category").alias("vuln_type"), severity("category", overrides).alias("severity"),
        ref.alias("source"), ref.alias("sink"), F.array("node_id").alias("path"), F.array(F.lit(S.PATTERN)).alias("etypes"), empty.alias("sanitizers"), F.lit(False).alias("sanitized"), empty.alias("related_categories"), F.lit(True).alias("is_pattern"),
    )
    return found, cut


def chains(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, call_chain): the steps of each finding."""
    rows = steps(found.select("id", "path", "etypes"), nodes, ["id"])
    step = F.struct("pos", "file_path", "line", "function", F.col("text").alias("code"), F.col("node_type").alias("kind"), "edge_type")
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: F.struct(*(s[c].alias(c) for c in ("file_path", "line", "function", "code", "kind", "edge_type")))).alias("call_chain"))


def link_endpoints(found: DataFrame, endpoints: DataFrame) -> DataFrame:
    """found with endpoint: the first (by line, route) whose handler holds the source, else the first of its file, else
    match = 'none'."""
    columns = ["route", "methods", "handler", "file_path", "line", "framework", "params"]
    right = endpoints.select(F.col("file_path").alias("_path"), F.col("handler").alias("_fn"), F.struct(*columns).alias("_e"), F.col("line").alias("_l"), F.col("route").alias("_r"))
    left = found.withColumn("_path", F.col("source.file_path")).withColumn("_fn", F.col("source.function"))
    rows = exact_or_first(left, right, ["id"], ["_path", "_fn"], ["_path"], ["_l", "_r"], ["_e"])
    kind = F.when(F.col("match") == "group", "file").otherwise(F.col("match"))
    return rows.withColumn("endpoint", F.struct(kind.alias("match"), *(F.col(f"_e.{c}").alias(c) for c in columns))).drop("_e", "_path", "_fn", "match")


def elements(nodes: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each labelled node and category (T8): kind, category, place, code, the rules' patterns found in it, and
    whether a finding begins (sources) or ends (sinks) at that place. A source is no sink."""
    rows = nodes.where("(taint_source is not null or taint_sink is not null) and file_path is not null and line > 0").withColumn("kind", F.when(F.col("taint_source").isNotNull(), "source").otherwise("sink"))
    rows = L.with_matches(L.with_matches(rows, rules, "sources", into="_a"), rules, "sinks", into="_b")
    rows = rows.withColumn("category", F.explode(F.coalesce("taint_source", "taint_sink")))
    own = F.filter(F.when(F.col("kind") == "source", F.col("_a")).otherwise(F.col("_b")), lambda r: r["category"] == F.col("category"))
    side = lambda k: found.select(F.lit(k).alias("kind"), F.col(f"{k}.file_path").alias("file_path"), F.col(f"{k}.line").alias("line"))
    places = side("source").unionByName(side("sink")).distinct().withColumn("covered", F.lit(True))
    rows = rows.select("kind", "category", "file_path", "line", "function", F.col("text").alias("code"), "node_type", F.transform(own, lambda r: r["pattern"]).alias("patterns"))
    return rows.join(places, ["kind", "file_path", "line"], "left").withColumn("covered", F.coalesce("covered", F.lit(False))).orderBy("kind", "category", "file_path", "line", "code")


def canonical(found: DataFrame, linked: DataFrame, call_chains: DataFrame) -> DataFrame:
    """Rendered findings: title, severity, endpoint, places, and the chain of functions with equal neighbours folded."""
    ends = linked.select("id", F.when(F.col("endpoint.match") == "none", "unmatched").otherwise(F.concat_ws(" ", F.array_join("endpoint.methods", ","), "endpoint.route")).alias("endpoint_text"))
    label = lambda s: F.concat(s["function"], F.lit(" ("), s["file_path"], F.lit(":"), s["line"].cast("string"), F.lit(")"))
    pieces = call_chains.select("id", F.expr("filter(call_chain, (s, i) -> i = 0 or not (s.function <=> call_chain[i - 1].function))").alias("c"))
    text = pieces.select("id", F.array_join(F.transform("c", label), " > ").alias("chain"))
    place = lambda c: F.format_string("%s:%d", F.col(f"{c}.file_path"), F.col(f"{c}.line"))
    return found.join(ends, "id", "left").join(text, "id", "left").select("id", mapped(S.TITLES, "vuln_type", F.col("vuln_type")).alias("title"), "severity", "endpoint_text", place("source").alias("source"), place("sink").alias("sink"), F.concat(F.lit("▶ "), "sink.code").alias("sink_code"), "chain", "sanitized")


def coverage(nodes: DataFrame, endpoints: DataFrame, found: DataFrame) -> DataFrame:
    """One row: endpoints with a source, labelled sinks that findings cover, and their ratios."""
    sourceful = nodes.where("taint_source is not null").select("file_path", F.col("function").alias("handler")).distinct().withColumn("_s", F.lit(True))
    e = endpoints.join(sourceful, ["file_path", "handler"], "left").agg(F.count("*").alias("endpoints"), F.count("_s").alias("endpoints_with_source"))
    hit = found.select(F.col("sink.file_path").alias("file_path"), F.col("sink.line").alias("line")).distinct().withColumn("_f", F.lit(True))
    s = nodes.where("taint_sink is not null").join(hit, ["file_path", "line"], "left").agg(F.count("*").alias("sinks"), F.count("_f").alias("sinks_covered"))
    return e.crossJoin(s).withColumn("endpoint_coverage", ratio(F.col("endpoints_with_source"), F.col("endpoints"))).withColumn("sink_coverage", ratio(F.col("sinks_covered"), F.col("sinks")))


def exposed_without_source(endpoints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints whose handler has no labelled source: (method_list, route, handler, file_path, line)."""
    sourceful = nodes.where("taint_source is not null").select("file_path", F.col("function").alias("handler")).distinct()
    bare = endpoints.join(sourceful, ["file_path", "handler"], "left_anti")
    return bare.select(F.when(F.size("methods") > 0, F.array_join("methods", ",")).otherwise("ANY").alias("method_list"), "route", "handler", "file_path", "line")


def summary(files: int, functions: DataFrame, nodes: DataFrame, endpoints: DataFrame, found: DataFrame, blind: DataFrame) -> DataFrame:
    """One row of counts."""
    n = nodes.agg(F.count_if(F.col("taint_source").isNotNull()).alias("sources"), F.count_if(F.col("taint_sink").isNotNull()).alias("sinks"), F.count("*").alias("nodes"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return n.withColumn("files", F.lit(files)).crossJoin(count(functions, "functions")).crossJoin(count(endpoints, "endpoints")).crossJoin(count(found, "findings")).crossJoin(count(blind, "blind_spots"))
