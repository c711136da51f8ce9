"""Labelling of nodes by a rule table: substring theta-joins, longest matches, exclusions and priorities.

rules(section, category, pattern, ord): section is sources, sinks, sanitizers, sink_excludes or pattern_sinks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspar.sources.durable import small

RULES_SENT, EXPRESSIONS_SENT = 50_000, 2_000
_RULE = "array<struct<category:string,pattern:string,ord:int>>"


def _wanted(rules: DataFrame, section: str) -> DataFrame:
    held = rules.where((F.col("section") == section) & (F.length("pattern") > 0))
    return held.select("category", "pattern", F.col("ord").cast("int").alias("ord")).distinct()


def with_matches(df: DataFrame, rules: DataFrame, section: str, text: str = "text", into: str = "_m") -> DataFrame:
    """df with an array of the rules of a section (category, pattern, ord) whose pattern is in the text (case counts);
    empty patterns and null texts match nothing.

    A rule table of at most RULES_SENT rows becomes a constant and each row is matched where it is. A larger one is joined
    with the different texts, and its matches come back by a digest of the text."""
    wanted = _wanted(rules, section)
    if small(wanted, RULES_SENT):
        held = [r.asDict() for r in wanted.orderBy("category", "ord", "pattern").collect()]
        every = F.from_json(F.lit(json.dumps(held)), _RULE)
        found = F.filter(every, lambda r: F.contains(F.col(text), r["pattern"]))
        return df.withColumn(into, F.when(F.col(text).isNotNull(), found).otherwise(F.array().cast(_RULE)))
    key = F.sha2(text, 256)
    texts = df.select(key.alias("_key"), F.col(text).alias("_text")).where("_text is not null").groupBy("_key").agg(F.min("_text").alias("_text"))
    hits = texts.join(wanted, F.contains("_text", "pattern")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("category", "pattern", "ord"))).alias(into))
    back = df.withColumn("_key", key).join(hits, "_key", "left").drop("_key")
    return back.withColumn(into, F.coalesce(into, F.array().cast(_RULE)))


def category_set(matches: str | Column = "_m") -> Column:
    """The sorted set of the categories of an array of matches."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda r: r["category"])))


def longest(matches: str | Column = "_m") -> Column:
    """The match with the longest pattern; ties go to the first category, then to the first rule."""
    order = F.array_min(F.transform(matches, lambda r: F.struct((-F.length(r["pattern"])).alias("l"), r["category"].alias("category"), r["ord"].alias("ord"), r["pattern"].alias("pattern"))))
    return F.struct(order["category"].alias("category"), order["pattern"].alias("pattern"))


def with_excluded(df: DataFrame, rules: DataFrame, text: str = "text", into: str = "_out") -> DataFrame:
    """df with whether one of the sink_excludes expressions is found in the text."""
    wanted = rules.where("section = 'sink_excludes' and length(pattern) > 0").select("pattern").distinct()
    if small(wanted, EXPRESSIONS_SENT):
        found = F.lit(False)
        for r in wanted.orderBy("pattern").collect():
            found = found | F.rlike(F.col(text), F.lit(r["pattern"]))
        return df.withColumn(into, F.coalesce(found, F.lit(False)))
    key = F.sha2(text, 256)
    texts = df.select(key.alias("_key"), F.col(text).alias("_text")).where("_text is not null").groupBy("_key").agg(F.min("_text").alias("_text"))
    hits = texts.join(wanted, F.rlike("_text", "pattern"), "left_semi").select("_key", F.lit(True).alias(into))
    return df.withColumn("_key", key).join(hits, "_key", "left").drop("_key").withColumn(into, F.coalesce(into, F.lit(False)))


def label_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes with taint_source and taint_sink (array<string>): a text with a source is no sink; an excluded text is no
    sink; parameters keep only the source class of their own declaration."""
    none = F.lit(None).cast("array<string>")
    some = lambda c: F.when(F.size(c) > 0, category_set(c))
    applies = F.col("node_type").isin("assignment", "call_site")
    held = with_excluded(with_matches(with_matches(nodes, rules, "sources", into="_src"), rules, "sinks", into="_snk"), rules)
    source = F.when(applies, some("_src")).when(F.col("node_type") == "parameter", parameter_source("text")).otherwise(none)
    sink = F.when(applies & F.col("taint_source").isNull() & ~F.col("_out"), some("_snk")).otherwise(none)
    return held.withColumn("taint_source", source).withColumn("taint_sink", sink).drop("_src", "_snk", "_out")


_ANNOTATED = {
    "injection_general": "BeanParam Body CookieParam CookieValue FormParam MatrixParam ModelAttribute QueryParam QueryValue RequestBody RequestParam SessionAttribute",
    "path_traversal": "PathParam PathVariable",
    "header_injection": "HeaderParam RequestHeader",
    "deserialization": "RequestPart",
}


def parameter_source(declaration: str | Column) -> Column:
    """The source classes of a parameter by the annotations in its own declaration; raw request types are general."""
    text = F.col(declaration) if isinstance(declaration, str) else declaration
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"@(?:\w+\.)*(\w+)"), F.lit(1)))
    per = [F.when(F.arrays_overlap(found, F.array(*map(F.lit, names.split()))), F.lit(c)) for c, names in _ANNOTATED.items()]
    have = F.array_sort(F.array_compact(F.array(*per)))
    raw = text.rlike(r"\b(?:Http)?ServletRequest\b")
    return F.when(F.size(have) > 0, have).when(raw, F.array(F.lit("injection_general")))


def identifier_in(text: str | Column, name: str | Column) -> Column:
    """Whether name stands in text as a whole identifier (letters, digits, _ and $ go on with an identifier)."""
    t, n = (F.col(x) if isinstance(x, str) else x for x in (text, name))
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), n, F.lit(r"\E(?![A-Za-z0-9_$])"))
    return F.contains(t, n) & F.rlike(t, quoted)


_WRITERS = "add addAll addFirst addLast append enqueue insert merge offer prepend push put putAll putAttribute putFirst putIfAbsent putLast setAttribute setProperty store".split()


def container_write(text: str | Column) -> Column:
    """The host variable if the text begins with a call that writes into a container (host.put(...)), else null."""
    t = F.col(text) if isinstance(text, str) else text
    host, method = F.regexp_extract(t, r"^\s*([A-Za-z_$][\w$]*)\.(\w+)\s*\(", 1), F.regexp_extract(t, r"^\s*([A-Za-z_$][\w$]*)\.(\w+)\s*\(", 2)
    return F.when((host != "") & (method.isin(_WRITERS) | method.rlike("^(set|add|put)[A-Z]")), host)


def last_call(text: str | Column) -> Column:
    """The last method of a call chain: a.b().c() gives c."""
    return F.try_element_at(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)), F.lit(-1))


def without_generic(labels: str | Column) -> Column:
    """An array of categories without the generic one, unless that is all there is."""
    a = F.col(labels) if isinstance(labels, str) else labels
    specific = F.filter(a, lambda x: x != "injection_general")
    return F.when(F.size(specific) > 0, specific).otherwise(a)


def taint_nodes(nodes: DataFrame, rules: DataFrame, pattern: str, role: str | None = None, skip: tuple[str, ...] = ("function",), limit: int = 200) -> DataFrame:
    """(node_id): labelled nodes of the category that ``pattern`` names, or whose longest source or sink rule is in it.

    With a role ('source', 'sink') only that label counts, and with a category there is no fallback. Where no category is
    found, or without a role no node, the pattern is searched in the nodes' texts and names. By id, at most ``limit``."""
    one = with_matches(with_matches(nodes.sparkSession.createDataFrame([(pattern,)], "text string"), rules, "sources", into="_a"), rules, "sinks", into="_b")
    named = not rules.where((F.col("category") == pattern) & F.col("section").isin("sources", "sinks", "sanitizers")).isEmpty()
    row = one.select(longest("_a")["category"].alias("a"), longest("_b")["category"].alias("b")).first()
    category = pattern if named else row["a"] or row["b"]
    if category is not None:
        sides = {"source": ["taint_source"], "sink": ["taint_sink"]}.get(role, ["taint_source", "taint_sink"])
        hit = F.lit(False)
        for c in sides:
            hit = hit | F.coalesce(F.array_contains(c, category), F.lit(False))
        found = nodes.where(hit & ~F.col("node_type").isin(*skip)).select("node_id").orderBy("node_id").limit(limit)
        if role is not None or not found.isEmpty():
            return found
    return search_nodes(nodes, pattern, ["text", "name", "var_name"], skip, limit).select("node_id")


def search_nodes(nodes: DataFrame, pattern: str, columns: list[str], skip: tuple[str, ...] = (), limit: int = 200) -> DataFrame:
    """Nodes with the pattern in any of the columns, by id, at most ``limit``."""
    held = F.exists(F.array(*columns), lambda x: F.coalesce(F.contains(x, F.lit(pattern)), F.lit(False)))
    return nodes.where(F.coalesce(held, F.lit(False)) & ~F.col("node_type").isin(*skip) if skip else F.coalesce(held, F.lit(False))).orderBy("node_id").limit(limit)
