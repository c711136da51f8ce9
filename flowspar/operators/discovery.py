"""Heuristic sinks, scorers and comparison of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspar.operators import label as L
from flowspar.operators.search import trace

KEYWORDS = "cmd connect decode deseriali dump eval exec execute fetch include load open parse pipeline popen process query read redirect render request require run send socket sql system template write".split()
_MODULES = "os.=25 subprocess.=25 shlex.=15 pickle.=25 marshal.=20 yaml.=15 eval=30 exec=30 Runtime.=25 ProcessBuilder=25 ScriptEngine=20 ObjectInputStream=20 XMLReader=15 SAXParser=15 DOMParser=15 vm.=20 child_process=25 Function(=30"
MODULES = [(m, int(w)) for m, w in (p.rsplit("=", 1) for p in _MODULES.split())]
MARKERS = "execute query eval exec system popen read write open( process send load dump parse redirect render run(".split()
HTTP = ".args .form .query .param .body .cookies .headers @request @pathvar request. req.".split()
JOINED = ("+", "%", ".format(", "${", 'f"', "f'")
DANGEROUS, REPORTED = 40, 60


def has_any(text: Column, parts) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def heuristic_score(text: str | Column, from_source: Column | None = None, known_sink: Column | None = None) -> Column:
    """0 to 100: 20 for concatenation, 8 a keyword up to 30, the first module's weight (in any case of letters), 25 if a
    source reaches it, 15 if it looks like a known sink."""
    t = F.col(text) if isinstance(text, str) else text
    low = F.lower(t)
    words = F.size(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(low, k)))
    module = F.coalesce(*(F.when(F.contains(low, F.lit(m.lower())), w) for m, w in MODULES), F.lit(0))
    yes = lambda c, n: F.when(c, n).otherwise(0) if c is not None else F.lit(0)
    total = yes(has_any(t, JOINED), 20) + F.least(F.lit(30), words * 8) + module + yes(from_source, 25) + yes(known_sink, 15)
    return F.least(F.lit(100), total)


def suspicious(nodes: DataFrame) -> DataFrame:
    """Unlabelled assignments that call something and hold one of the markers."""
    return nodes.where("node_type = 'assignment' and taint_source is null and taint_sink is null and contains(text, '(')").where(has_any(F.lower("text"), MARKERS))


def sink_candidates(nodes: DataFrame) -> DataFrame:
    """Assignments that call something, labelled ones first: (file_path, line, function, code, labelled)."""
    rows = nodes.where("node_type = 'assignment' and contains(text, '(')").select("file_path", "line", "function", F.substring("text", 1, 120).alias("code"), F.col("taint_sink").isNotNull().alias("labelled"))
    return rows.orderBy(F.desc("labelled"), "file_path", "line")


def fed_by_http(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id): nodes that a labelled assignment with HTTP ancestry leads to (G11). Ancestry: an assignment whose text
    holds an HTTP marker lies within six edges before it; the node lies within 21 edges behind. The edge next to the marker,
    and the one next to the labelled assignment, may be of any type; the others are data flow or calls."""
    assigned = nodes.where("node_type = 'assignment'")
    step = edges.select(F.col("src").alias("node_id"), "dst").distinct()
    behind = lambda df: df.join(step, "node_id").select(F.col("dst").alias("node_id")).distinct()
    marked = assigned.where(has_any(F.lower("text"), HTTP)).select("node_id")
    with_ancestry = trace(behind(marked), edges, 5).select("node_id")
    labelled = assigned.where("taint_source is not null or taint_sink is not null").select("node_id").join(with_ancestry, "node_id", "left_semi")
    return trace(behind(labelled), edges, 20).select("node_id")


def heuristic_sinks(nodes: DataFrame, edges: DataFrame, rules: DataFrame, threshold: int = REPORTED) -> DataFrame:
    """Unlabelled assignments by heuristic score: (node_id, file_path, line, score), highest first. A text looks like a known
    sink if, in lower case, it holds a sink pattern."""
    fed = fed_by_http(nodes, edges).withColumn("_fed", F.lit(True))
    rows = suspicious(nodes).join(fed, "node_id", "left").withColumn("_low", F.lower("text"))
    rows = L.with_matches(rows, rules, "sinks", "_low")
    rows = rows.withColumn("score", heuristic_score("text", F.col("_fed").isNotNull(), F.size("_m") > 0))
    return rows.where(F.col("score") >= threshold).select("node_id", "file_path", "line", "score").orderBy(F.desc("score"), "node_id")


def uncovered_sinks(nodes: DataFrame) -> DataFrame:
    """Unlabelled assignments that call something (P18): (file_path, line, function, code, reason)."""
    rows = nodes.where("node_type = 'assignment' and taint_source is null and taint_sink is null and contains(text, '(') and file_path <> ''")
    return rows.select("file_path", "line", "function", F.substring("text", 1, 120).alias("code"), F.lit("no_known_rule").alias("reason"))


def labelled_sinks(nodes: DataFrame) -> DataFrame:
    """Labelled assignments."""
    return nodes.where("node_type = 'assignment' and (taint_source is not null or taint_sink is not null)")


ROUTES = "@app.route @app.get @app.post @app.put @app.delete @app.patch @blueprint.route @router.get @router.post app.get( app.post( app.put( app.delete( router.get( router.post( @GetMapping @PostMapping @PutMapping @DeleteMapping @RequestMapping".split()


def routes_without_source(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, name, start_line): functions that look like route handlers by their text or decorators, without a labelled
    assignment inside (J22). functions: file_path, name, start_line, source, decorators."""
    text = F.concat_ws("\n", F.array_join(F.coalesce("decorators", F.array().cast("array<string>")), "\n"), F.coalesce("source", F.lit("")))
    inside = labelled_sinks(nodes).select("file_path", F.col("function").alias("name")).distinct()
    return functions.where(has_any(text, ROUTES)).join(inside, ["file_path", "name"], "left_anti").select("file_path", "name", "start_line")


def confusion(df: DataFrame, category: str, truth: str, found: str) -> DataFrame:
    """tp, fn, fp, tn, and rates in per cent for each category and in total (category 'total')."""
    t, f = F.col(truth), F.col(found)
    cells = [F.count_if(t & f).alias("tp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn")]
    rows = df.rollup(category).agg(*cells, F.grouping(category).alias("_g")).withColumn(category, F.when(F.col("_g") == 1, "total").otherwise(F.col(category))).drop("_g")
    pct = lambda a, b: F.when(F.col(a) + F.col(b) == 0, F.lit(0.0)).otherwise(F.round(F.col(a) * 100.0 / (F.col(a) + F.col(b)), 1))
    return rows.withColumn("tpr", pct("tp", "fn")).withColumn("fpr", pct("fp", "tn"))


def fingerprint(found: DataFrame) -> DataFrame:
    """What two reports are compared by: type, and file name and line of source and sink."""
    base = lambda c: F.substring_index(F.col(f"{c}.file_path"), "/", -1)
    return found.select("vuln_type", base("source").alias("source_file"), F.col("source.line").alias("source_line"), base("sink").alias("sink_file"), F.col("sink.line").alias("sink_line")).distinct()
