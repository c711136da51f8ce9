"""Queries over source code. The driver's tables hold none, so each supplier becomes a source file, and what is in it (and
so what the scan must find) follows from the supplier's key and balance: SQL says the same from the table alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspar.plans import coverage as C
from flowspar.plans import graph as B
from flowspar.plans.scan import ScanResult, scan_files
from flowspar.sources.rules import load_rules
from flowspar.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ALL = 1_000_000_000  # no category is cut


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _lines(*lines: str | Column) -> Column:
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _s(template: str) -> Column:
    """A template with the supplier's key in place of %d."""
    return F.format_string(template, *["s_suppkey"] * template.count("%d"))


def _dirty() -> Column:
    return F.col("s_acctbal") >= 3000


def python_files(spark: SparkSession, d: str) -> DataFrame:
    """A Flask handler each: the query is built from the request where the balance is 3,000 or more, by way of int() for
    every third key; even keys pass it to another function."""
    mixed = F.when(~_dirty(), '    b = "q"').when(F.col("s_suppkey") % 3 == 0, '    b = "q " + str(int(a))').otherwise('    b = "q " + a')
    even = F.col("s_suppkey") % 2 == 0
    rest = F.when(even, _lines(_s("    return run_%d(b)"), "", _s("def run_%d(sql):"), "    cur.execute(sql)", "    return sql", "")).otherwise(_lines("    cur.execute(b)", ""))
    text = _lines("from flask import Flask, request", "app = Flask(__name__)", "", _s('@app.route("/s%d/<item>", methods=["POST"])'), _s("def handle_%d(item):"), '    a = request.args.get("x")', mixed, rest)
    return read(spark, d, "supplier").select(F.format_string("n%d/s%d.py", "s_nationkey", "s_suppkey").alias("path"), text.alias("content"), F.lit("python").alias("language"))


def java_files(spark: SparkSession, d: str) -> DataFrame:
    """A Spring controller each, and five helpers in the same folder whose method all of them may reach."""
    built = F.when(_dirty(), '        String sql = "x" +\n            id;').otherwise('        String sql = "x" +\n            "y";')
    text = _lines("package shop;", "import org.springframework.web.bind.annotation.*;", "@RestController", _s("public class C%d {"), _s('    @GetMapping("/c%d")'), "    public String go(@RequestParam String id) throws Exception {", built, "        st.executeQuery(sql);", '        return Helper.pass("k", sql);', "    }", "}", "")
    main = read(spark, d, "supplier").select(_s("shop/C%d.java").alias("path"), text.alias("content"))
    helper = _lines("package shop;", F.format_string("public class H%d {", "id"), "    static String pass(String key, String cmd) {", "        Runtime.getRuntime().exec(cmd);", "        return key;", "    }", "}", "")
    more = spark.range(5).select(F.format_string("shop/H%d.java", "id").alias("path"), helper.alias("content"))
    return main.unionByName(more).withColumn("language", F.lit("java"))


def script_files(spark: SparkSession, d: str) -> DataFrame:
    """An Express handler each."""
    built = F.when(_dirty(), "  const s = `select ${q}`;").otherwise('  const s = "select 1";')
    text = _lines("const express = require('express');", "const app = express();", _s("function h%d(req, res) {"), "  const q = req.query.x;", built, "  db.query(s);", "}", _s("app.get('/j%d/:id', requireAuth, h%d);"), "")
    return read(spark, d, "supplier").select(_s("web/j%d.js").alias("path"), text.alias("content"), F.lit("javascript").alias("language"))


_held: dict[tuple, ScanResult] = {}


def scanned(spark: SparkSession, d: str, language: str) -> ScanResult:
    """The scan of a language's files; kept for the session, since several queries look at it."""
    key = (spark.sparkContext.applicationId, d, language)
    if key not in _held:
        files = {"python": python_files, "java": java_files, "javascript": script_files}[language](spark, d)
        _held[key] = scan_files(files, load_rules(spark), language, max_findings_per_category=_ALL)
    return _held[key]


def _key(path: str | Column = "file_path") -> Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


_ODD = "CASE WHEN s_suppkey % 2 = 0 THEN 11 ELSE 8 END"


@query(f"SELECT s_suppkey, 'sql_injection' AS vuln_type, 'critical' AS severity, 6 AS source_line, {_ODD} AS sink_line, s_suppkey % 3 = 0 AS sanitized, 'exact' AS match, '/s' || s_suppkey || '/<item>' AS route FROM supplier WHERE s_acctbal >= 3000")
def scan_python_findings(spark, d):
    """Python files to findings, with sanitizers and endpoints."""
    f = scanned(spark, d, "python").linked
    return f.select(_key("source.file_path").alias("s_suppkey"), "vuln_type", "severity", F.col("source.line").alias("source_line"), F.col("sink.line").alias("sink_line"), "sanitized", "endpoint.match", "endpoint.route")


@query("SELECT s_suppkey, 'sql_injection' AS vuln_type, 5 AS source_line, 9 AS sink_line, s_suppkey::VARCHAR AS target FROM supplier WHERE s_acctbal >= 3000 UNION ALL SELECT s_suppkey, 'command_injection', 5, 4, 'H' || h FROM supplier, range(5) r(h) WHERE s_acctbal >= 3000")
def scan_java_findings(spark, d):
    """Java files to findings, over several lines and files. 'Helper' means no import, so each helper of the folder
    may be reached; the tainted argument is the second, which no command injection minds."""
    f = scanned(spark, d, "java").linked
    target = F.regexp_extract("sink.file_path", r"(H?\d+)\.java$", 1)
    return f.select(_key("source.file_path").alias("s_suppkey"), "vuln_type", F.col("source.line").alias("source_line"), F.col("sink.line").alias("sink_line"), target.alias("target")).distinct()


@query("SELECT s_suppkey, 'sql_injection' AS vuln_type, 4 AS source_line, 6 AS sink_line, 'h' || s_suppkey AS function FROM supplier WHERE s_acctbal >= 3000")
def scan_javascript_findings(spark, d):
    """JavaScript files to findings, through a template string."""
    f = scanned(spark, d, "javascript").linked
    return f.select(_key("source.file_path").alias("s_suppkey"), "vuln_type", F.col("source.line").alias("source_line"), F.col("sink.line").alias("sink_line"), "sink.function")


@query("""SELECT '/s' || s_suppkey || '/<item>' AS route, 'POST' AS methods, 'handle_' || s_suppkey AS handler, 5 AS line, 'item:path' AS params, false AS auth_required, 'flask' AS framework FROM supplier
UNION ALL SELECT '/c' || s_suppkey, 'GET', 'go', 5, 'id:query', false, 'spring' FROM supplier UNION ALL SELECT '/j' || s_suppkey || '/:id', 'GET', 'h' || s_suppkey, 8, 'id:path', true, 'express' FROM supplier""")
def scan_endpoints(spark, d):
    """Endpoints of three frameworks."""
    every = None
    for language in ("python", "java", "javascript"):
        e = scanned(spark, d, language).endpoints
        one = e.select("route", F.array_join("methods", ",").alias("methods"), "handler", "line", F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["source"])), ",").alias("params"), "auth_required", "framework")
        every = one if every is None else every.unionByName(one)
    return every


@query(f"""SELECT s_suppkey, 'source' AS kind, 'injection_general' AS category, 5 AS line, 'parameter' AS node_type, false AS covered FROM supplier
UNION ALL SELECT s_suppkey, 'source', 'injection_general', 6, t, s_acctbal >= 3000 FROM supplier, (VALUES ('assignment'), ('call_site')) v(t)
UNION ALL SELECT s_suppkey, 'sink', 'sql_injection', {_ODD}, 'call_site', s_acctbal >= 3000 FROM supplier""")
def scan_elements(spark, d):
    """Labelled nodes, route parameters among them, and whether findings cover them."""
    return scanned(spark, d, "python").elements.select(_key().alias("s_suppkey"), "kind", "category", "line", "node_type", "covered")


@query("""WITH s AS (SELECT s_suppkey % 2 = 0 AS even, s_acctbal >= 3000 AS dirty, s_acctbal >= 3000 AND s_suppkey % 3 = 0 AS cast_ FROM supplier)
SELECT 'node' AS what, 'function' AS kind, sum(1 + even::INT)::BIGINT AS n FROM s UNION ALL SELECT 'node', 'parameter', sum(1 + even::INT) FROM s UNION ALL SELECT 'node', 'assignment', sum(3 + even::INT) FROM s
UNION ALL SELECT 'node', 'variable_ref', sum(dirty::INT + 1 + 2 * even::INT) FROM s UNION ALL SELECT 'node', 'call_site', sum(2 + even::INT + 2 * cast_::INT) FROM s UNION ALL SELECT 'node', 'basic_block', sum(3 * (1 + even::INT)) FROM s
UNION ALL SELECT 'edge', 'CTRL_FLOW', sum(2 * (1 + even::INT)) FROM s UNION ALL SELECT 'edge', 'CALLS', sum(2 + even::INT + even::INT + 2 * cast_::INT) FROM s""")
def scan_graph_counts(spark, d):
    """Nodes by type, control-flow edges and calls of the Python files."""
    r = scanned(spark, d, "python")
    return B.counts(r.nodes, r.edges).where("what = 'node' or kind in ('CTRL_FLOW', 'CALLS')")


@query("SELECT s_suppkey, 'h' || n AS target FROM supplier, range(5) r(n)")
def scan_call_targets(spark, d):
    """Cross-file call sites and the files that they may reach."""
    n = scanned(spark, d, "java").nodes.where("node_type = 'call_site' and cross_file")
    return n.select(_key().alias("s_suppkey"), F.explode("callee_files").alias("t")).select("s_suppkey", F.lower(F.regexp_extract("t", r"(H\d)\.java", 1)).alias("target"))


@query("""SELECT (SELECT count(*) FROM supplier) AS files, sum(1 + (s_suppkey % 2 = 0)::INT)::BIGINT AS functions, 3 * count(*) AS sources, count(*) AS sinks, count(*) AS endpoints, count(*) FILTER (s_acctbal >= 3000) AS findings, 0::BIGINT AS blind_spots FROM supplier""")
def scan_summary(spark, d):
    """The summary of a scan."""
    return scanned(spark, d, "python").summary.select("files", "functions", "sources", "sinks", "endpoints", "findings", "blind_spots")


@query(f"""SELECT s_suppkey, 'SQL injection' AS title, 'POST /s' || s_suppkey || '/<item>' AS endpoint_text, 'n' || s_nationkey || '/s' || s_suppkey || '.py:6' AS source, 'n' || s_nationkey || '/s' || s_suppkey || '.py:' || {_ODD} AS sink, CASE WHEN s_suppkey % 2 = 0 THEN '▶ cur.execute(sql)' ELSE '▶ cur.execute(b)' END AS sink_code FROM supplier WHERE s_acctbal >= 3000""")
def scan_canonical(spark, d):
    """Rendered findings."""
    c = scanned(spark, d, "python").canonical
    return c.select(_key(F.substring_index("source", ":", 1)).alias("s_suppkey"), "title", "endpoint_text", "source", "sink", "sink_code")


@query("""SELECT count(*) AS endpoints, count(*) AS endpoints_with_source, count(*) AS sinks, count(*) FILTER (s_acctbal >= 3000) AS sinks_covered, 1.0::DOUBLE AS endpoint_coverage, round(count(*) FILTER (s_acctbal >= 3000) / count(*), 3)::DOUBLE AS sink_coverage FROM supplier""")
def scan_coverage(spark, d):
    """A5: coverage of endpoints and sinks."""
    from flowspar.operators.findings import coverage

    r = scanned(spark, d, "python")
    return coverage(r.nodes, r.endpoints, r.findings)


@query("""SELECT 'endpoint_no_auth' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'structural', 22""")
def scan_blind_spots(spark, d):
    """The blind-spot manifest by kind (the kinds that the tables decide)."""
    r = scanned(spark, d, "python")
    m = C.blind_spot_manifest(r.endpoints, r.nodes, r.rules, None)  # neither kind asks what findings cover
    return m.where("kind in ('endpoint_no_auth', 'structural')").groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, 'handle_' || s_suppkey AS handler, CASE WHEN s_suppkey % 2 = 0 THEN 'run_' || s_suppkey ELSE 'handle_' || s_suppkey END AS sink_function FROM supplier WHERE s_acctbal >= 3000""")
def scan_endpoint_paths(spark, d):
    """Flows from a handler's own sources."""
    r = scanned(spark, d, "python")
    p = C.endpoint_paths(r.nodes, r.edges, r.endpoints)
    sinks = r.nodes.select(F.col("node_id").alias("sink"), F.col("function").alias("sink_function"))
    return p.join(sinks, "sink").select(_key().alias("s_suppkey"), "handler", "sink_function").distinct()


@query("""WITH v(a, b) AS (VALUES ('a', 'a'), ('b', 'b'), ('item', 'item')) SELECT s_suppkey, a AS var_name, b AS derived FROM supplier, v UNION ALL SELECT s_suppkey, 'a', 'b' FROM supplier WHERE s_acctbal >= 3000""")
def scan_return_derivation(spark, d):
    """What a variable's value flows into inside of a function."""
    r = scanned(spark, d, "python")
    out = C.return_derivation(r.tables.defs(), r.tables.functions()).where("function like 'handle%'")
    return out.select(_key().alias("s_suppkey"), "var_name", "derived")
