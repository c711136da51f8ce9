"""Scans of small source trees: what must be found, and what must not."""

import json

import pytest

from flowspar.parse import frameworks
from flowspar.parse.model import Facts
from flowspar.plans import coverage as C
from flowspar.plans import resolve as R
from flowspar.plans.scan import scan
from flowspar.sources.facts import decode, parse_text

JAVA = {
    "Shop.java": """package shop;
import org.springframework.web.bind.annotation.*;
@RestController
@RequestMapping("/api")
public class Shop {
    @GetMapping("/users")
    public String users(@RequestParam String id) throws Exception {
        return query(id);
    }
    private String query(String id) {
        String sql = "select " +
            id;
        return run(sql);
    }
    private String run(String sql) {
        st.executeQuery(
            sql);
        return sql;
    }
    @PostMapping("/run")
    public void go(@RequestParam(value = "c", required = false) String cmd) { Runtime.getRuntime().exec(cmd); }
    @GetMapping("/file/{name}")
    public void file(@PathVariable String name) {
        FileInputStream in = new FileInputStream("/data/" + name);
    }
    @GetMapping("/me")
    @PreAuthorize("user")
    public void me(@RequestParam String bio, HttpServletResponse r) {
        String safe = StringEscapeUtils.escapeHtml4(bio);
        r.getWriter().write(safe);
    }
    @GetMapping("/bound")
    public void bound(@RequestParam String q) {
        PreparedStatement ps = conn.prepareStatement("select ?");
        ps.setString(1, q);
        ps.executeQuery();
    }
    @GetMapping("/map")
    public void map(@RequestParam String p) {
        Map<String, String> m = new HashMap<>();
        m.put("k", p);
        String s = m.get("k");
        st.executeQuery(s);
    }
    @GetMapping("/second")
    public void second(@RequestParam String w) {
        jdbcTemplate.update("insert", w);
    }
    @GetMapping("/hash")
    public void hash() {
        MessageDigest d = MessageDigest.getInstance("MD5");
    }
    @GetMapping("/two")
    public void two(@RequestParam String t) {
        String first = store.logged(t);
        Runtime.getRuntime().exec(first);
    }
}
"""
}
EXTRA = "java:\n  sinks:\n    log_injection: ['.executeQuery(']\n    trust_boundary: ['.logged(']\n"

PYTHON = {
    "app.py": "from flask import Flask, request\nimport one as x\nimport two as y\nfrom pkg.deep import tool\napp = Flask(__name__)\n@app.route('/a/<int:n>', methods=['POST'])\ndef a(n):\n    q = request.args.get('q')\n    x.save(q)\n    tool(q)\n    return q\n",
    "one.py": "def save(p):\n    cur.execute(p)\n",
    "two.py": "def save(p):\n    cur.execute(p)\n",
    "pkg/deep.py": "def tool(cmd):\n    os.system(cmd)\n",
    "long.py": "def long_enough():\n    v0 = request.args\n" + "".join(f"    v{i} = v{i - 1}\n" for i in range(1, 9)) + "    cur.execute(v8)\n\ndef too_long():\n    w0 = request.args\n" + "".join(f"    w{i} = w{i - 1}\n" for i in range(1, 10)) + "    cur.execute(w9)\n",
    "broken.py": "def (:\n",
    ".hidden/x.py": "q = 1\n",
    "latin.py": b"# \xe9\ndef latin():\n    return 1\n",
    "urls.py": "from django.urls import path\nimport views\nurlpatterns = [path('d/<int:pk>/', views.show)]\n",
    "views.py": "from django.http import HttpResponse\ndef show(request, pk):\n    name = request.GET['n']\n    return HttpResponse(name)\n",
    "openapi.yml": "paths:\n  /items/{id}:\n    get:\n      operationId: pkg.api.item\n      parameters: [{name: id, in: path, required: true, schema: {type: string}}]\n",
    "pkg/api.py": "def item(id):\n    return open(id)\n",
}


def write(folder, files):
    for name, text in files.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def shown(result):
    return {(f["vuln_type"], f["source"]["line"], f["sink"]["line"], f["sanitized"], f["endpoint"]["match"]) for f in result.to_dict()["findings"]}


def test_java(spark, tmp_path):
    root = write(tmp_path / "src", JAVA)
    (tmp_path / "more.yaml").write_text(EXTRA)
    r = scan(spark, root, rules_paths=[str(tmp_path / "more.yaml")])
    assert r.language == "java"
    assert shown(r) == {
        ("sql_injection", 6, 16, False, "exact"), ("command_injection", 20, 21, False, "exact"), ("path_traversal", 22, 24, False, "exact"), ("xss", 26, 30, True, "exact"),
        ("insecure_hash", 51, 51, False, "exact"), ("trust_boundary", 53, 55, False, "exact"), ("command_injection", 53, 56, False, "exact"),
    }
    report = json.loads(r.to_json())
    sql = next(f for f in report["findings"] if f["vuln_type"] == "sql_injection")
    assert sql["related_categories"] == ["log_injection"] and sql["severity"] == "critical" and sql["call_chain"][0]["line"] == 6
    assert next(f for f in report["findings"] if f["vuln_type"] == "insecure_hash")["call_chain"][0]["edge_type"] == "PATTERN"
    ends = {e["route"]: e for e in report["endpoints"]}
    assert len(ends) == 9 and ends["/api/file/{name}"]["params"][0]["source"] == "path" and ends["/api/me"]["auth_required"]
    assert ends["/api/run"]["methods"] == ["POST"] and ends["/api/run"]["params"] == [{"name": "c", "source": "query", "type_hint": "String", "required": False}]
    bare = [e for e in json.loads(r.to_elements_json()) if e["kind"] == "sink" and not e["covered"]]
    assert {e["line"] for e in bare} >= {34, 36, 43, 47}
    assert "sql_injection" in r.to_text() and len(json.loads(r.to_canonical_json())) == 7
    assert report["summary"]["findings"] == 7 and report["summary"]["endpoints"] == 9
    kinds = {x["kind"] for x in C.blind_spot_manifest(r.endpoints, r.nodes, r.rules, r.findings).collect()}
    assert {"endpoint_no_auth", "structural", "category_gap"} <= kinds and "category_uncovered" not in kinds


def test_java_options(spark, tmp_path):
    root = write(tmp_path / "src", JAVA)
    capped = scan(spark, root, max_findings_per_category=1, severity_overrides={"command_injection": "low"}, enable_container_bridge=True, include_blind_spots=False)
    assert capped.to_dict()["summary"]["truncated_categories"]["command_injection"] == 1
    assert ("sql_injection", 38, 43, False, "exact") in shown(capped) or capped.to_dict()["summary"]["truncated_categories"].get("sql_injection") == 1
    assert {f["severity"] for f in capped.to_dict()["findings"] if f["vuln_type"] == "command_injection"} == {"low"}


def test_python(spark, tmp_path):
    root = write(tmp_path / "src", PYTHON)
    cache = str(tmp_path / "cache")
    r = scan(spark, root, use_cache=True, cache=cache)
    found = {(f["vuln_type"], f["source"]["file_path"], f["sink"]["file_path"], f["sink"]["function"]) for f in r.to_dict()["findings"]}
    assert found == {("sql_injection", "app.py", "one.py", "save"), ("command_injection", "app.py", "pkg/deep.py", "tool"), ("sql_injection", "long.py", "long.py", "long_enough"), ("xss", "views.py", "views.py", "show"), ("path_traversal", "pkg/api.py", "pkg/api.py", "item")}
    ends = {(e["framework"], e["route"], e["handler"], e["file_path"]) for e in r.to_dict()["endpoints"]}
    assert ends == {("flask", "/a/<int:n>", "a", "app.py"), ("django", "d/<int:pk>/", "show", "views.py"), ("connexion", "/items/{id}", "item", "pkg/api.py")}
    assert [x["file_path"] for x in r.tables.errors().collect()] == ["broken.py"]
    assert r.nodes.where("file_path like '%hidden%'").count() == 0 and r.nodes.where("function = 'latin'").count() > 0
    t = r.tables
    steps = [(x["kind"], x["function"], x["var_name"]) for x in C.trace_cross_function("q", "a", "tool", t.calls(), t.params(), t.uses(), t.defs()).orderBy("pos").collect()]
    assert steps == [("call_arg", "a", "q"), ("param", "tool", "cmd"), ("use", "tool", "cmd")]
    again = scan(spark, root, use_cache=True, cache=cache)
    assert {(f["vuln_type"], f["sink"]["function"]) for f in again.to_dict()["findings"]} == {(a, d) for a, _, _, d in found}
    with pytest.raises(ValueError):
        scan(spark, root, language="python", framework="no such")


def test_parsers():
    facts = parse_text("a.js", "const express = require('express');\nconst app = express();\nasync function load(name) {\n  const path = '/d/' + name\n  let data = fs.readFileSync(path)\n  if (data) { return data } else { throw new Error(/x[/]y/.test(`${name}`)) }\n}\napp.post('/u/:id', auth, load)\nclass A { go(q) { for (const x of q) { this.y = x; } } }\nexport default { run: async (c) => c.exec() };\n", "javascript")
    of = lambda kind: [(r["function"], r["name"], r["line"]) for r in facts if r["kind"] == kind]
    assert of("function") == [(None, "load", 3), (None, "go", 9), (None, "run", 10)]
    assert {n for f, n, _ in of("def") if f == "load"} == {"name", "path", "data"} and ("go", "x", 9) in of("def")
    assert {n for f, n, _ in of("call") if f == "load"} == {"readFileSync", "Error", "test"}
    (end,) = [json.loads(r["text"]) for r in facts if r["kind"] == "endpoint"]
    assert end["methods"] == ["POST"] and end["params"][0]["name"] == "id" and end["auth_required"]
    kinds = lambda path, text, language: [(r["extra"], r["text"]) for r in parse_text(path, text, language) if r["kind"] == "cfg"]  # noqa: E731,F841
    java = "class A { int f(int n) { while (n > 0) { if (n == 3) break; n--; } switch (n) { case 1: return 1; default: n = 2; } try { g(); } catch (E e) { h(); } finally { k(); } return n; } }"
    python = "def f(n):\n    while n > 0:\n        if n == 3:\n            break\n        n -= 1\n    else:\n        n = 9\n    try:\n        g()\n    except E:\n        h()\n    finally:\n        k()\n    return n\n"
    for path, text, language in (("A.java", java, "java"), ("a.py", python, "python")):
        rows = parse_text(path, text, language)
        edges = {r["text"] for r in rows if r["kind"] == "cfg"}
        assert edges == {"fallthrough", "branch_true", "branch_false", "loop_back", "exception", "return"}
        blocks = {r["name"] for r in rows if r["kind"] == "block"}
        into = {r["extra"] for r in rows if r["kind"] == "cfg"}
        assert all(r["name"] in blocks and r["extra"] in blocks for r in rows if r["kind"] == "cfg") and len(blocks - into) == 1
    assert decode(b"\xe9") == "é" and decode(None) == ""
    with pytest.raises(ValueError):
        parse_text("a.c", "", "c")
    for text in ("", "{{{", "class", "function (", "`${`", "\"", "@", "for (;;", "x => {"):
        for language in ("java", "javascript", "python"):
            assert isinstance(parse_text("f", text, language), list)


def test_more_frameworks():
    def ends(text, language, name):
        facts = Facts("f", language)
        from flowspar.sources.facts import PARSERS

        PARSERS[language](text, facts)
        frameworks.get_extractor(name)(facts, text)
        return [json.loads(r["text"]) | {"handler": r["name"]} for r in facts.rows if r["kind"] == "endpoint"]

    (fast,) = ends("from fastapi import FastAPI, Query\n@app.get('/i/{k}')\nasync def item(k: int, q: str = Query(None), b: Item = None, u=Depends(get_auth)):\n    return q\n", "python", "fastapi")
    assert [(p["name"], p["source"], p["required"]) for p in fast["params"]] == [("k", "path", True), ("q", "query", False), ("b", "body", False)] and fast["auth_required"]
    jax = ends('import javax.ws.rs.*;\n@Path("r")\nclass R { @GET @POST @Path("{id}") public String get(@PathParam("id") String id) { return id; } }', "java", "jaxrs")
    assert [(e["route"], e["methods"], e["params"][0]["source"]) for e in jax] == [("/r/{id}", ["GET"], "path"), ("/r/{id}", ["POST"], "path")]
    feign = ends('import org.springframework.x;\n@FeignClient(name = "n", url = "http://u")\ninterface F { @RequestMapping(value = "/z", method = RequestMethod.PUT) String z(@RequestHeader("h") String h); }', "java", "spring")
    assert [(e["route"], e["methods"], e["framework"], e["params"][0]["name"]) for e in feign] == [("http://u/z", ["PUT"], "spring-cloud", "h")]
    actuator = ends('import org.springframework.x;\n@Endpoint(id = "odd")\nclass E { @ReadOperation public String r() { return ""; } }', "java", "spring")
    assert [(e["route"], e["methods"]) for e in actuator] == [("/actuator/odd", ["GET"])]


def test_import_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b/c.py", "a/b/d.py", "a/x/__init__.py", "x.py", "lib/deep/util.py", "w/m.js", "w/n/index.js", "s/com/p/K.java", "s/com/q/L.java", "s/com/q/M.java")], "path string")
    rows = [("a/b/c.py", "python", ".d", "f", "f", True), ("a/b/c.py", "python", "..x", "g", "g", True), ("a/b/c.py", "python", "x", None, "x", False), ("a/b/c.py", "python", "deep.util", "h", "h", False), ("a/b/c.py", "python", ".", "d", "d", True), ("a/b/c.py", "python", "nowhere", None, "n", False), ("w/m.js", "javascript", "./n", "k", "k", True), ("w/n/index.js", "javascript", "../m", "k", "k", True), ("s/com/p/K.java", "java", "com.q.L", "L", "L", False), ("s/com/p/K.java", "java", "com.q.*", "*", "*", False)]
    got = {(r["file_path"], r["module"], r["target"]) for r in R.resolve_imports(spark.createDataFrame(rows, "file_path string, language string, module string, name string, alias string, is_relative boolean"), files).collect()}
    c, k = "a/b/c.py", "s/com/p/K.java"
    assert got == {(c, ".d", "a/b/d.py"), (c, "..x", "a/x/__init__.py"), (c, "x", "a/x/__init__.py"), (c, "deep.util", "lib/deep/util.py"), (c, ".", "a/b/d.py"), ("w/m.js", "./n", "w/n/index.js"), ("w/n/index.js", "../m", "w/m.js"), (k, "com.q.L", "s/com/q/L.java"), (k, "com.q.*", "s/com/q/L.java"), (k, "com.q.*", "s/com/q/M.java")}


def test_command_line(spark, tmp_path, capsys):
    from flowspar.__main__ import main

    root = write(tmp_path / "src", {"a.js": "function f(req, res) {\n  const q = req.query.x;\n  eval(q);\n}\n"})
    out = tmp_path / "report.json"
    assert main([root, "-o", str(out), "--no-canonical"]) == 0
    assert "code_injection" in capsys.readouterr().out
    assert len(json.loads(out.read_text())["findings"]) == 1 and (tmp_path / "report.elements.json").exists() and not (tmp_path / "report.canonical.json").exists()


def test_a_scan_does_what_is_asked_and_broadcasts_no_table(spark, tmp_path):
    """Endpoints need no graph, nodes no search; tables that grow with the input don't go through the driver."""
    from flowspar.sources.durable import durable

    r = scan(spark, write(tmp_path / "src", {"app.py": PYTHON["app.py"]}))
    assert r.endpoints.count() == 1 and not {"_graph", "nodes", "_found"} & set(vars(r))
    assert r.nodes.count() > 0 and "_found" not in vars(r)
    assert "BroadcastHashJoin" not in r.nodes.join(r.edges, r.nodes["node_id"] == r.edges["src"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in spark.range(9).join(durable(spark.range(5), "x").where("id > 1").distinct(), "id")._jdf.queryExecution().executedPlan().toString()
