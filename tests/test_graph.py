"""Graph operators against plain-Python brute force."""

import random
from collections import defaultdict, deque
from itertools import product

import pytest

from flowspar.operators import discovery as D
from flowspar.operators import dominance as DO
from flowspar.operators import findings as N
from flowspar.operators import label as L
from flowspar.operators import match as M
from flowspar.operators import search as G
from flowspar.plans import coverage as C
from flowspar.plans import graph as B


def random_graph(rng, n, m, prefix=""):
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    rng.shuffle(pairs)
    return [(f"{prefix}{a:02d}", f"{prefix}{b:02d}", rng.choice(["DATA_FLOW", "CALLS", "CTRL_FLOW"] + ["DATA_FLOW"] * 4), k) for k, (a, b) in enumerate(pairs) if a != b]


def successors(edges):
    out = defaultdict(list)
    for a, b, kind, _ in sorted(edges, key=lambda e: e[3]):
        if kind != "CTRL_FLOW":
            out[a].append(b)
    return out


def queue_search(src, sinks, succ, most, per):
    found, seen, count, queue = [], {src}, defaultdict(int), deque([[src]])
    while queue:
        path = queue.popleft()
        if len(path) > most:
            continue
        at = path[-1]
        if at in sinks and at != src and count[at] < per:
            found.append(path)
            count[at] += 1
        for b in succ[at]:
            if b in seen:
                if b in sinks and b != src and count[b] < per:
                    found.append([*path, b])
                    count[b] += 1
                continue
            seen.add(b)
            queue.append([*path, b])
    return found


def test_taint_paths_by_brute_force(spark):
    """Branching graphs with cycles: sinks met again, the cap of a pair, and the limit of nodes."""
    rng = random.Random(4)
    edges, sources, sinks, brute = [], [], [], []
    for g in range(12):
        own = random_graph(rng, 14, 40, f"g{g}.")
        nodes = [f"g{g}.{i:02d}" for i in range(14)]
        src, snk = rng.sample(nodes, 3), rng.sample(nodes, 4)
        edges += own
        sources += src
        sinks += snk
        brute += [(s, p) for s in src for p in queue_search(s, set(snk), successors(own), 5, 2)]
    one = lambda ids: spark.createDataFrame([(i,) for i in sorted(set(ids))], "node_id string")
    out = G.taint_paths(one(sources), one(sinks), spark.createDataFrame(edges, "src string, dst string, edge_type string, seq long"), 5, 2)
    got = [(r["source"], r["path"]) for r in sorted(out.collect(), key=lambda r: (r["source"], r["event"]))]
    assert sorted(got) == sorted(brute) and max(len(p) for _, p in got) == 6
    for s in set(sources):
        assert [p for t, p in got if t == s] == [p for t, p in brute if t == s]


def shared_search(sources, sinks, succ, most, limit):
    found, seen = [], set()
    for s in sources:
        if len(found) >= limit:
            break
        seen.add(s)
        mine, queue = {s}, deque([[s]])
        for_this = []
        while queue:
            path = queue.popleft()
            if len(path) > most:
                continue
            if path[-1] in sinks and path[-1] != s:
                for_this.append(path)
                continue
            for b in succ[path[-1]]:
                if b not in mine and b not in seen:
                    mine.add(b)
                    seen.add(b)
                    queue.append([*path, b])
        found += for_this[: limit - len(found)]
    return sorted(found, key=len)


@pytest.mark.parametrize("case", ["depth", "hidden", "random"])
def test_find_path_by_brute_force(spark, case):
    """'depth': no path is longer than asked. 'hidden': what an earlier source entered, even without getting on from there
    within the depth, no later one enters; it goes round."""
    if case == "depth":
        edges, sources, sinks, most = [("a", "m"), ("m", "k"), ("k", "t")], ["a"], ["t"], 3
    elif case == "hidden":
        edges, sources, sinks, most = [("a", "p1"), ("p1", "p2"), ("p2", "m"), ("m", "t"), ("t", "u"), ("b", "t"), ("b", "x"), ("x", "y"), ("y", "u")], ["a", "b"], ["u"], 4
    else:
        rng = random.Random(9)
        edges = [e[:2] for e in random_graph(rng, 24, 60) if e[2] != "CTRL_FLOW"]
        sources, sinks, most = ["00", "05", "07", "11", "16"], ["03", "09", "12", "20", "22"], 5
    rows = [(a, b, "DATA_FLOW", k) for k, (a, b) in enumerate(edges)]
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "node_id string")
    out = [r["path"] for r in G.find_path(one(sources), one(sinks), spark.createDataFrame(rows, "src string, dst string, edge_type string, seq long"), most, 6).collect()]
    brute = shared_search(sources, set(sinks), successors(rows), most, 6)
    assert out == brute and (case != "hidden" or out == [["b", "x", "y", "u"]]) and (case != "depth" or out == [])


def reaches(succ, a, without=None):
    seen, stack = set(), [a] if a != without else []
    while stack:
        n = stack.pop()
        if n not in seen:
            seen.add(n)
            stack += [m for m in succ.get(n, ()) if m != without]
    return seen


@pytest.mark.parametrize("seed", range(40))
def test_dominance_by_removal(seed):
    """a dominates b if b is out of reach without a; the same backwards from the exits; b is control dependent on a if it
    post-dominates one of a's successors, or is one, but not a strictly."""
    rng = random.Random(seed)
    n = rng.randrange(3, 10)
    nodes = [f"b{i}" for i in range(n)]
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(2 * n)} | {(nodes[i], nodes[i + 1]) for i in range(n - 1) if rng.random() < 0.8})
    got = defaultdict(set)
    for kind, a, b in DO.analyse(nodes, nodes[0], edges):
        got[kind].add((a, b))
    succ, pred = defaultdict(list), defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
        pred[b].append(a)
    live = reaches(succ, nodes[0])
    assert got["dom"] == {(a, b) for a in live for b in live if b not in reaches(succ, nodes[0], a)}
    pred["<exit>"] = [x for x in nodes if not succ.get(x)]
    ends = reaches(pred, "<exit>") - {"<exit>"}
    pdom = {(a, b) for a in ends for b in ends if b not in reaches(pred, "<exit>", a)}
    assert got["pdom"] == pdom
    for tree, whole in (("idom", got["dom"]), ("ipdom", pdom)):
        strict = {b: {a for a, c in whole if c == b and a != b} for b in nodes}
        assert got[tree] == {(a, b) for b in nodes for a in strict[b] if all((c, a) in whole for c in strict[b])}
    inside = {(a, b) for a, b in got["cd"] if a in ends and b in ends and all(s in ends for s in succ[a])}
    wanted = {(a, b) for a in ends if len(set(succ[a])) > 1 and all(s in ends for s in succ[a]) for b in ends if any((b, s) in pdom for s in succ[a]) and not ((b, a) in pdom and b != a)}
    assert inside == wanted


def test_points_in_spans_of_all_widths(spark):
    rng = random.Random(2)
    points = [(k, rng.randrange(10**9)) for k in range(3) for _ in range(120)] + [(0, 0), (0, 10**9)]
    spans = [(k, i, a, a + int(10 ** rng.uniform(0, 9.2))) for k in range(3) for i, a in enumerate(rng.sample(range(10**9), 60))] + [(0, 99, 5, 4)]
    out = M.in_span(spark.createDataFrame(points, "k int, p long"), spark.createDataFrame(spans, "k int, i int, a long, b long"), ["k"], "p", "a", "b", 8)
    assert sorted((r["k"], r["p"], r["i"]) for r in out.collect()) == sorted((k, p, i) for (k, p), (q, i, a, b) in product(points, spans) if k == q and a <= p <= b)


def test_arguments_meet_parameters(spark):
    """By name, else by place, else all; a name that fits keeps others from the last resort."""
    refs = spark.createDataFrame([("r:x", "f", "g", 1, "x"), ("r:y", "f", "g", 1, "y"), ("r:x2", "f", "g", 2, "x"), ("r:z3", "f", "g", 3, "z")], "node_id string, file_path string, function string, line int, var_name string")
    params = spark.createDataFrame([("p:x", "f", "h", "x", 0), ("p:b", "f", "h", "b", 1), ("p:k", "f", "i", "k", 0)], "node_id string, file_path string, function string, var_name string, param_index int")
    sites = spark.createDataFrame([("c1", "f", "g", "h", 1, ["x", "y"]), ("c2", "f", "g", "i", 2, ["x"]), ("c3", "f", "g", "h", 3, ["z + 1"])], "call_id string, file_path string, caller string, callee string, line int, call_args array<string>")
    targets = spark.createDataFrame([("c1", "f"), ("c2", "f"), ("c3", "f")], "call_id string, target_file string")
    got = {tuple(r) for r in B.argument_edges(refs, params, sites, targets).collect()}
    assert got == {("c1", "r:x", "p:x", "high"), ("c1", "r:y", "p:b", "medium"), ("c2", "r:x2", "p:k", "medium"), ("c3", "r:z3", "p:x", "low"), ("c3", "r:z3", "p:b", "low")}


def test_large_rule_tables_match_alike(spark, monkeypatch):
    rules = spark.createDataFrame([("sinks", "a", "exec", 0), ("sinks", "b", "execute(", 1), ("sinks", "a", "", 2), ("sinks", "c", "Exec", 3), ("sink_excludes", "", r"^safe", 0)], "section string, category string, pattern string, ord int")
    nodes = spark.createDataFrame([(1, "x.execute(y)"), (2, "safe exec"), (3, None), (4, ""), (5, "x.execute(y)")], "i int, text string")
    run = lambda: {r["i"]: (r["c"], r["best"]["pattern"] if r["best"] else None, r["_out"]) for r in L.with_excluded(L.with_matches(nodes, rules, "sinks"), rules).select("i", L.category_set().alias("c"), L.longest().alias("best"), "_out").collect()}
    small = run()
    monkeypatch.setattr(L, "RULES_SENT", 0)
    monkeypatch.setattr(L, "EXPRESSIONS_SENT", 0)
    assert run() == small == {1: (["a", "b"], "execute(", False), 2: (["a"], "exec", True), 3: ([], None, False), 4: ([], None, False), 5: (["a", "b"], "execute(", False)}


def test_scores_and_gates(spark):
    rows = spark.createDataFrame([("x = OS.SYSTEM(y)",), ("x = a + b",), (None,)], "t string").select(D.heuristic_score("t").alias("s")).collect()
    assert [r["s"] for r in rows][:2] == [33, 20]  # the keyword 'system' and the module 'os.', in any case of letters
    gate = spark.createDataFrame([("sql_injection", ["q", "x"], "x"), ("sql_injection", ["x", "q"], "x"), ("command_injection", ["q", "x"], "x"), ("ssti", ["a", "req.x"], "x"), ("xss", ["q", "x"], None)], "c string, a array<string>, v string")
    from pyspark.sql import functions as F

    assert [r["ok"] for r in gate.select(N.position_gate(F.col("c"), F.col("a"), F.coalesce("v", F.lit(""))).alias("ok")).collect()] == [False, True, True, False, True]
    writes = spark.createDataFrame([("m.put(k, v)",), (" sb.append(x)",), ("a.setName(x)",), ("a.get(x)",), ("f(x)",)], "t string").select(L.container_write("t").alias("h")).collect()
    assert [r["h"] for r in writes] == ["m", "sb", "a", None, None]


def test_heuristic_sinks_need_http_ancestry(spark):
    kind = "node_id string, node_type string, file_path string, line int, function string, text string, taint_source array<string>, taint_sink array<string>"
    nodes = spark.createDataFrame([("h", "assignment", "f", 1, "g", "q = request.args", None, None), ("s", "assignment", "f", 2, "g", "s = q", ["injection_general"], None), ("t", "assignment", "f", 3, "g", "t = os.system('a' + s)", None, None), ("u", "assignment", "f", 9, "g", "u = os.system('a' + z)", None, None), ("l", "assignment", "f", 8, "g", "z = 1", ["injection_general"], None)], kind)
    edges = spark.createDataFrame([("h", "s", "DATA_FLOW", 1), ("s", "t", "DATA_FLOW", 2), ("l", "u", "DATA_FLOW", 3)], "src string, dst string, edge_type string, seq long")
    rules = spark.createDataFrame([("sinks", "command_injection", "os.system(", 0)], "section string, category string, pattern string, ord int")
    assert [(r["node_id"], r["score"]) for r in D.heuristic_sinks(nodes, edges, rules, 0).collect()] == [("t", 93), ("u", 68)]
    assert [r["line"] for r in D.sink_candidates(nodes).collect()] == [3, 9] and D.uncovered_sinks(nodes).count() == 2


def test_patterns_and_chains(spark):
    kind = "node_id string, node_type string, file_path string, line int, function string, text string, var_name string, name string, taint_source array<string>, taint_sink array<string>"
    nodes = spark.createDataFrame([("a", "assignment", "f", 1, "g", "a = input()", "a", None, ["injection_general"], None), ("b", "call_site", "f", 2, "g", "os.system(a)", None, "system", None, ["command_injection"]), ("c", "function", "f", 1, "g", "os.system", None, "g", None, None)], kind)
    rules = spark.createDataFrame([("sources", "injection_general", "input(", 0), ("sinks", "command_injection", "os.system(", 0)], "section string, category string, pattern string, ord int")
    ids = lambda *a: [r["node_id"] for r in L.taint_nodes(nodes, rules, *a).collect()]
    assert ids("command_injection", "sink") == ids("x = os.system(y)", "sink") == ["b"] and ids("input()", "source") == ["a"]
    assert ids("os.system(", "source") == [] and ids("nothing such", "sink") == [] and ids("a = ") == ["a"]
    edges = spark.createDataFrame([("a", "b", "DATA_FLOW", 1), ("c", "b", "CALLS", 2)], "src string, dst string, edge_type string, seq long")
    assert [r["path"] for r in C.find_path(nodes, edges, rules, "input()", "os.system(x)").collect()] == [["a", "b"]]
    assert [r["path"] for r in G.call_chain("c", "b", edges).collect()] == [["c", "b"]]
    found = G.taint_paths(nodes.where("taint_source is not null"), nodes.where("taint_sink is not null"), edges)
    assert C.path_text(found, nodes).first()["text"] == "f:1 a = input()\n  └ f:2 os.system(a)"
    assert C.path_sanitizers(found, nodes).count() == 0


@pytest.mark.parametrize("bucket", [None, 4])
def test_smallest_span_by_brute_force(spark, bucket):
    """Spans that are no answer for points of their own id, ties, points in no span; and no join, which would make pairs."""
    rng = random.Random(11)
    points = [(rng.randrange(3), i, float(rng.randrange(60))) for i in range(90)]
    spans = [(rng.randrange(3), i % 80, i, float(a), float(a + rng.choice([0, 1, 1, 5, 20, 70, -1]))) for i, a in enumerate(rng.choices(range(50), k=120))]
    p, s = spark.createDataFrame(points, "k int, i int, p double"), spark.createDataFrame(spans, "k int, of int, t int, a double, b double")
    out = M.smallest_span(p, s, ["k"], "p", "a", "b", ["t"], ["i"], bucket, ("of", "i"))
    brute = {}
    for k, i, x in points:
        held = [(b - a, t) for n, of, t, a, b in spans if n == k and a <= x <= b and of != i]
        if held:
            brute[i] = min(held)[1]
    assert {r["i"]: r["t"] for r in out.collect()} == brute and 0 < len(brute) < len(points)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_taint_paths_within_groups_by_brute_force(spark):
    """Groups searched whole in a task: the same paths in the same order, without a table for each level."""
    rng = random.Random(5)
    edges, sources, sinks, brute = [], [], [], []
    for g in range(12):
        own = random_graph(rng, 14, 40, f"g{g}.")
        nodes = [f"g{g}.{i:02d}" for i in range(14)]
        src, snk = rng.sample(nodes, 3), rng.sample(nodes, 4)
        edges += [(g, *e) for e in own]
        sources += [(g, s) for s in src]
        sinks += [(g, s) for s in snk]
        brute += [(s, p) for s in src for p in queue_search(s, set(snk), successors(own), 5, 2)]
    one = lambda ids: spark.createDataFrame(ids, "g int, node_id string")
    out = G.taint_paths_within(one(sources), one(sinks), spark.createDataFrame(edges, "g int, src string, dst string, edge_type string, seq long"), "g", 5, 2).collect()
    assert sorted((r["source"], r["path"]) for r in out) == sorted(brute)
    for r in out:
        assert r["hops"] == len(r["path"]) - 1 == len(r["etypes"]) and [p for s, p in brute if s == r["source"] and p[-1] == r["sink"]][r["nth"] - 1] == r["path"]


def test_blocks_of_users_make_no_pairs_and_dominators_alone(spark):
    """Edges come from each event alone, not from all pairs of a user's; dominators can be asked for without the rest."""
    from flowspar.plans import registry

    blocks, edges = registry._user_blocks(spark, "/root/testdata/sf0.001")
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()
    arrows = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")]
    assert list(DO.analyse(list("abcd"), "a", arrows, True)) == [x for x in DO.analyse(list("abcd"), "a", arrows) if x[0] == "dom"]


def test_tiers_against_all_pairs(spark, monkeypatch):
    """Repeated rows, repeated left keys, empty keys and more than one column on either side."""
    monkeypatch.setattr(M, "PIECE", 3)
    rng = random.Random(5)
    some = lambda n, k: None if rng.random() < 0.1 else rng.randrange(n) * k
    left = [(rng.randrange(30), rng.choice("ab"), some(20, 1), some(6, 1)) for _ in range(60)]
    right = [(rng.randrange(9), some(5, 1), some(10, 2), some(6, 1) if k % 9 else 7) for k in range(50)]
    df, other = spark.createDataFrame(left, "a int, b string, x int, y int"), spark.createDataFrame(right, "p int, q int, u int, v int")
    tiers = [("one", ["x", "y"], ["u", "v"]), ("two", ["x"], ["u"]), ("three", ["y"], ["v"])]
    same = [lambda l, r: l[2:] == r[2:] and None not in l[2:], lambda l, r: l[2] is not None and l[2] == r[2], lambda l, r: l[3] is not None and l[3] == r[3]]
    for key in ["a", "b"], ["a"]:
        took, expected = {}, []
        for (tier, *_), on in zip(tiers, same):
            hit = [(l[: len(key)], r, tier) for l, r in product(left, right) if l[: len(key)] not in took and on(l, r)]
            took |= {l: tier for l, _, _ in hit}
            expected += [(*l, *r[:2], tier) for l, r, _ in hit]
        got = M.tiers(df, other, key, [(t, [df[c] for c in a], [other[c] for c in b]) for t, a, b in tiers], ["p", "q"])
        assert got.columns == [*key, "p", "q", "tier"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
        assert set(took.values()) == {"one", "two", "three"}
