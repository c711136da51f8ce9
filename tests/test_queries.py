"""Registered queries of the code-flow engine against their SQL, and the import guard."""

import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from flowspar.operators import match as M
from flowspar.plans import registry

SF = "/root/testdata/sf0.001"
FAST = sorted(set(registry.oracle_sql()) - set("event_taint_reach event_path_string event_sanitized reach_by_user reach_capped truncated_by_category backward_sources forward_sinks call_chain".split()))


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    held.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        held.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return held


def plain(rows):
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", [*FAST, "event_taint_reach"])
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, df.collect())) == plain(expected)


def test_features_decide_rows(spark):
    """Inputs on which the feature of a query changes its result."""
    q = registry.queries()
    rows = lambda name: q[name](spark, SF).collect()
    n = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    assert 0 < len(rows("chain_fold")) < n("events") and 0 < len(rows("last_wins")) < n("lineitem")
    assert {r["label"] for r in rows("source_priority")} >= {"source", "sink"} and len(rows("label_exclude")) < n("pages")
    assert {r["match"] for r in rows("tiered_link")} >= {"exact", "group"} and {r["tier"] for r in rows("three_tier_match")} == {"high", "medium", "low"}
    assert max(r["events"] for r in rows("span_join")) > min(r["events"] for r in rows("span_join")) and len({r["categories"] for r in rows("rule_label_pages")}) > 1
    per = {}
    for r in rows("paths_per_pair"):
        per[r["nation"], r["segment"]] = per.get((r["nation"], r["segment"]), 0) + 1
    assert max(per.values()) == 5 and len(rows("paths_per_pair")) < n("customer")


def test_entry_point_without_the_llm_folder():
    code = "import sys; sys.modules['flowspar.llm'] = None; sys.path.insert(0, '.'); import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name.startswith(('flowspar.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name=name)\nsys.modules.pop('flowspar.llm'); sys.meta_path.insert(0, Gone()); import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_span_join_rounds_seconds_as_sql_does(spark, con, tmp_path):
    """Times with fractions of a second: epoch(ts)::BIGINT rounds them, half to even."""
    times = {1: "00:00:00.600", 2: "04:00:00.700", 3: "04:00:01.400", 4: "04:00:01.500", 5: "04:00:01.600", 6: "00:00:02.500"}
    con.execute(f"copy (select * from (values {', '.join(f'({i}, timestamp {chr(39)}2024-01-01 {t}{chr(39)}, 7, {chr(39)}{"signup" if i in (1, 6) else "view"}{chr(39)})' for i, t in times.items())}) v(event_id, ts, user_id, event_type)) to '{tmp_path}/events.parquet'")
    sql = registry.oracle_sql()["span_join"].replace("FROM events)", f"FROM '{tmp_path}/events.parquet')")
    got = registry.queries()["span_join"](spark, str(tmp_path)).select("event_id", "events").collect()
    assert plain(map(tuple, got)) == plain(con.execute(f"SELECT event_id, events FROM ({sql})").fetchall())


def test_three_tier_match_of_a_hot_key_in_many_tasks(spark, con, tmp_path, monkeypatch):
    """Nearly all rows have one nation and one remainder: their pairs are all there, and no task makes more than its share."""
    monkeypatch.setattr(M, "PAIRS", 1000, raising=False)
    monkeypatch.setattr(M, "PIECE", 8, raising=False)
    for table, key, rows, name in ("customer", "c_custkey", 300, 100), ("supplier", "s_suppkey", 150, 390):
        some = f"select i * 7 as {key}, 'N#' || (i + {name}) as {key[0]}_name, case when i = 5 then null else 3 end::int as {key[0]}_nationkey from range({rows}) r(i)"
        con.execute(f"copy ({some} union all select 7 * i + 1, 'M{key[0]}#' || (i + {name + 5000}), i::int from range(1000, 1010) r(i)) to '{tmp_path}/{table}.parquet'")
    sql = registry.oracle_sql()["three_tier_match"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'").replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet'")
    df = registry.queries()["three_tier_match"](spark, str(tmp_path))
    got = df.withColumn("_task", F.spark_partition_id()).collect()
    assert plain((r["c_custkey"], r["s_suppkey"], r["tier"]) for r in got) == plain(con.execute(sql).fetchall())
    assert {r["tier"] for r in got} == {"high", "medium", "low"} and len(got) > 40_000
    assert max(Counter(r["_task"] for r in got).values()) < 3000
