"""The scan of a source tree: files to findings, as a bundle of DataFrames and their JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspar import schema as S
from flowspar.operators import findings as N
from flowspar.operators import label as L
from flowspar.operators import search as G
from flowspar.parse import frameworks
from flowspar.plans.graph import build_graph, mark_route_parameters
from flowspar.sources import files as Files
from flowspar.sources.durable import durable
from flowspar.sources.facts import FactTables, cached_facts, parse_files
from flowspar.sources.rules import load_rules


@dataclass
class ScanResult:
    """What a scan found. Everything is a DataFrame; the to_... methods bring a report to the driver. Files are parsed at once;
    graph, labels, paths and findings are made when they are first asked for."""

    tables: FactTables
    files: DataFrame
    rules: DataFrame
    language: str
    include_blind_spots: bool = True
    max_findings_per_category: int = S.PER_CATEGORY
    severity_overrides: dict[str, str] | None = None
    container_bridge: bool = False
    state_bridge: bool = False

    @cached_property
    def endpoints(self) -> DataFrame:
        return durable(self.tables.endpoints(), "endpoints").orderBy("file_path", "line", "route", "handler")

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        return build_graph(self.tables, self.files, self.rules, self.container_bridge, self.state_bridge)

    @property
    def edges(self) -> DataFrame:
        return self._graph[1]

    @cached_property
    def nodes(self) -> DataFrame:
        """Labelled nodes."""
        return durable(mark_route_parameters(L.label_nodes(self._graph[0], self.rules), self.endpoints), "labelled")

    @cached_property
    def _found(self) -> tuple[DataFrame, DataFrame]:
        nodes, cap = self.nodes, self.max_findings_per_category
        paths = durable(G.taint_paths(nodes.where("taint_source is not null"), nodes.where("taint_sink is not null"), self.edges), "paths")
        taints, cut = N.build(paths, nodes, self.rules, cap, self.severity_overrides)
        taints = durable(taints, "taints")
        patterns, pattern_cut = N.pattern_findings(nodes, self.rules, taints, cap, self.severity_overrides)
        found = durable(taints.unionByName(patterns), "findings")
        return found, cut.unionByName(pattern_cut).groupBy("category").agg(F.sum("truncated").alias("truncated"))

    @property
    def findings(self) -> DataFrame:
        return self._found[0]

    @property
    def truncated(self) -> DataFrame:
        return self._found[1]

    @cached_property
    def linked(self) -> DataFrame:
        """Findings with their endpoint, in the order of reports: by type and sink, pattern findings last."""
        chains = N.chains(self.findings, self.nodes)
        rows = N.link_endpoints(self.findings, self.endpoints).join(chains, "id", "left")
        order = [c if c.startswith(("sink.", "source.")) else c for c in ("is_pattern", "vuln_type", "sink.file_path", "sink.line", "source.file_path", "source.line", "id")]
        return durable(rows, "linked").orderBy(*order)

    @cached_property
    def blind_spots(self) -> DataFrame:
        """Endpoints whose handler has no labelled source."""
        bare = N.exposed_without_source(self.endpoints, self.nodes)
        if not self.include_blind_spots:
            bare = bare.limit(0)
        what = F.concat_ws(" ", "method_list", "route")
        return bare.select(F.lit("endpoint_no_source").alias("kind"), F.format_string("%s:%d", "file_path", "line").alias("location"), F.concat(F.lit("the handler of "), what, F.lit(" has no known source")).alias("reason"), F.lit("review by hand: object references and business logic").alias("recommendation")).orderBy("location", "reason")

    @cached_property
    def elements(self) -> DataFrame:
        return N.elements(self.nodes, self.findings, self.rules)

    @cached_property
    def canonical(self) -> DataFrame:
        return N.canonical(self.findings, self.linked, self.linked.select("id", "call_chain"))

    @cached_property
    def summary(self) -> DataFrame:
        """One row of counts (A1), with a map of what the cap left out."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        n = self.nodes.agg(F.count_if(F.col("node_type") == "function").alias("functions"), F.count_if(F.col("taint_source").isNotNull()).alias("sources"), F.count_if(F.col("taint_sink").isNotNull()).alias("sinks"))
        cut = self.truncated.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "truncated")))).alias("truncated_categories"))
        return count(self.files, "files").crossJoin(n).crossJoin(count(self.endpoints, "endpoints")).crossJoin(count(self.findings, "findings")).crossJoin(count(self.blind_spots, "blind_spots")).crossJoin(cut)  # one row each

    def to_dict(self) -> dict:
        """The full report (K1), without elements and canonical findings."""
        rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        shown = self.linked.drop("path", "etypes", "is_pattern")
        return {"summary": rows(self.summary)[0], "endpoints": rows(self.endpoints), "findings": rows(shown), "blind_spots": rows(self.blind_spots)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=2)

    def to_elements_json(self) -> str:
        return _json_list(self.elements)

    def to_canonical_json(self) -> str:
        return _json_list(self.canonical)

    def write(self, folder: str, canonical: bool = True, elements: bool = True) -> None:
        """Reports as JSON lines below a folder, written by the executors; for results too large for one document."""
        wanted = {"findings": self.linked.drop("path", "etypes"), "endpoints": self.endpoints, "blind_spots": self.blind_spots, "summary": self.summary}
        wanted |= {"canonical": self.canonical} if canonical else {}
        wanted |= {"elements": self.elements} if elements else {}
        for name, df in wanted.items():
            df.write.mode("overwrite").json(f"{folder}/{name}")

    def to_text(self) -> str:
        """The summary, what was cut, endpoints and findings as text (K4)."""
        report = self.to_dict()
        s = report["summary"]
        cut = s.pop("truncated_categories") or {}
        out = [", ".join(f"{k.replace('_', ' ')}: {v}" for k, v in s.items())]
        out += [f"cut: {n} more of {c}" for c, n in sorted(cut.items())]
        out += [f"{','.join(e['methods'] or ['ANY'])} {e['route']} -> {e['handler']} ({e['file_path']}:{e['line']})" for e in report["endpoints"]]
        for f in report["findings"]:
            clean = " [sanitized]" if f["sanitized"] else ""
            out.append(f"[{f['severity']}] {f['vuln_type']}{clean}: {f['source']['file_path']}:{f['source']['line']} -> {f['sink']['file_path']}:{f['sink']['line']}")
            out += [f"    {i}. {c['function']} ({c['file_path']}:{c['line']}) {(c['code'] or '')[:80]}" for i, c in enumerate(f["call_chain"] or [], 1)]
        return "\n".join(out)


def _json_list(df: DataFrame) -> str:
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()], ensure_ascii=False, indent=2)


def scan_files(files: DataFrame, rules: DataFrame, language: str | None = None, framework: str | None = None, max_findings_per_category: int = S.PER_CATEGORY, include_blind_spots: bool = True, cache: str | None = None, severity_overrides: dict[str, str] | None = None, container_bridge: bool = False, state_bridge: bool = False) -> ScanResult:
    """The scan of files(path, content, language). ``rules`` may hold several languages; those of the scanned one count.
    OpenAPI documents (language 'openapi') are read along where connexion is among the frameworks."""
    sources = files.where("language <> 'openapi'")
    language = language or Files.dominant(sources)
    names = (framework,) if framework else frameworks.DEFAULTS.get(language, ())
    for name in names:
        frameworks.get_extractor(name)
    wanted = files.where((F.col("language") == language) | (F.lit("connexion" in names) & (F.col("language") == "openapi")))
    facts = parse_files(wanted, names) if cache is None else cached_facts(wanted, cache, names)
    tables = FactTables(facts)
    paths = durable(sources.where(F.col("language") == language).select("path"), "paths")
    own = rules.where(F.col("language") == language)
    return ScanResult(tables, paths, own, language, include_blind_spots, max_findings_per_category, severity_overrides, container_bridge, state_bridge)


def scan(spark: SparkSession, directory: str, language: str | None = None, framework: str | None = None, max_findings_per_category: int = S.PER_CATEGORY, include_blind_spots: bool = True, use_cache: bool = False, severity_overrides: dict[str, str] | None = None, rules_paths: list[str] | None = None, *, cache: str | None = None, enable_container_bridge: bool = False, enable_state_bridge: bool = False) -> ScanResult:
    """Scans the source files below a directory that all executors can read.

    language: default is that of most files. framework: one extractor by name instead of the language's own. use_cache
    keeps parsed facts in the folder ``cache``; labels are always made anew. A directory without sources raises."""
    if use_cache and cache is None:
        raise ValueError("use_cache needs a folder: cache=...")
    files = Files.scan(spark, directory)
    return scan_files(files, load_rules(spark, rules_paths), language, framework, max_findings_per_category, include_blind_spots, cache if use_cache else None, severity_overrides, enable_container_bridge, enable_state_bridge)


