"""From files to fact tables: one pass of the parsers, and a cache of what was parsed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspar import schema as S
from flowspar.parse import frameworks, java, javascript, python
from flowspar.parse.model import FACTS, FIELDS, Facts
from flowspar.sources.durable import place, unsent

VERSION = "1"  # of the facts; part of the cache's key
PARSERS = {"python": python.parse, "java": java.parse, "javascript": javascript.parse}
_ROWS = 20_000


def decode(content: bytes | None) -> str:
    """UTF-8, or Latin-1 where that fails."""
    raw = content or b""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_text(path: str, text: str, language: str, names: tuple[str, ...] | None = None) -> list[dict]:
    """The facts of one source text. An unknown language raises; a file that a parser fails on gives an error row."""
    if language == "openapi":
        facts = Facts(path, language)
        frameworks.openapi(facts, text)
        return facts.rows
    if language not in PARSERS:
        raise ValueError(f"no parser for {language!r}")
    facts = Facts(path, language)
    try:
        PARSERS[language](text, facts)
        for name in frameworks.DEFAULTS[language] if names is None else names:
            if name != "connexion":
                frameworks.get_extractor(name)(facts, text)
    except (RecursionError, IndexError, KeyError) as wrong:
        facts.add("error", text=f"{type(wrong).__name__}: {wrong}"[:200], line=0)
    return facts.rows


def _kinds() -> list[pa.DataType]:
    of = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return [of[f.split()[1]] for f in FACTS.split(", ")]


def _parse(names: tuple[str, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[f] for r in rows], k) for f, k in zip(FIELDS, kinds)], names=FIELDS)

        for batch in batches:
            held: list[dict] = []
            for i in range(batch.num_rows):
                path, content, language = (batch.column(c)[i].as_py() for c in range(3))
                held += parse_text(path, content if isinstance(content, str) else decode(content), language, names)
                if len(held) > _ROWS:
                    yield made(held)
                    held = []
            yield made(held)

    return run


def parse_files(files: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Fact rows of files(path, content, language); content is binary or text. names: framework extractors to run
    (default: those of the language). Few files of a table may hold many sources, so these are spread over all tasks."""
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content", "language").repartition(tasks, "path").mapInArrow(_parse(names), FACTS)


def cached_facts(files: DataFrame, folder: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """``parse_files`` with a cache: facts of files whose path, content and parser version are known are read, the others
    are parsed and added. Labels are no part of it, so rules may change."""
    spark = files.sparkSession
    key = F.sha2(F.concat_ws("|", F.lit(f"{VERSION}|{names}"), "path", F.sha2("content", 256)), 256)
    keyed = files.withColumn("key", key)
    held = _stored(spark, folder)
    fresh = keyed if held is None else keyed.join(held.select("key").distinct(), "key", "left_anti")
    made = fresh.select("path", "content", "language", "key")
    rows = parse_files(made, names).join(made.select(F.col("path").alias("file_path"), "key"), "file_path")
    seen = made.select(F.lit("file").alias("kind"), F.col("path").alias("file_path"), "language", "key")
    rows.unionByName(seen, allowMissingColumns=True).write.mode("append").partitionBy("kind").parquet(folder)
    return _stored(spark, folder).join(keyed.select("key"), "key", "left_semi").where("kind <> 'file'").select(*FIELDS)


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(FACTS + ", key string").parquet(folder)


class FactTables:
    """The fact tables by kind, over one written table that is partitioned by kind."""

    def __init__(self, facts: DataFrame) -> None:
        spark = facts.sparkSession
        path = place(spark, "facts")
        facts.write.partitionBy("kind").parquet(path)
        self._all = unsent(spark.read.schema(FACTS).parquet(path))

    def rows(self, kind: str) -> DataFrame:
        return self._all.where(F.col("kind") == kind).drop("kind")

    def functions(self) -> DataFrame:
        return self.rows("function").select("file_path", "language", "name", F.col("line").alias("start_line"), "end_line", "class_name", F.col("flag").alias("is_method"), F.col("items").alias("params"), F.col("marks").alias("decorators"), F.col("extra").alias("signature"), F.col("text").alias("source"), "seq")

    def params(self) -> DataFrame:
        return self.rows("param").select("file_path", "language", "function", "name", F.col("n").alias("param_index"), "line", F.col("text").alias("segment"), "seq")

    def classes(self) -> DataFrame:
        return self.rows("class").select("file_path", "name", F.col("line").alias("start_line"), "end_line", F.col("items").alias("bases"), F.col("marks").alias("decorators"))

    def imports(self) -> DataFrame:
        return self.rows("import").select("file_path", "language", F.col("name").alias("module"), F.col("items").alias("names"), F.col("extra").alias("alias"), F.col("flag").alias("is_relative"), "line")

    def calls(self) -> DataFrame:
        return self.rows("call").select("file_path", "language", F.col("function").alias("caller"), F.col("name").alias("callee"), "line", "end_line", F.col("text").alias("expression"), F.col("items").alias("call_args"), F.col("extra").alias("receiver"), F.col("flag").alias("is_method"), "seq")

    def defs(self) -> DataFrame:
        return self.rows("def").select("file_path", "language", "function", F.col("name").alias("var_name"), "line", "end_line", "text", F.col("flag").alias("is_param"), F.coalesce(F.col("extra") == "each", F.lit(False)).alias("enhanced_for"), F.col("n").alias("fn_line"), "seq")

    def uses(self) -> DataFrame:
        return self.rows("use").select("file_path", "language", "function", F.col("name").alias("var_name"), "line", F.col("n").alias("fn_line")).distinct()

    def blocks(self) -> DataFrame:
        return self.rows("block").select(F.col("name").alias("block_id"), "file_path", "language", "function", F.col("line").alias("start_line"), "end_line", F.col("items").alias("statements"), F.col("extra").alias("block_type"), F.col("n").alias("block_index"), "seq")

    def cfg_edges(self) -> DataFrame:
        return self.rows("cfg").select("file_path", "function", F.col("name").alias("src"), F.col("extra").alias("dst"), F.col("text").alias("kind"), "seq")

    def slots(self) -> DataFrame:
        return self.rows("slot").select("file_path", "class_name", F.col("name").alias("slot")).distinct()

    def field_types(self) -> DataFrame:
        return self.rows("field").select("file_path", F.col("name").alias("field"), F.col("text").alias("type_name")).distinct()

    def errors(self) -> DataFrame:
        return self.rows("error").select("file_path", "line", F.col("text").alias("message"))

    def _bodies(self, kind: str) -> DataFrame:
        rows = self.rows(kind).select("file_path", "language", F.col("name").alias("handler"), "extra", "line", F.from_json("text", S.ENDPOINT_BODY).alias("b"))
        return rows.select("file_path", "language", "handler", "extra", "line", "b.*")

    def endpoints(self, names: tuple[str, ...] | None = None) -> DataFrame:
        """All endpoints: those of single files, Django's URL entries with their views (J23: by the last part of the
        view's name, below the folder of the URL file; the first view by path and line), and OpenAPI operations with
        their handlers (J24: the module's path is a suffix of the file's, and the file defines the function)."""
        columns = ["route", "methods", "handler", "file_path", "line", "params", "auth_required", "auth_decorators", "framework", "source_lines"]
        single = self._bodies("endpoint").select(columns)
        views = self._bodies("view").withColumn("_dir", F.regexp_replace("file_path", "/?[^/]*$", ""))
        urls = self.rows("url").select(F.col("file_path").alias("_url_file"), F.col("name").alias("handler"), F.col("text").alias("_route"), F.col("line").alias("_at"))
        urls = urls.withColumn("_url_dir", F.regexp_replace("_url_file", "/?[^/]*$", ""))
        near = F.when(F.col("_dir") == F.col("_url_dir"), 0).otherwise(1)
        hit = urls.join(views, "handler").withColumn("_near", near)
        best = hit.groupBy("_url_file", "_at", "_route", "handler").agg(F.min_by(F.struct("file_path", "line", "methods", "auth_required", "auth_decorators", "source_lines"), F.struct("_near", "file_path", "line")).alias("v"))
        inside = F.transform(F.regexp_extract_all("_route", F.lit(r"<(?:\w+:)?(\w+)>|\(\?P<(\w+)>"), F.lit(0)), lambda x: F.regexp_extract(x, r"(\w+)>$", 1))
        params = F.transform(inside, lambda x: F.struct(x.alias("name"), F.lit("path").alias("source"), F.lit("").alias("type_hint"), F.lit(True).alias("required")))
        shown = best.select(F.col("_route").alias("route"), "v.methods", "handler", "v.file_path", "v.line", params.alias("params"), "v.auth_required", "v.auth_decorators", F.lit("django").alias("framework"), "v.source_lines")
        functions = self.functions().select("file_path", F.col("name").alias("handler"), F.col("start_line").alias("_line"))
        operations = self._bodies("operation").drop("file_path", "line").join(functions, "handler")
        suffix = F.concat(F.lit("/"), F.col("extra"), F.lit(".py"))
        matched = operations.where((F.col("extra") == "") | F.concat(F.lit("/"), F.col("file_path")).endswith(suffix))
        spec = matched.groupBy("route", "methods", "handler").agg(F.min_by(F.struct("file_path", F.col("_line").alias("line"), "params", "auth_required", "auth_decorators", "framework", "source_lines"), F.struct(F.length("file_path"), "file_path", "_line")).alias("o"))
        declared = spec.select("route", "methods", "handler", "o.*").select(columns)
        return single.unionByName(shown).unionByName(declared).distinct()

