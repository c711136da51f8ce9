"""Source trees, lines, manifests and expected results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspar.functions import text as T


_GLOB = "*.{py,pyi,js,jsx,mjs,cjs,java,PY,JS,JAVA,yml,yaml,json}"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, language) of every source file below root, path relative to it, without hidden parts. OpenAPI
    documents (openapi*, swagger*, or below openapi_specs/) have the language 'openapi'. Other names are never opened."""
    base = root.rstrip("/") or "/"
    at = base if "://" in base else "file:" + base
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _GLOB).load(base).select(F.regexp_replace("path", r"^file:/+", "file:/").alias("full"), "content")
    rel = files.withColumn("path", F.substring(F.col("full"), len(at) + 2, 1 << 20))
    spec = F.lower("path").rlike(r"(^|/)((openapi|swagger)[^/]*|openapi_specs/[^/]+)\.(ya?ml|json)$")
    named = rel.withColumn("language", F.when(spec, "openapi").otherwise(T.language("path")))
    return named.where(F.col("language").isNotNull() & ~T.hidden("path")).select("path", "content", "language")


def dominant(files: DataFrame) -> str:
    """The language of most files."""
    row = files.groupBy("language").count().orderBy(F.desc("count"), "language").first()
    if row is None:
        raise ValueError("no source files")
    return row["language"]


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text): lines counted from 1, stripped."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "_t")).select(key, (F.col("_n") + 1).alias("line"), F.trim(F.col("_t"), F.lit(" \t\n\r")).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(category, id, name, severity, cwe, status, needs_llm, reason) of a phase-3 manifest; no rows if it is missing."""
    schema = "categories array<struct<name:string,items:array<struct<id:string,name:string,severity:string,cwe:string,phase12_coverage:struct<status:string>,phase3_needed:struct<llm:boolean,reason:string,llm_approach:string>>>>>"
    try:
        raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    except Exception as missing:  # the path doesn't exist: no manifest
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raw = spark.createDataFrame([], schema)
    item = raw.select(F.explode("categories").alias("c")).select(F.col("c.name").alias("category"), F.explode("c.items").alias("i"))
    return item.select("category", "i.id", "i.name", "i.severity", "i.cwe", F.col("i.phase12_coverage.status").alias("status"), F.col("i.phase3_needed.llm").alias("needs_llm"), F.col("i.phase3_needed.reason").alias("reason"))


def expected(spark: SparkSession, path: str) -> DataFrame:
    """(test, category, vulnerable, cwe) of an expected-results CSV; '#' lines are comments."""
    return spark.read.option("comment", "#").schema("test string, category string, vulnerable boolean, cwe string").csv(path)
