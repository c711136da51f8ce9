"""Rule tables: YAML in, rules(language, section, category, pattern, ord) out."""

from __future__ import annotations

import warnings
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULES = "language string, section string, category string, pattern string, src int, ord int"
BUILT_IN = Path(__file__).parent.parent / "rules"


def rule_files(paths: list[str] | None) -> list[Path]:
    """The built-in files, then the given ones; a folder gives its .yaml, then its .yml files, by name."""
    out = sorted(BUILT_IN.glob("*.yaml"))
    for p in map(Path, paths or []):
        if p.is_dir():
            out += sorted(p.glob("*.yaml")) + sorted(p.glob("*.yml"))
        elif p.exists():
            out.append(p)
        else:
            warnings.warn(f"no rule file {p}", stacklevel=2)
    return out


def rule_rows(files: list[Path]) -> list[tuple]:
    """One row for each pattern. Bodies that aren't lists are left out with a warning."""
    import yaml

    rows = []
    for src, path in enumerate(files):
        for language, sections in (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).items():
            for section, body in (sections or {}).items():
                groups = body.items() if isinstance(body, dict) else [("", body)]
                for category, patterns in groups:
                    if not isinstance(patterns, list):
                        if patterns is not None:
                            warnings.warn(f"{path.name}: {language}.{section}.{category} is no list", stacklevel=2)
                        continue
                    for pattern in map(str, patterns):
                        rows.append((str(language), section, str(category), pattern, src, len(rows)))
    return rows


def merge_rules(rules: DataFrame) -> DataFrame:
    """Rules of several files (src, ord): each pattern once in its category, the earliest; place counts in order."""
    keys = [c for c in ("language", "section", "category") if c in rules.columns]
    first = Window.partitionBy(*keys, "pattern").orderBy("src", "ord")
    kept = rules.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("src", "ord", "pattern")))


def valid_expression(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark's own expressions (Java's) take the pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def load_rules(spark: SparkSession, paths: list[str] | None = None, language: str | None = None) -> DataFrame:
    """The merged rule table, of one language if given. Exclusions that are no valid expression are left out with a warning."""
    held = []
    for row in rule_rows(rule_files(paths)):
        if row[1] == "sink_excludes" and not valid_expression(spark, row[3]):
            warnings.warn(f"invalid expression {row[3]!r}", stacklevel=2)
            continue
        held.append(row)
    rows = spark.createDataFrame(held, RULES)
    rows = rows if language is None else rows.where(F.col("language") == language)
    return merge_rules(rows).select("language", "section", "category", "pattern", F.col("place").alias("ord"))


def fingerprint(df: DataFrame, keys: list[str], entry: str) -> DataFrame:
    """(keys, fingerprint): number of a group's entries, and the sum of 60 bits of the SHA-256 of each. It doesn't depend on
    their order, and partial sums are all that is shuffled."""
    one = F.conv(F.substring(F.sha2(entry, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.concat_ws("-", F.count(entry).cast("string"), F.coalesce(F.sum(one), F.lit(0)).cast("decimal(38,0)").cast("string")).alias("fingerprint"))
