"""Which files an import means, and which functions a call may reach: equi-joins on paths, folders and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspar.functions import text as T
from flowspar.operators.match import first_by

_SCRIPT = (".js", ".jsx", ".mjs", ".cjs", "/index.js", "")


def virtual_imports(imports: DataFrame, field_types: DataFrame, functions: DataFrame) -> DataFrame:
    """imports and, as further ones, the types of fields that aren't imported (U5, F16): (file_path, language, module, name,
    alias, is_relative)."""
    named = imports.select("file_path", "language", "module", F.explode_outer("names").alias("name"), "alias", "is_relative")
    languages = functions.select("file_path", "language").distinct()
    fields = field_types.join(languages, "file_path").select("file_path", "language", F.col("type_name").alias("module"), F.lit(None).cast("string").alias("name"), F.col("field").alias("alias"), F.lit(False).alias("is_relative"))
    known = named.select("file_path", F.coalesce("name", F.substring_index("module", ".", -1)).alias("module")).distinct()
    return named.unionByName(fields.join(known, ["file_path", "module"], "left_anti").select(named.columns))


def _ancestors(folder: Column) -> Column:
    """The folder itself, its parent, and so on to ''."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(""))))


def _joined(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module, name, alias, target): the file that each import means (J6); files(path).

    A relative import is looked up where it points; an absolute Python one in the importer's folder, then in each parent.
    Failing that, files whose path ends in the module's path are taken, the shortest first (ties: by path). No file
    system is asked. In 'from a import b', a/b wins over a."""
    here = imports.withColumn("_dir", T.parent("file_path")).withColumn("_id", F.xxhash64("file_path", "module", F.coalesce("name", F.lit("")), F.coalesce("alias", F.lit(""))))
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    plain = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    up = F.when(dots > 0, F.element_at(_ancestors(F.col("_dir")), F.least(dots, F.size(_ancestors(F.col("_dir"))))))
    bases = F.when(dots > 0, F.array(up)).otherwise(_ancestors(F.col("_dir")))
    inner = F.when(F.col("name").isNotNull() & (F.col("name") != "*"), F.when(plain == "", F.col("name")).otherwise(F.concat(plain, F.lit("/"), F.col("name"))))
    stems = F.array_compact(F.array(inner, F.when(plain != "", plain)))
    python = F.flatten(F.transform(bases, lambda b: F.flatten(F.transform(stems, lambda s: F.array(F.concat(_joined(b, s), F.lit(".py")), F.concat(_joined(b, s), F.lit("/__init__.py")), F.concat(_joined(b, s), F.lit(".pyi")))))))
    path = _joined(F.col("_dir"), F.regexp_replace(F.regexp_replace("module", r"^\./", ""), r"/$", ""))
    for _ in range(8):  # x/../ goes, up to eight times
        path = F.regexp_replace(path, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    script = F.when(F.col("is_relative"), F.array(*(F.concat(path, F.lit(e)) for e in _SCRIPT)))
    exact = F.when(F.col("language") == "python", python).when(F.col("language") == "javascript", script)
    wanted = here.select("_id", "file_path", "module", "name", "alias", F.posexplode(F.coalesce(exact, F.array().cast("array<string>"))).alias("_rank", "path"))
    hit = wanted.join(files.select("path"), "path").where("path <> file_path").groupBy("_id", "file_path", "module", "name", "alias").agg(F.min_by("path", "_rank").alias("target"))
    rest = here.where(~F.coalesce("is_relative", F.lit(False))).join(hit.select("_id"), "_id", "left_anti")
    java = F.col("language") == "java"
    tail = F.when(java, F.regexp_replace(plain, r"/\*$", "")).otherwise(F.coalesce(F.when(inner.isNotNull(), plain), plain))
    rest = rest.withColumn("_tail", tail).where("_tail <> ''")
    known = files.select("path", T.stem("path").alias("_stem"), F.regexp_replace("path", r"\.[^./]*$", "").alias("_bare"), T.language("path").alias("language"))
    by_stem = rest.withColumn("_stem", T.base_name("_tail")).join(known, ["_stem", "language"]).where((F.col("_bare") == F.col("_tail")) | F.col("_bare").endswith(F.concat(F.lit("/"), F.col("_tail")))).where("path <> file_path")
    loose = first_by(by_stem, ["_id"], [F.length("path"), "path"]).select("_id", "file_path", "module", "name", "alias", F.col("path").alias("target"))
    folder = known.where("language = 'java'").withColumn("_folder", T.parent("path"))
    star = rest.where(java & (F.col("name") == "*")).withColumn("_leaf", T.base_name("_tail")).join(folder.withColumn("_leaf", T.base_name("_folder")).select("path", "_folder", "_leaf"), "_leaf")
    star = star.where((F.col("_folder") == F.col("_tail")) | F.col("_folder").endswith(F.concat(F.lit("/"), F.col("_tail")))).where("path <> file_path").select("_id", "file_path", "module", "name", "alias", F.col("path").alias("target"))
    return hit.select(loose.columns).unionByName(loose).unionByName(star).drop("_id").distinct()


def resolve_calls(calls: DataFrame, functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(call_id, target_file): the files whose function of that name each call may reach.

    A function of the same file wins. Else the files count that the caller's imports lead to, or, for Java, that lie in
    its folder; of these only the ones that the receiver's alias means, if the alias means one module and that has
    the function. calls: call_id, file_path, callee, receiver, language."""
    known = functions.select(F.col("file_path").alias("target_file"), F.col("name").alias("callee")).distinct()
    local = calls.join(known, (calls["file_path"] == known["target_file"]) & (calls["callee"] == known["callee"]), "left_semi").select("call_id", F.col("file_path").alias("target_file"))
    rest = calls.join(local, "call_id", "left_anti")
    reach = resolved.select("file_path", F.col("target").alias("target_file")).distinct()
    imported = rest.join(reach, "file_path").join(known, ["target_file", "callee"]).select("call_id", "file_path", "receiver", "target_file")
    folder = known.where(F.col("target_file").endswith(".java")).withColumn("_dir", T.parent("target_file"))
    near = rest.where("language = 'java'").withColumn("_dir", T.parent("file_path")).join(folder, ["_dir", "callee"]).where("target_file <> file_path").select("call_id", "file_path", "receiver", "target_file")
    every = imported.unionByName(near).distinct()
    sure = resolved.where("alias is not null").groupBy("file_path", F.col("alias").alias("receiver")).agg(F.count_distinct("module").alias("n"), F.collect_set("target").alias("_own")).where("n = 1").drop("n")
    marked = every.join(sure, ["file_path", "receiver"], "left").withColumn("_fits", F.coalesce(F.array_contains("_own", F.col("target_file")), F.lit(False)))
    any_fits = F.max("_fits").over(Window.partitionBy("call_id"))
    cross = marked.withColumn("_any", any_fits).where("_fits or not _any").select("call_id", "target_file")
    return local.unionByName(cross)
