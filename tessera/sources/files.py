"""Sources and sinks: JSON arrays and lines, Parquet, database catalogs, schema prompts."""

from __future__ import annotations

import hashlib
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import batches
from tessera.sources.shared import cut

#: One table of a database's catalog.
TABLE = "db string, name string, columns array<struct<name: string, type: string>>, primary_keys array<string>, foreign_keys array<struct<column: string, ref_table: string, ref_column: string>>"


def json_array_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, idx, text)``: the objects of files that are one JSON array each, with their places.

    Files are read in pieces that end at closing braces, by as many tasks as
    there are splits. Whether a piece begins inside a string follows from the
    quotes before it, how deep it ends from the brackets outside strings
    before it; both are running sums. An object ends where one is closed right
    inside the array.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    order = ["file", "at", "n"]
    count = lambda c, x: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    pieces = pieces.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))
    pieces = batches.running(pieces, order, count('"', F.col("bare")), "quotes")
    inside = (F.col("quotes") - count('"', F.col("bare"))) % 2 == 1
    outside = F.regexp_replace(F.when(inside, F.regexp_replace("bare", r'(?s)^[^"]*("|$)', "")).otherwise(F.col("bare")), r'(?s)"[^"]*("|$)', "")
    pieces = pieces.withColumns({"outside": outside, "closes": (F.col("quotes") % 2 == 0).cast("int")})
    change = count("{", F.col("outside")) + count("[", F.col("outside")) - count("]", F.col("outside")) - F.col("closes")
    pieces = batches.running(pieces.withColumn("change", change), order, F.col("change"), "depth")
    # What stands after the last object closes nothing, which is seen as one brace too many: each file starts anew.
    starts = pieces.groupBy("file").agg(F.min_by(F.col("depth") - F.col("change"), F.struct("at", "n")).alias("base"))
    pieces = pieces.join(starts, "file").withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") - F.col("base") == 1)).cast("long"))
    numbered = batches.running(pieces.select(*order, "value", "ends"), order, F.col("ends"), "upto").withColumn("record", F.col("upto") - F.col("ends"))
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "value"))), lambda p: p["value"]), "}"), F.lit("}"))
    texts = numbered.groupBy("file", "record").agg(joined.alias("text"), F.max("ends").alias("whole")).where("whole = 1")
    first = texts.groupBy("file").agg(F.min("record").alias("first"))
    return texts.join(first, "file").select("file", (F.col("record") - F.col("first")).alias("idx"), F.regexp_replace("text", r"^[\s\x{FEFF}]*\[?\s*,?\s*", "").alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Records of a file that is one JSON array of objects, with their place in it as ``idx``.

    Names that differ in case only are different fields. The place comes from
    the array itself, not from how it is read; no task has the whole file.
    Without a schema all fields of all records are found in a pass before, as
    strings, numbers or JSON.
    """
    texts = json_array_texts(spark, path)
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        if schema is None:
            texts = cut(texts)
            found = texts.agg(F.schema_of_variant_agg(F.parse_json("text")).alias("s")).head()["s"]
            schema = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
            kind = T._parse_datatype_string(schema)
        else:
            kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return texts.select("idx", F.from_json("text", kind).alias("record")).select("idx", "record.*")
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines are left out, and a path that doesn't exist is an empty table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Appends records; an empty table writes nothing."""
    if not df.isEmpty():
        df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    """Writes records in place of what is there; a job commits as a whole."""
    df.write.mode("overwrite").json(path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files with columns by name; what a file lacks is null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def catalog(paths: DataFrame, path: str = "path") -> DataFrame:
    """Tables of SQLite files with columns, primary keys and foreign keys, one row for each table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf[path]:
                db = sqlite3.connect(f"file:{p}?mode=ro", uri=True)
                try:
                    found = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name <> 'sqlite_sequence' ORDER BY rowid")]
                    info = {t: db.execute("SELECT name, type, pk FROM pragma_table_info(?) ORDER BY cid", (t,)).fetchall() for t in found}
                    keys = {t: [n for n, _, k in sorted((c for c in info[t] if c[2]), key=lambda c: c[2])] for t in found}
                    for t in found:
                        links = db.execute('SELECT "from", "table", "to" FROM pragma_foreign_key_list(?) ORDER BY id DESC, seq', (t,)).fetchall()
                        foreign = [{"column": a, "ref_table": b, "ref_column": c or next(iter(keys.get(b, [])), None)} for a, b, c in links]
                        rows.append((p, t, [{"name": n, "type": k} for n, k, _ in info[t]], keys[t], foreign))
                finally:
                    db.close()
            yield pd.DataFrame(rows, columns=["db", "name", "columns", "primary_keys", "foreign_keys"])

    return paths.select(path).mapInPandas(run, TABLE)


def sample_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """``(column, vals)``: the n smallest different values of each column as strings, nulls left out."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x"))
    distinct = long.select("x.column", "x.v").where("v IS NOT NULL").distinct()
    from tessera.operators.pool import first_n_by_group

    return first_n_by_group(distinct, "column", ["v"], n).groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("vals"))


def comment(note: Column, values: Column) -> Column:
    """A column's note and examples; null without both."""
    examples = F.when(F.size(values) > 0, F.concat(F.lit("Examples: "), F.array_join(values, ", ")))
    return X.or_null(F.concat_ws("; ", note, examples))


def ddl(name: Column, columns: Column, primary_keys: Column) -> Column:
    """A CREATE TABLE statement with quoted names, comments and primary key."""
    line = lambda c: F.concat(F.lit("`"), c["name"], F.lit("` "), c["type"], F.coalesce(F.concat(F.lit(" /*"), c["comment"], F.lit("*/")), F.lit("")))
    keys = F.when(F.size(primary_keys) > 0, F.array(F.concat(F.lit("PRIMARY KEY ("), F.array_join(F.transform(primary_keys, lambda k: F.concat(F.lit("`"), k, F.lit("`"))), ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("CREATE TABLE `"), name, F.lit("` (\n  "), F.array_join(F.concat(F.transform(columns, line), keys), ",\n  "), F.lit("\n);"))


def flatten(schema: T.StructType, separator: str = "/", prefix: str = "") -> list[Column]:
    """Columns for all leaves of nested structs, named by their way there."""
    out = []
    for f in schema.fields:
        name = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += flatten(f.dataType, separator, name)
        else:
            out.append(F.col(name).alias(name.replace(".", separator)))
    return out


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder between any stores that Spark's file systems know; what is at the target is replaced."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(target)
    b.getFileSystem(conf).delete(b, True)
    if not hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"{source} could not be copied to {target}")


def manifest(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names under a path, and their sizes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system, out = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    root = system.makeQualified(root)
    found = system.listFiles(root, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()[len(root.toString()) :]
        if not name.endswith(".crc"):
            out.append((name, f.getLen()))
    return sorted(out)


def stage(spark: SparkSession, source: str, cache: str, always: bool = False) -> str:
    """The place of a copy of ``source`` in a cache, by a hash of its path; it is made anew where names or sizes differ."""
    target = f"{cache}/{hashlib.md5(source.encode()).hexdigest()}/{source.rstrip('/').rsplit('/', 1)[-1]}"
    there = spark._jvm.org.apache.hadoop.fs.Path(target)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    if always or not exists or manifest(spark, source) != manifest(spark, target):
        copy(spark, source, target)
    return target


def schema_map(entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``(key, value)``: of entries that repeat a key the last by ``order`` counts."""
    return entries.groupBy(key).agg(F.max_by(value, order).alias(value))


def with_schema(rows: DataFrame, db: str, schemas: DataFrame, key: str, schema: str, error: str = "unknown database") -> DataFrame:
    """Rows with their database's ``schema``; ``error`` says that there is none."""
    known = schemas.select(F.col(key).alias("__key"), F.col(schema), F.lit(True).alias("__known"))
    joined = rows.join(known, F.col(db) == F.col("__key"), "left")
    return joined.withColumn("error", F.when(F.col("__known").isNull(), error)).drop("__key", "__known")


def by_key(key: str, *tables: DataFrame) -> DataFrame:
    """Tables that hold the same keys side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key)
    return out


def ordered_lists(rows: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """``(group, values...)``: lists in order, for groups that are bounded by what they are (a prompt's responses, a chat's turns)."""
    got = F.array_sort(F.collect_list(F.struct(order, *values))).alias("__x")
    return rows.groupBy(group).agg(got).select(group, *[F.col(f"__x.{v}").alias(v) for v in values])
