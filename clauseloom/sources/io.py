"""Reading and writing: JSON lines, manifests, texts, word boxes, gated loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
CLAUSES = T.StructType([
    T.StructField("clause_id", _S), T.StructField("clause_title", _S), T.StructField("clause_text", _S, False), T.StructField("clause_type", _S),
    T.StructField("applies_to", T.ArrayType(_S, False)), T.StructField("waiting_period_days", _L), T.StructField("monetary_cap", _L), T.StructField("cap_basis", _S),
    T.StructField("percent_cap", _D), T.StructField("conditions_required", T.ArrayType(_S, False)), T.StructField("exclusion_code", _S), T.StructField("source_page", _L, False),
    T.StructField("insurer", _S, False), T.StructField("policy_name", _S, False), T.StructField("policy_id", _S, False), T.StructField("section", _S),
])
REQUIRED = [f.name for f in CLAUSES.fields if not f.nullable]


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, line, value): the lines of text files, blank ones left out but counted. Files are split anyhow; a line's
    number is that within its split and the lines of the splits before, of which there is one count each."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    counts = raw.groupBy("source_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("source_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = raw.join(F.broadcast(before.drop("n")), ["source_file", "_start"])  # one row for each split of a file
    return placed.select("source_file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value").where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, mode: str = "skip", default_policy: bool = False) -> DataFrame:
    """JSON lines with source_file, line (its number in the file, from 1) and seq, the same. mode: 'skip' drops lines that are
    no JSON, whose count is to be seen in `bad_lines`; 'fail' stops at one and names its file and line. Blank lines are
    nothing. A missing policy_id becomes the file's name if default_policy is set."""
    bad = T.StructType([*schema.fields, T.StructField("_bad", _S)])
    read = numbered_lines(spark, path).select("source_file", "line", "value", F.from_json("value", bad, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    if mode == "fail":
        read = read.withColumn("r", F.when(F.col("r._bad").isNotNull(), F.raise_error(F.concat_ws("", F.lit("bad JSON in "), "source_file", F.lit(":"), F.col("line").cast("string")))).otherwise(F.col("r")))
    out = read.where("r._bad is null").select("r.*", "source_file", "line", F.col("line").alias("seq")).drop("_bad")
    return out.withColumn("policy_id", F.coalesce("policy_id", "source_file")) if default_policy else out


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, bad): lines of each file that are no JSON."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file")).where(F.trim("value") != "")
    return lines.groupBy("source_file").agg(F.count_if(F.try_parse_json("value").isNull()).alias("bad"))


def read_manifests(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Run manifests, one JSON object a file, with the stem of their file."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("stem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.manifest\.json$", 1))


def without_manifest(stems: DataFrame, manifests: DataFrame) -> DataFrame:
    """Stems of data files for which there is no manifest."""
    return stems.join(manifests.select("stem"), "stem", "left_anti")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, pages: Callable[[bytes], list[tuple[int, str, list[dict]]]], glob: str = "*") -> DataFrame:
    """(path, page, text, words) of binary documents by a reader that is handed each file's bytes; readers of page
    formats are libraries of the caller's."""
    schema = "path string, page int, text string, words array<struct<x0:double,x1:double,top:double,bottom:double>>"

    def read(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            rows = [{"path": p, "page": n, "text": t, "words": w} for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, t, w in pages(c)]
            word = pa.struct([("x0", pa.float64()), ("x1", pa.float64()), ("top", pa.float64()), ("bottom", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("words", pa.list_(word))]))

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(read, schema)


def write_jsonl(df: DataFrame, path: str, provenance: list[str] = ["seq", "line", "source_file"]) -> None:  # noqa: B006
    """JSON lines without the columns of provenance; null fields are written."""
    df.drop(*provenance).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_findings(df: DataFrame, path: str, text: str = "clause_text", chars: int = 600) -> None:
    """Findings as JSON lines, their text shortened for reading."""
    write_jsonl(df.withColumn(text, F.left(text, F.lit(chars))), path)


def run_counters(df: DataFrame, **counts: Column) -> DataFrame:
    """One row of named counts over df: what a run's manifest says of it."""
    return df.agg(*[c.alias(k) for k, c in counts.items()])


def write_manifests(df: DataFrame, path: str) -> None:
    """Run manifests as JSON, one object a line, null fields written."""
    write_jsonl(df, path)


def write_log(corrections: DataFrame, path: str, columns: list[str]) -> None:
    """Corrections as JSON arrays of the given columns' values, one a line; nulls are written."""
    cells = [F.when(F.col(c).isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "")) for c in columns]
    corrections.select(F.concat(F.lit("["), F.concat_ws(", ", *cells), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks (doc, chunk, section, text, start_page, end_page) as text to read through before a model is asked."""
    head = F.format_string("=== %s chunk %d, section %s, pages %d to %d, %d characters", "doc", "chunk", "section", "start_page", "end_page", F.length("text"))
    chunks.select(F.concat_ws("\n", head, "text", F.lit("")).alias("value")).write.mode("overwrite").text(path)


def embedded_table(df: DataFrame, embed: Column, table: str, leave_out: list[str] = []) -> None:  # noqa: B006
    """Replaces table by df with its embedding, without the columns left out."""
    embedded(df, embed).drop(*leave_out).write.mode("overwrite").option("overwriteSchema", True).saveAsTable(table)


def with_dimension(df: DataFrame, rows: dict[str, tuple], key: str, schema: str) -> DataFrame:
    """df with the columns of a fixed list of documents, by key; documents that are not in it have nulls."""
    dimension = df.sparkSession.createDataFrame([(k, *v) for k, v in rows.items()], f"{key} string, {schema}")
    return df.join(F.broadcast(dimension), key, "left")  # a list written out in a program


def gated_load(df: DataFrame, findings: DataFrame, table: str, replace: bool = False) -> bool:
    """Writes df to table only if no finding blocks; says whether it did. Appends unless replace is set. Rows that lack a
    required field block as well."""
    if not findings.where("blocked").isEmpty() or not df.where(" or ".join(f"{c} is null" for c in REQUIRED if c in df.columns) or "false").isEmpty():
        return False
    df.write.mode("overwrite" if replace else "append").saveAsTable(table)
    return True


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and of old those whose key new does not have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def partition_replaced(old: DataFrame, new: DataFrame, partition: str) -> DataFrame:
    """Rows of new, and of old those of partitions that new does not have at all."""
    return upserted(old, new.select(*[c for c in new.columns]), partition) if partition in new.columns else old


def embedded(df: DataFrame, embed: Column, name: str = "embedding") -> DataFrame:
    """df with an embedding column by whatever function embed is made of; texts that give none keep null."""
    return df.withColumn(name, embed)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding(text):  # noqa: ANN001, ANN201
    """A deterministic stand-in for a model: counts of hashed words, of length one."""
    import math
    import re
    import zlib

    import pyarrow as pa

    out = []
    for t in text.to_pylist():
        v = [0.0] * 96
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % 96] += 1 if h >> 16 & 1 else -1
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else None)
    return pa.array(out, pa.list_(pa.float64()))
