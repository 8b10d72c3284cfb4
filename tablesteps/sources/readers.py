"""Readers: delimited text, tables, parameterised reads, nested JSON, file catalogue, call trace."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Call-trace record.
TRACE_SCHEMA = (
    "at STRING, task STRING, output_model STRING, prompt_hash STRING, user_chars BIGINT, model STRING, "
    "outcome STRING, attempts BIGINT, duration_ms BIGINT, usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, "
    "cache_read_input_tokens: BIGINT, cache_creation_input_tokens: BIGINT>, cost_usd DOUBLE, _corrupt_record STRING"
)

#: What a missing cell is read as before it becomes NULL: a code point that Unicode keeps out of texts.
_NO_CELL = "\uffff"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """``UTF-8``, or ``ISO-8859-1`` when some line is not valid UTF-8.

    The text source keeps bytes as they are; the scan stops at the first bad line.
    """
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    infer: bool = False,
    multiline: bool = False,
    keep_empty: bool = False,
) -> DataFrame:
    """CSV/TXT with ``,`` and TSV with a tab unless ``sep`` says otherwise; header row.

    Without a schema every column is text (``infer`` scans for types). A byte-order mark is dropped.
    ``multiline`` keeps line breaks inside quoted cells; such files do not split over tasks. Without it a
    line break ends the row even inside quotes. ``keep_empty`` takes a quoted cell without content for an
    empty text; otherwise it is missing, as an empty cell without quotes always is.
    """
    if sep is None:
        sep = "\t" if path.rstrip("/").lower().endswith(".tsv") else ","
    reader = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("encoding", encoding or detect_encoding(spark, path))
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    if keep_empty:
        reader = reader.option("nullValue", _NO_CELL)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_reference(spark: SparkSession, path: str, sep: str = ";", **options) -> DataFrame:
    """A reference file for a reconciliation: ``;`` between cells unless said otherwise."""
    return read_delimited(spark, path, sep=sep, **options)


def read_table(spark: SparkSession, name: str, conn: Mapping[str, str] | None = None) -> DataFrame:
    """A parquet path, a catalog table ``schema.table``, or a JDBC table when ``conn`` has a url."""
    if conn and conn.get("url"):
        return spark.read.format("jdbc").options(dbtable=name, **conn).load()
    if "/" in name or name.endswith(".parquet"):
        return spark.read.parquet(name)
    return spark.table(name)


def cast_params(params: Mapping[str, object]) -> dict[str, object]:
    """Numeric texts become numbers, other values stay as they are."""
    out: dict[str, object] = {}
    for key, value in params.items():
        if isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value.strip()):
            value = int(value)
        elif isinstance(value, str) and re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", value.strip()):
            value = float(value)
        out[key] = value
    return out


def _require(names: set[str], params: Mapping[str, object]) -> None:
    lacking = sorted(n for n in names if params.get(n) is None)
    if lacking:
        raise ValueError(f"parameters without a value: {', '.join(lacking)}")


def read_where(spark: SparkSession, table: DataFrame | str, where: str, params: Mapping[str, object]) -> DataFrame:
    """``SELECT * FROM t WHERE a = :p``: values are bound, never put into the text.

    A parameter without a value fails by name before anything is read. The predicate reaches the
    parquet or JDBC scan.
    """
    bare = re.sub(r"'(?:[^']|'')*'", "''", where)
    names = set(re.findall(r"(?<!:):([A-Za-z_]\w*)", bare))
    _require(names, params)
    source = read_table(spark, table) if isinstance(table, str) else table
    bound = {n: v for n, v in cast_params(params).items() if n in names}
    return spark.sql(f"SELECT * FROM {{source}} WHERE {where}", args=bound, source=source)


def read_table_named(spark: SparkSession, template: str, params: Mapping[str, object]) -> DataFrame:
    """A table whose name holds parameters (``BD_R&ANIO&TRIM``).

    Parameters may form the identifier only; anything but letters, digits and ``_`` is refused.
    """
    names = set(re.findall(r"&(\w+)\.?", template))
    _require(names, params)
    for n in names:
        if not re.fullmatch(r"\w+", str(params[n])):
            raise ValueError(f"parameter {n} is not part of an identifier")
    name = re.sub(r"&(\w+)\.?", lambda m: str(params[m[1]]), template)
    return spark.sql("SELECT * FROM IDENTIFIER(:t)", args={"t": name})


def json_flatten(df: DataFrame, col: str, schema: str | T.DataType, path: str | None = None) -> DataFrame:
    """JSON text to flat columns: parse, walk to ``path`` (dotted), explode an array, expand the struct.

    A row whose array is empty or missing stays, with missing values.
    """
    kept = [c for c in df.columns if c != col]
    out = df.withColumn("_j", F.from_json(col, schema))
    at = F.col(f"_j.{path}") if path else F.col("_j")
    out = out.select(*kept, at.alias("_j"))
    if isinstance(out.schema["_j"].dataType, T.ArrayType):
        out = out.select(*kept, F.explode_outer("_j").alias("_j"))
    if isinstance(out.schema["_j"].dataType, T.StructType):
        return out.select(*kept, "_j.*")
    return out.withColumnRenamed("_j", (path or "value").split(".")[-1])


def file_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder`` -> (path, name, stem, type, bytes), sorted by path; contents unread."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("type"),
        F.col("length").alias("bytes"),
    ).orderBy("path")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines; lines that do not parse are left to ``trace_rejects``, the rest is kept."""
    raw = spark.read.schema(TRACE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record").withColumn("at", F.col("at").try_cast("timestamp"))


def trace_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_trace`` leaves out -> (file, line). One torn last line is normal, more are not."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).filter("trim(line) <> ''")
    parsed = F.from_json("line", TRACE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("_bad", parsed["_corrupt_record"]).filter("_bad IS NOT NULL").select("file", "line")
