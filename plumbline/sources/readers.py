"""Sources: CSV and TSV of strings, JSON lines, wrapped JSON, Excel; split discovery; row numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

EXTENSIONS = (".jsonl", ".json", ".csv", ".tsv")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", schema: T.StructType | None = None) -> DataFrame:
    """All columns as strings, empty fields as ''. Tabs for .tsv; RFC 4180 quotes, newlines in fields; a byte order mark is dropped."""
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', sep=sep, encoding=encoding, inferSchema=False, enforceSchema=False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c.lstrip("\ufeff")) for c in df.columns])


class BadRecord(ValueError):
    """A line that isn't a record, with its file and text."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, skip_invalid: bool = False, blank_is_error: bool = False) -> DataFrame:
    """One JSON object a line. A line that isn't one raises BadRecord, or is left out if skip_invalid. Blank lines are skipped or an error."""
    lines = spark.read.option("lineSep", "\n").text(path)
    stripped = F.btrim(F.col("value"), F.lit(" \t\r\ufeff"))
    # a parser stops at the first value's end; what is one value stays one within an array and within an object
    alone = F.try_parse_json(F.concat(F.lit("["), stripped, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), stripped, F.lit("}"))).isNotNull()
    bad = (stripped != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json(stripped)).startswith("OBJECT") & alone, F.lit(False))
    if blank_is_error:
        bad = bad | (stripped == "")
    if not skip_invalid:
        first = lines.where(bad).select(F.input_file_name().alias("f"), "value").limit(1).collect()
        if first:
            raise BadRecord(f"{first[0].f}: {first[0].value[:200]!r} is not a JSON object")
    good = lines.where((stripped != "") & ~bad).select(stripped.alias("value"))
    if schema is None:  # the columns of all good lines, and of no other
        strings = getattr(good._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(spark._jsparkSession.read().json(strings), spark)
    return good.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or an object with such an array as data, examples or records (the first that there is)."""
    df = spark.read.option("multiLine", True).json(path)
    for c in ("data", "examples", "records"):
        if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType):
            return df.select(F.explode(c).alias("r")).select("r.*")
    return df


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's first sheet, on the driver; needs pandas with an Excel engine."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def read_rows(spark: SparkSession, path: str, skip_invalid: bool = False) -> DataFrame:
    """By the path's suffix."""
    suffix = path[path.rfind(".") :].lower()
    match suffix:
        case ".jsonl":
            return read_jsonl(spark, path, skip_invalid=skip_invalid)
        case ".json":
            return read_json(spark, path)
        case ".csv" | ".tsv":
            return read_csv(spark, path)
        case ".xlsx" | ".xls":
            return read_excel(spark, path)
        case ".parquet":
            return spark.read.parquet(path)
    raise ValueError(f"unknown suffix: {path}")


def find_split(spark: SparkSession, folder: str, split: str, prefix: str = "") -> str | None:
    """The first file of a split: by alias, then with the prefix before without, then by extension."""
    for alias in S.SPLIT_ALIASES.get(split, (split,)):
        for stem in ([f"{prefix}_{alias}", f"{prefix}{alias}"] if prefix else []) + [alias]:
            for extension in EXTENSIONS:
                if exists(spark, path := f"{folder.rstrip('/')}/{stem}{extension}"):
                    return path
    return None


def read_splits(spark: SparkSession, folder: str, prefix: str = "", skip_invalid: bool = False, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """All splits that there are, with the split's name as `_split`."""
    found = [read_rows(spark, p, skip_invalid).withColumn("_split", F.lit(s)) for s in splits if (p := find_split(spark, folder, s, prefix))]
    if not found:
        raise FileNotFoundError(f"no split of {splits} in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in their present order: counts by partition, then a number within each; no window over all rows."""
    ids = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = ids.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    numbered = ids.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last one."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rationale_cache(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, rationale): the last line of each sample, trimmed; an absent file is empty; a line that lacks either raises."""
    schema = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("rationale", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = with_row_index(read_jsonl(spark, path, schema))
    lacking = (F.coalesce("sample_id", F.lit("")) == "") | (F.coalesce("rationale", F.lit("")) == "")
    if rows.where(lacking).limit(1).count():
        raise BadRecord(f"{path}: a line lacks sample_id or rationale")
    return last_of_each(rows, "sample_id", "row_idx").select("sample_id", F.btrim("rationale").alias("rationale"))


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id) of lines that have one and a rationale; empty without the file."""
    schema = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("rationale", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], "sample_id string")
    return read_jsonl(spark, path, schema, skip_invalid=True).where("sample_id <> '' and rationale <> ''").select("sample_id").distinct()
