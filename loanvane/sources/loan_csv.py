"""Loan files: CSV with a declared schema, and the parquet table repeat runs read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanvane.functions.names import EXTRA_LEAKAGE, NUMERIC_SHORTLIST
from loanvane.runtime import shared_folder, small_table

BAD_RECORD = "bad_record"

RECORDS_PER_FILE = 5_000_000
# Lines of a piece, as a power of two.
PIECE_BITS = 14


def declared_type(name: str) -> T.DataType:
    """Double for known amounts, rates and counts; text for everything else."""
    return T.DoubleType() if name in NUMERIC_SHORTLIST or name in EXTRA_LEAKAGE else T.StringType()


def read_loans(
    spark: SparkSession, path: str, types: Mapping[str, T.DataType] | None = None, multiline: bool = False
) -> DataFrame:
    """Read loan CSV files. Blank text and ``NA`` become NULL, blanks around values are trimmed.

    Only the header line is read to plan. Files are split into tasks at line ends; set ``multiline=True``
    for files whose text fields hold quoted line breaks, each of which is then one task.
    """
    layout = {"header": True, "escape": '"', "multiLine": multiline}
    trims = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    header = spark.read.options(**layout, **trims).csv(path).columns
    types = types or {}
    schema = T.StructType([T.StructField(n, types.get(n, declared_type(n))) for n in header])
    raw = spark.read.schema(schema).options(**layout, **trims, nullValue="NA", enforceSchema=False).csv(path)
    texts = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    cleaned = {n: F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in texts}
    return raw.withColumns({n: F.nullif(c, F.lit("NA")) for n, c in cleaned.items()}) if texts else raw


def split_records(lines: DataFrame) -> DataFrame:
    """``(record)``: CSV records of text lines, without each file's first one, its header.

    ``lines`` has ``value``, its ``file``, ``block`` (the byte where its part of the file begins) and ``at``, which rises within
    a block. Quotes inside a record are even in number, so a line starts a record where those before it in the file are. Pieces of
    some thousand lines count their quotes without moving a line; sums over pieces, a row each, tell what every piece starts with.
    Lines then move once, to their piece, which cuts them into records. Only the ends of pieces, a record or less each, move again.
    A quote that is never closed makes one record of all lines up to the next single quote.
    """
    piece = ["file", "block", "piece"]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumns({"odd": (quotes % 2).cast("long"), "piece": F.shiftright("at", PIECE_BITS)})
    sums = lines.groupBy(*piece).agg(F.sum("odd").alias("odds"))
    of_file = Window.partitionBy("file").orderBy("block", "piece")
    opened = (F.coalesce(F.sum("odds").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).alias("opened")
    pieces = small_table(sums.select(*piece, opened, (F.row_number().over(of_file) == 1).alias("first")))
    inside = Window.partitionBy(*piece).orderBy("at")
    flips = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(pieces, piece).withColumn("started", ((flips + F.col("opened")) % 2 == 0).cast("long"))
    numbered = numbered.withColumn("no", F.sum("started").over(inside))
    held = F.array_sort(F.collect_list(F.struct("at", "value")))
    text = F.concat_ws("\n", F.transform(held, lambda p: p["value"])).alias("record")
    cut = numbered.groupBy(*piece, "no").agg(text, F.bool_or(F.col("first") & (F.col("no") == 1)).alias("header"))
    cut = cut.withColumn("last", F.max("no").over(Window.partitionBy(*piece)))
    inner = (F.col("no") > 0) & (F.col("no") < F.col("last"))
    # lines before the first start of a piece go on with the last record of an earlier one
    ends = cut.filter(~inner).withColumn("started", (F.col("no") > 0).cast("long"))
    ends = ends.withColumn("of", F.sum("started").over(Window.partitionBy("file").orderBy("block", "piece", "no")))
    parts = F.array_sort(F.collect_list(F.struct("block", "piece", "no", "record")))
    joined = F.concat_ws("\n", F.transform(parts, lambda p: p["record"])).alias("record")
    ends = ends.groupBy("file", "of").agg(joined, F.bool_or("header").alias("header"))
    whole = cut.filter(inner).select("record", "header").unionByName(ends.select("record", "header"))
    return whole.filter("not header and trim(record) <> ''").select("record")


def scan_loans(spark: SparkSession, path: str, types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """Loan CSV files with ``bad_record``: the text of a record whose fields do not fit the header or a declared type, else NULL.

    Values are read as by ``read_loans``; a bad record keeps what could be read of it. Quoted line breaks may stand
    anywhere, and files still split into tasks of ``spark.sql.files.maxPartitionBytes``. All files share one header.
    """
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    header = spark.read.options(**options, header=True).csv(path).columns
    types = types or {}
    schema = T.StructType([T.StructField(n, types.get(n, declared_type(n))) for n in header])
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("at"))
    checks = {"mode": "PERMISSIVE", "nullValue": "NA", "columnNameOfCorruptRecord": BAD_RECORD}
    row = F.from_csv("record", schema.add(BAD_RECORD, "string").toDDL(), {**options, **checks})
    rows = split_records(lines).select(row.alias("row")).select("row.*")

    def shown(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        text = isinstance(field.dataType, T.StringType) and field.name != BAD_RECORD
        return F.nullif(F.nullif(F.trim(value), F.lit("")), F.lit("NA")).alias(field.name) if text else value

    return rows.select(*[shown(f) for f in schema])


@dataclass(frozen=True)
class ScanParts:
    """Rows that were read whole, the texts of the others (``bad_record``), and how many records there were of both and of the others."""

    good: DataFrame
    bad: DataFrame
    n_read: int
    n_bad: int


def part_scan(scan: DataFrame, folder: str | None = None) -> ScanParts:
    """Good and bad rows of ``scan_loans``, parted by one job that writes them and counts them as they pass."""
    spark = scan.sparkSession
    folder = folder or shared_folder(spark, "loan-scan")
    seen = Observation("loan scan")
    flagged = scan.withColumn("is_bad", F.col(BAD_RECORD).isNotNull())
    counted = flagged.observe(seen, F.count(F.lit(1)).alias("n_read"), F.count_if("is_bad").alias("n_bad"))
    counted.write.partitionBy("is_bad").parquet(folder)
    parted = spark.read.schema(flagged.schema).parquet(folder)
    columns = [f"`{c}`" for c in scan.columns if c != BAD_RECORD]
    return ScanParts(parted.filter("not is_bad").select(*columns), parted.filter("is_bad").select(BAD_RECORD), seen.get["n_read"], seen.get["n_bad"])


def write_loan_table(loans: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet table for repeat runs, partitioned by issue year when the column is there."""
    if "issue_year" in loans.columns:
        # Rebalancing brings a year's rows together and splits or joins partitions by their bytes.
        spread = loans.hint("rebalance", "issue_year")
        spread.write.mode(mode).option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy("issue_year").parquet(path)
    else:
        loans.write.mode(mode).parquet(path)


def read_loan_table(spark: SparkSession, path: str) -> DataFrame:
    """Loan parquet table; ``issue_year`` stays text as in the labelled data."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == "issue_year" else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)
