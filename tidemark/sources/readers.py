"""Sources: rows, generators, counters, records of fixed width, text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_rows(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def counter(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """v = start, start + 1, ...: n of them, as a frame must end."""
    return spark.range(start, start + n).withColumnRenamed("id", "v")


def generate(spark: SparkSession, n: int, value: Column) -> DataFrame:
    """idx and value (an expression of idx), n rows."""
    return spark.range(n).withColumnRenamed("id", "idx").withColumn("v", value)


def decode_records(data: DataFrame, content: str, fields: dict[str, int]) -> DataFrame:
    """idx and fields of little-endian unsigned records laid end to end in a binary column; a short last record is dropped."""
    width = sum(fields.values())
    n = F.floor(F.length(content) / width).cast("int")
    # One digit string for a record, bytes reversed, so that each field reads as a plain number.
    at = data.where(n > 0).select(F.col(content).alias("_c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    out, offset = [F.col("idx").cast("bigint").alias("idx")], 0
    for name, size in fields.items():
        raw = F.concat(*(F.expr(f"hex(substring(_c, idx * {width} + {offset + size - k}, 1))") for k in range(size)))
        out.append(F.conv(raw, 16, 10).cast("bigint").alias(name))
        offset += size
    return at.select(*out)


def read_records(spark: SparkSession, path: str, fields: dict[str, int]) -> DataFrame:
    """Records of a file or folder of files."""
    return decode_records(spark.read.format("binaryFile").load(path), "content", fields)


def encode_record(fields: dict[str, int]) -> Column:
    """The fields (columns by name) as one little-endian record."""
    digits = [F.lpad(F.hex(F.col(name).cast("bigint")), size * 2, "0") for name, size in fields.items()]
    swapped = [F.concat(*(F.substring(d, 2 * k + 1, 2) for k in reversed(range(size)))) for d, size in zip(digits, fields.values(), strict=True)]
    return F.unhex(F.concat(*swapped))


def read_text_records(lines: DataFrame, column: str, schema: str, separator: str = " ") -> DataFrame:
    """Fields of lines separated by white space (or another separator); lines that do not parse give nulls."""
    return lines.select(F.from_csv(column, schema, {"sep": separator, "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def repeated(spark: SparkSession, char: str, n: int) -> DataFrame:
    return spark.range(1).select(F.repeat(F.lit(char), n).alias("text"))
