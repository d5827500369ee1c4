"""Log lines and row protocols as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format of stage lines.
STAGE_LINE = r"stage (\w+): pdf=(\S+) .*?elapsed_s=([\d.]+)"
TRUNCATED_LINE = r"stage formula: .*?truncated=(\d+)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line``; bytes that aren't UTF-8 are replaced."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def stage_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``stage, pdf, elapsed, truncated`` and keeps the lines that report a stage's time."""
    elapsed = F.expr("try_cast(__elapsed AS double)")
    out = lines.where(F.col(line).rlike(STAGE_LINE)).withColumns(
        {"stage": F.regexp_extract(line, STAGE_LINE, 1), "pdf": F.regexp_extract(line, STAGE_LINE, 2), "__elapsed": F.regexp_extract(line, STAGE_LINE, 3)}
    )
    truncated = F.when(F.col(line).rlike(TRUNCATED_LINE), F.regexp_extract(line, TRUNCATED_LINE, 1).cast("int"))
    return out.withColumns({"elapsed": elapsed, "truncated": truncated}).drop("__elapsed")


def row_protocol(lines: DataFrame, schema: str, line: str = "line", prefix: str = "ROW:") -> DataFrame:
    """The JSON rows of lines with the prefix; rows that aren't JSON are left out."""
    body = F.when(F.col(line).startswith(prefix), F.substring(line, len(prefix) + 1, 1 << 30))
    rows = lines.withColumn("__row", F.from_json(body, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    return rows.where("`__row` IS NOT NULL AND `__row`.`__bad` IS NULL").select("__row.*").drop("__bad")
