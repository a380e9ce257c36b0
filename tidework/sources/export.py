"""CSV files, every cell quoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidework.functions.values import export_text

# The form of an exported file.
CSV_FORM = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "null",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as the text its cells get in the file."""
    return df.select(*[export_text(df, name).alias(name) for name in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A header, all cells quoted, quotes doubled, NULL as ``null``; one file per partition."""
    csv_cells(df).write.mode(mode).options(**CSV_FORM, quoteAll="true").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Exported files back as text columns. Only cells with line breaks need `multi_line`,
    which reads each file in one task."""
    schema = ", ".join(f"`{name}` string" for name in columns)
    return spark.read.schema(schema).options(**CSV_FORM, multiLine=str(multi_line).lower()).csv(path)
