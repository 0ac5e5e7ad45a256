"""Documents in and out: HTML, Markdown and plain text by mime type; text files as sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import text as tx

#: Fixed value: largest document in bytes.
LARGEST = 10 * 1024 * 1024


def imported(files: DataFrame) -> DataFrame:
    """Adds plain (text by mime) and error to rows of mime and body; a body that is too large or of another type has an error and no text."""
    kind, body = F.col("mime"), F.col("body")
    plain = F.when(kind == "text/html", tx.html_text(body)).when(kind == "text/markdown", tx.markdown_text(body)).when(kind == "text/plain", body)
    large = F.octet_length(body) > LARGEST
    error = F.when(large, "too large").when(~kind.isin("text/html", "text/markdown", "text/plain") | kind.isNull(), "unsupported mime type")
    return files.withColumn("plain", F.when(~F.coalesce(large, F.lit(False)), plain)).withColumn("error", error)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as path, mime (by suffix) and body."""
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    mime = F.when(suffix.isin("html", "htm"), "text/html").when(suffix == "md", "text/markdown").when(suffix == "txt", "text/plain")
    return spark.read.format("binaryFile").load(path).select("path", mime.alias("mime"), F.decode("content", "utf-8").alias("body"))


def export_text(frame: DataFrame, column: str, path: str) -> None:
    """One column as text files; several tasks write several files."""
    frame.select(column).write.text(path)
