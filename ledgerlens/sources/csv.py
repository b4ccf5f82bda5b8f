"""Delimited text sources and sinks with explicit schemas.

Text comes back as it was written: quotes are doubled, values with separators,
quotes or line ends are quoted, white space stays, an empty text is ``""`` and a null
is ``\\N``. A text that is itself ``\\N``, or backslashes before ``N``, gets one more
backslash in the file and loses it on reading. An empty unquoted field, as other
writers have it, is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "\\N"
FORMAT = {"escape": '"', "nullValue": NULL, "lineSep": "\n", "ignoreLeadingWhiteSpace": "false",
          "ignoreTrailingWhiteSpace": "false"}


def _unmarked(c: Column) -> Column:
    """Without the backslash that keeps a text apart from a null."""
    return F.when(c.rlike(r"^\\\\+N$"), F.substr(c, F.lit(2))).otherwise(c)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = ",", header: bool = True, multi_line: bool = True) -> DataFrame:
    """Delimited text. With a header, columns are found by name, so their order
    in the file does not matter, and a file whose header differs from the
    others' is an error. With a schema the named columns are cast; what cannot
    be read as its type becomes null. Without a schema every column is text.
    A file whose values may hold line ends is read by one task; for single large
    files without such values, ``multi_line=False`` lets Spark split them."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = (spark.read.options(**FORMAT).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
              .option("multiLine", multi_line))
    if header:
        raw = reader.option("enforceSchema", False).csv(path)
    else:
        raw = reader.csv(path)
        if wanted is not None:
            raw = raw.toDF(*wanted.names)
    if wanted is None:
        return raw.select(*[_unmarked(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return raw.select(*[(_unmarked(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType)
                         else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name) for f in wanted.fields])


def write_csv(df: DataFrame, path: str, sep: str = "|", header: bool = True, mode: str = "overwrite",
              compression: str | None = None) -> None:
    """Delimited sink: one file per task, written in parallel (never
    collected to the driver). With ``compression`` (``gzip``) the files are packed; a
    packed file is read by one task, as any file whose values may hold line ends."""
    marked = df.select(*[F.when(F.col(f"`{f.name}`").rlike(r"^\\+N$"), F.concat(F.lit("\\"), F.col(f"`{f.name}`")))
                         .otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType)
                         else F.col(f"`{f.name}`") for f in df.schema.fields])
    marked.write.mode(mode).options(**FORMAT).option("header", header).option("sep", sep).csv(path, compression=compression)
