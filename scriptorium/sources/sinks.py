"""Sinks. All write in parallel, a file a partition; a report of one row is one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(rows: DataFrame, path: str, mode: str = "overwrite", without: tuple[str, ...] = ()) -> None:
    """CSV with a header in each file; columns of ``without`` are dropped. White space at the ends of texts stays, an empty text is no null."""
    rows.drop(*without).write.mode(mode).csv(path, header=True, escape='"', quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""')


def append(rows: DataFrame, path: str, without: tuple[str, ...] = ("success", "error", "plan_id")) -> None:
    csv(rows, path, "append", without)


def parquet(rows: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path, ignoreNullFields=False)


def report(row: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls kept and characters unescaped."""
    return row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("report"))


def split_tables(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split, from one pass."""
    parquet(rows, path, (split,))


def printed(rows: DataFrame, width: int = 18, digits: int = 4) -> DataFrame:
    """Each row as one line of padded columns: thousands separators for whole numbers, fixed digits for others, a dash for null."""
    cells = []
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        shown = F.format_number(c, 0) if kind in ("integer", "long", "short", "byte") else F.format_number(c, digits) if kind in ("double", "float", "decimal") else c.cast("string")
        cells.append(F.rpad(F.coalesce(shown, F.lit("-")), width, " "))
    return rows.select(F.rtrim(F.concat(*cells)).alias("line"))


def stamped(rows: DataFrame, column: str = "generated_at") -> DataFrame:
    """Adds the time of writing in ISO form; it is the same for all rows of a query."""
    return rows.withColumn(column, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
