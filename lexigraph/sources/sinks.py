"""Writers: nested JSON, flat CSV, Markdown, all into a staged folder that is renamed once it is whole."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.text import markdown_cell


def staged(path: str, write: Callable[[str], None]) -> None:
    """Write beside the target and put it in place by renaming; a failed write leaves the target as it was."""
    tmp = f"{path}.{uuid.uuid4().hex}.staged"
    try:
        write(tmp)
        old = f"{tmp}.old"
        if os.path.exists(path):
            os.replace(path, old)
        os.replace(tmp, path)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(tmp, ignore_errors=True)


def export_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    staged(path, lambda p: df.write.json(p))


def export_csv(df: DataFrame, path: str) -> None:
    """Flat rows, UTF-8, null as empty; every part is a file of its own with a byte order mark and the header."""
    marked = df.select([F.col(c).cast("string") for c in df.columns]).toDF("\ufeff" + df.columns[0], *df.columns[1:])
    staged(path, lambda p: marked.write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(p))


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line): rows of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in df.columns]), F.lit(" |")).alias("line"))
