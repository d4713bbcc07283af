"""Writers of results, and logging to a log and a listing file."""

from __future__ import annotations

import contextlib
import io
import json
import logging
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Write a distributed table: parquet, csv (with header), json or orc."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
    return path


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """A small text file at a path of any file system that Spark knows; replaces what is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_recodes(spark: SparkSession, recodes: list[dict], path: str) -> str:
    """Recode expressions as JSON: one object per new column with name, kind, source and Spark SQL text."""
    return write_text(spark, json.dumps(recodes, indent=1), path)


def read_recodes(spark: SparkSession, path: str) -> list[dict]:
    return json.loads(read_text(spark, path))


def write_variable_list(spark: SparkSession, names: list[str], path: str) -> str:
    """The selected names as a macro assignment."""
    # Fixed value: the first words of the assignment.
    return write_text(spark, "%let varlist_redu =\n" + " ".join(names) + "\n;", path)


def write_excel(df: DataFrame, path: str, rows: int = 100_000) -> str:
    """A small table, such as a master table of one row a variable, as an Excel sheet; needs a package that writes them."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows are no table for a sheet")
    try:
        df.toPandas().to_excel(path, index=False)
    except ImportError as e:
        raise ImportError("writing Excel files needs the openpyxl or xlsxwriter package") from e
    return path


@contextlib.contextmanager
def printed_to(logger: logging.Logger) -> Iterator[None]:
    """What is printed to stdout and stderr inside goes to the logger, line by line, as INFO and WARNING."""

    class Lines(io.TextIOBase):
        def __init__(self, level: int):
            self.level, self.held = level, ""

        def write(self, text: str) -> int:
            *lines, self.held = (self.held + text).split("\n")
            for line in lines:
                logger.log(self.level, line)
            return len(text)

    out, err = Lines(logging.INFO), Lines(logging.WARNING)
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        try:
            yield
        finally:
            for s in (out, err):
                if s.held:
                    s.write("\n")


@contextlib.contextmanager
def log_to(log: str, listing: str | None = None, name: str = "scorewright") -> Iterator[logging.Logger]:
    """A logger that writes everything to ``log`` and INFO and up to ``listing``; files are closed at the end."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.DEBUG)
    handlers = []
    for path, level in ((log, logging.DEBUG), (listing, logging.INFO)):
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            h = logging.FileHandler(path, mode="w")
            h.setLevel(level)
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            logger.addHandler(h)
            handlers.append(h)
    try:
        yield logger
    finally:
        for h in handlers:
            logger.removeHandler(h)
            h.close()
