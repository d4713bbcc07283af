"""Reading tables: CSV with the usual spellings of missing, Parquet and others; NaN becomes null at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a CSV cell may have for missing.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
UNFIT = (T.DateType, T.TimestampType, T.TimestampNTZType, T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN as null, booleans as 0 and 1; other columns untouched."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; types from ``schema``, else inferred after missing words are nulls."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is not None:
        return nan_to_null(clean.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]))
    tests = []
    for i, c in enumerate(clean.columns):
        x = F.col(f"`{c}`")
        for kind in ("long", "double"):
            tests.append(F.coalesce(F.bool_and(x.isNull() | F.trim(x).try_cast(kind).isNotNull()), F.lit(False)).alias(f"{kind}{i}"))
        tests.append((F.count(x) > 0).alias(f"some{i}"))
    fits = clean.agg(*tests).first()
    typed = []
    for i, c in enumerate(clean.columns):
        kind = next((k for k in ("long", "double") if fits[f"{k}{i}"] and fits[f"some{i}"]), "string")
        x = F.col(f"`{c}`")
        typed.append((x if kind == "string" else F.trim(x).cast(kind)).alias(c))
    return nan_to_null(clean.select(*typed))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By the name's ending: .csv, .xls/.xlsx (through pandas, if its reader is installed), .json, .orc, else Parquet."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return read_csv(spark, path, schema)
    if low.endswith((".xls", ".xlsx")):
        import pandas as pd

        try:
            return nan_to_null(spark.createDataFrame(pd.read_excel(path), schema))
        except ImportError as e:
            raise ImportError("reading Excel files needs the openpyxl or xlrd package") from e
    reader = spark.read.schema(schema) if schema is not None else spark.read
    kind = "json" if low.endswith(".json") else "orc" if low.endswith(".orc") else "parquet"
    return nan_to_null(reader.format(kind).load(path))


def sex_and_child_flags(df: DataFrame, sex: str = "Sex", age: str = "Age") -> DataFrame:
    """Adds IsFemale and IsChild (under 18); 0 where the value is missing."""
    return df.withColumns({"IsFemale": F.coalesce((F.col(sex) == "female").cast("int"), F.lit(0)), "IsChild": F.coalesce((F.col(age) < 18).cast("int"), F.lit(0))})


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    return df.limit(rows)


def check_variables(df: DataFrame, names: list[str]) -> None:
    """Raise for names that are absent or of a type no variable can have."""
    known = {f.name: f.dataType for f in df.schema}
    absent = [n for n in names if n not in known]
    unfit = [n for n in names if n in known and isinstance(known[n], UNFIT)]
    if absent or unfit:
        raise ValueError(f"absent: {absent}; no variables by their type: {unfit}")
