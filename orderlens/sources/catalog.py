"""Catalogue loader: the nine marketplace tables as typed DataFrames."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite_or_null
from . import schemas


class MissingTableError(FileNotFoundError):
    """A mandatory table of the catalogue is absent."""


class MissingColumnError(ValueError):
    """A table of the catalogue lacks a column that its schema names."""


def read_csv(spark: SparkSession, path: str, schema, optional: tuple[str, ...] = (), multi_line: bool = True) -> DataFrame:
    """Typed CSV read bound by header *name* (not position).

    Columns are read as text (no inference pass), then each schema field is
    taken from the header column of the same name with ``try_cast`` —
    malformed values and the text NaN become NULL, like a coercing parse. A
    field the file lacks raises, unless ``optional`` names it: then it is a
    typed NULL column. A UTF-8 BOM before the header is handled by the
    reader, and so are quoted line breaks with ``multi_line`` (which makes
    the file one task; leave it off for tables without free text).
    """
    raw = (spark.read.option("header", True).option("multiLine", multi_line)
           .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    present = set(raw.columns)
    missing = [f.name for f in schema.fields if f.name not in present and f.name not in optional]
    if missing:
        raise MissingColumnError(f"{path}: no column {', '.join(missing)}")
    cols = []
    for f in schema.fields:
        t = f.dataType.simpleString()
        if f.name in present:
            c = F.col(f"`{f.name}`") if t == "string" else F.expr(f"try_cast(`{f.name}` AS {t})")
            if t in ("double", "float"):
                c = finite_or_null(c).cast(t)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def _try_read(reader, path):
    try:
        return reader(path)
    except AnalysisException as e:  # PATH_NOT_FOUND is raised at resolution
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise


def load_catalog(spark: SparkSession, base_path: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """Load the catalogue from ``base_path``.

    ``fmt='csv'`` reads the original file names with explicit schemas;
    ``fmt='parquet'`` reads ``<table>.parquet`` per table name. A missing
    mandatory table raises :class:`MissingTableError`; the optional
    translation table is left out of the dict when absent.
    """
    out: dict[str, DataFrame] = {}
    for optional, spec in ((False, schemas.FILES), (True, schemas.OPTIONAL_FILES)):
        for name, (fname, schema) in spec.items():
            if fmt == "csv":
                free_text = name in schemas.FREE_TEXT_TABLES
                df = _try_read(lambda p, s=schema, m=free_text: read_csv(spark, p, s, schemas.OPTIONAL_COLUMNS, m),
                               os.path.join(base_path, fname))
            else:
                df = _try_read(spark.read.parquet, os.path.join(base_path, f"{name}.parquet"))
            if df is None:
                if optional:
                    continue
                raise MissingTableError(f"table {name!r} not found under {base_path}")
            out[name] = df
    return out


def register_views(catalog: dict[str, DataFrame]) -> None:
    """Expose each table as a temp view of the same name (for SQL users)."""
    for name, df in catalog.items():
        df.createOrReplaceTempView(name)
