"""Export projections and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.functions.constants import (
    MATRIX_HEADERS, NO_DATE, NO_DOCKET, NO_NUMBER, SITE_ROOT, STORE_SALA, STORE_SUBJECT_AREA, STORE_TOPIC,
)
from jurisindex.functions.text import prefix, short_sala, text

CATALOG_SUBJECT_LENGTH = 75
FORMATS = ("json", "excel", "xlsx", "csv", "pdf", "all")


def _first_of(df: DataFrame, names: list[str], default: str) -> Column:
    return F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(default))


def export_matrix(df: DataFrame, site_root: str = SITE_ROOT) -> DataFrame:
    """The nine columns of the decision matrix, defaulted."""
    sala = _first_of(df, ["sala"], STORE_SALA)
    return df.select(
        F.concat(F.lit("Sala "), short_sala(sala)).alias("sala"),
        _first_of(df, ["numero_sentencia", "sentencia"], NO_NUMBER).alias("numero_sentencia"),
        _first_of(df, ["expediente"], NO_DOCKET).alias("expediente"),
        _first_of(df, ["fecha"], NO_DATE).alias("fecha"),
        _first_of(df, ["tema"], STORE_TOPIC).alias("tema"),
        _first_of(df, ["materia"], STORE_SUBJECT_AREA).alias("materia"),
        _first_of(df, ["asunto"], "").alias("asunto"),
        _first_of(df, ["extracto", "asunto"], "").alias("extracto"),
        _first_of(df, ["link_directo", "url", "link"], site_root).alias("link_directo"),
    )


def summary_catalog(df: DataFrame) -> DataFrame:
    """The six columns of the printed catalogue."""
    column = lambda name: text(name) if name in df.columns else F.lit("")
    return df.select(
        short_sala(column("sala")).alias("sala"),
        column("numero_sentencia").alias("numero_sentencia"),
        column("expediente").alias("expediente"),
        column("fecha").alias("fecha"),
        column("ponente").alias("ponente"),
        prefix(column("asunto"), CATALOG_SUBJECT_LENGTH).alias("asunto"),
    )


def catalog_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


#: For `fast` writers, gzip as fast as it goes: half the time of a file of texts for about an eighth more of its bytes.
_FAST = {"zlib.compress.level": "BEST_SPEED"}


def made_once(df: DataFrame, folder: str) -> DataFrame:
    """The same rows, written to a folder of the shared file system and read back.

    For several exports of rows that are dear to make: they are made once, not for every file that is written.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_csv(df: DataFrame, path: str, compression: str | None = None, fast: bool = False) -> None:
    """CSV with a header; quotes inside fields are doubled, line ends and outer spaces kept."""
    whole = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} | (_FAST if fast else {})
    df.write.mode("overwrite").options(header=True, **whole).csv(path, compression=compression)


def write_json(df: DataFrame, path: str, compression: str | None = None, fast: bool = False) -> None:
    """One JSON object per line, empty fields included."""
    df.write.mode("overwrite").options(ignoreNullFields=False, **(_FAST if fast else {})).json(path, compression=compression)


def write_matrix(df: DataFrame, path: str, compression: str | None = None, fast: bool = False) -> None:
    """The decision matrix as a table file with its headers."""
    write_csv(export_matrix(df).withColumnsRenamed(MATRIX_HEADERS), path, compression, fast)


def export(df: DataFrame, folder: str, fmt: str = "all", compression: str | None = None) -> dict[str, str]:
    """Write the wanted formats below `folder`; returns the path of each.

    Every writer runs in parallel and leaves one file per task.  With `compression`, such as gzip, whole texts take
    a part of the disk; Spark reads such files again without being told, each in one task.  `df` is made anew for each
    format, see `made_once`.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, use one of {', '.join(FORMATS)}")
    written = {}
    if fmt in ("json", "all"):
        written["json"] = f"{folder}/json"
        write_json(df, written["json"], compression, fast=True)
    if fmt in ("excel", "xlsx", "all"):
        written["matriz"] = f"{folder}/matriz"
        write_matrix(df, written["matriz"], compression, fast=True)
    if fmt in ("csv", "all"):
        written["csv"] = f"{folder}/csv"
        write_csv(df, written["csv"], compression, fast=True)
    if fmt in ("pdf", "all"):
        written["catalogo"] = f"{folder}/catalogo"
        write_csv(summary_catalog(df), written["catalogo"], compression, fast=True)
    return written
