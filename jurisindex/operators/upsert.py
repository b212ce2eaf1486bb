"""The store: one current row per decision link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.functions.constants import (
    NO_DATE, NO_DOCKET, NO_NUMBER, SITE_ROOT, STORE_SALA, STORE_SUBJECT_AREA, STORE_TOPIC, STORE_YEAR,
)

KEY = "link_directo"
VALUES = ["sala_key", "sala", "numero_sentencia", "expediente", "fecha", "ano", "tema", "materia",
          "asunto", "extracto"]
# `first_seen` orders rows as they were first inserted, `last_seen` is the arrival of the row's
# current values: with both, batches can be merged in any order and any number of times.


def _first_of(df: DataFrame, names: list[str], default: Column) -> Column:
    return F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], default)


def write_defaults(df: DataFrame, site_root: str = SITE_ROOT, on_missing_link: str = "collapse") -> DataFrame:
    """The row as it is written: text columns as strings, null or absent ones defaulted.

    `sala` and `ano` take their defaults only if the whole column is absent: a null chamber or a
    year that is no integer makes the row invalid.  A row without a link gets the site's root
    address, so all such rows share one key; `on_missing_link='reject'` leaves it null instead.
    """
    ano = F.col("ano").cast("string").try_cast("int") if "ano" in df.columns else F.lit(STORE_YEAR)
    sala = F.col("sala").cast("string") if "sala" in df.columns else F.lit(STORE_SALA)
    root = F.lit(site_root if on_missing_link == "collapse" else None).cast("string")
    written = {
        "sala": sala,
        "numero_sentencia": _first_of(df, ["numero_sentencia", "sentencia"], F.lit(NO_NUMBER)),
        "expediente": _first_of(df, ["expediente"], F.lit(NO_DOCKET)),
        "fecha": _first_of(df, ["fecha"], F.lit(NO_DATE)),
        "ano": ano,
        "tema": _first_of(df, ["tema"], F.lit(STORE_TOPIC)),
        "materia": _first_of(df, ["materia"], F.lit(STORE_SUBJECT_AREA)),
        "asunto": _first_of(df, ["asunto"], F.lit("")),
        "extracto": _first_of(df, ["extracto", "asunto"], F.lit("")),
        KEY: _first_of(df, [KEY, "url"], root),
    }
    kept = [c for c in df.columns if c not in written and c not in ("sentencia", "url")]
    return df.select(*kept, *[c.alias(n) for n, c in written.items()])


def is_valid(written: DataFrame) -> Column:
    """A written row that the store accepts; of rows with chamber keys, one that has its key."""
    valid = F.col("sala").isNotNull() & F.col("ano").isNotNull() & F.col(KEY).isNotNull()
    if "sala_key" in written.columns:
        valid = valid & F.coalesce(F.col("sala_key") != "", F.lit(False))
    return valid


def split_rejects(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) of written rows."""
    return written.where(is_valid(written)), written.where(~is_valid(written))


def checked(written: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same two, written to a folder of the shared file system and read back.

    The rows are made once, however often both are used; the rejected ones stay there to be seen.
    """
    written.withColumn("aceptada", is_valid(written)).write.mode("overwrite").partitionBy("aceptada").parquet(folder)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in written.dtypes) + ", aceptada boolean"
    read = written.sparkSession.read.schema(schema).parquet(folder)
    return read.where("aceptada").drop("aceptada"), read.where("NOT aceptada").drop("aceptada")


def save_counts(written: DataFrame) -> DataFrame:
    """One row: how many rows of a batch are accepted and how many rejected."""
    return written.agg(
        F.count_if(is_valid(written)).alias("aceptadas"), F.count_if(~is_valid(written)).alias("rechazadas")
    )


def _versions(df: DataFrame) -> DataFrame:
    """Rows with the span of arrivals they stand for."""
    if "first_seen" in df.columns:
        return df
    return df.withColumns({"first_seen": F.col("arrival"), "last_seen": F.col("arrival")}).drop("arrival")


def merge_versions(versions: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """One row per key with the values of its last version.

    Every value is its own `max_by`, so Catalyst drops those a query does not read: counts move
    keys and numbers only, never the texts.  The aggregate combines in each task before the
    shuffle, so a link that a third of all rows share reaches its reducer as one row per task.
    """
    values = [c for c in versions.columns if c not in (*keys, "first_seen", "last_seen")]
    return versions.groupBy(*keys).agg(
        *[F.max_by(c, "last_seen").alias(c) for c in values],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def last_versions(batch: DataFrame, keys: tuple[str, ...] = (KEY,), seen: DataFrame | None = None) -> DataFrame:
    """Versions that merge to the same rows as all of a batch: the last one of each key, and the span of its arrivals.

    The spans are found by keys and arrivals alone.  The last versions are kept by a subquery, which Spark moves like
    any filter below the joins and expressions that bring the values (it does not move a semi join below an expression
    of the key): values of earlier versions are never made or moved.  Structs compare nulls as equal, as grouping does.
    The batch is read twice for that: once without its values, once for the last versions.  `seen` are the same rows for
    the reading without values, such as observed ones: every reading of it goes through all rows.
    """
    versions = _versions(batch)
    spans = (versions if seen is None else _versions(seen)).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    version = f"struct({', '.join(f'`{c}`' for c in (*keys, 'last_seen'))})"
    # Outer structs of an IN are taken apart into columns.
    latest = versions.sparkSession.sql(
        f"SELECT * FROM {{versions}} WHERE struct({version}) IN (SELECT {version} FROM {{spans}})", versions=versions, spans=spans)
    return latest.unionByName(_firsts(spans, versions), allowMissingColumns=True)


def _firsts(spans: DataFrame, versions: DataFrame) -> DataFrame:
    """The spans as versions without values; without a last arrival they are never what max_by takes."""
    return spans.withColumn("last_seen", F.lit(None).cast(versions.schema["last_seen"].dataType))


#: Bits of the map in `last_rows`: 4 MB, in at most 2 ** 19 words.
_MAP_BITS = 2**25


def last_rows(batch: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Versions that merge to the same rows as all of a batch, for batches of wide rows that stand in files.

    The batch is read for its keys and arrivals, then whole.  A bitmap of the hashes of the last versions, no larger for
    more rows, goes to the tasks: a row without its bit is no last version and is dropped where it is read, so earlier
    values are never shuffled.  A few earlier versions share a bit with a last one and stay; merging leaves them out.
    """
    versions = _versions(batch)
    spans = versions.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    place = F.pmod(F.xxhash64(*keys, F.col("last_seen").cast("string")), F.lit(_MAP_BITS))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    # Shifted by `shiftleft` a number is an int where its literal is one.
    words = spans.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = versions.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word")
    latest = marked.where(F.getbit("_bits", F.col("_bit")) == 1).drop("_word", "_bit", "_bits")
    return latest.unionByName(_firsts(spans, versions), allowMissingColumns=True)


def staged_versions(batch: DataFrame, staging: str, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """`last_rows` of a batch that is dear to make: its rows are made once and written packed to a shared folder."""
    batch.write.mode("overwrite").option("compression", "zstd").parquet(staging)
    return last_rows(batch.sparkSession.read.schema(batch.schema).parquet(staging), keys)


def upsert(
    store: DataFrame | None, batch: DataFrame, keys: tuple[str, ...] = (KEY,), late: bool = False, staging: str | None = None,
) -> DataFrame:
    """The store after a batch of accepted rows.

    `batch` carries `arrival`, a unique ascending number: of several rows of one link the last
    arrived one wins and the first arrived one keeps its place.  `late` reads a batch twice and makes the
    values of the last versions only, see `last_versions`: for batches that join long values.  `staging` is a folder for
    batches that are dear to make, see `staged_versions`; the result reads it.
    """
    if staging:
        versions = staged_versions(batch, staging, keys)
    else:
        versions = last_versions(batch, keys) if late else _versions(batch)
    if store is not None:
        versions = _versions(store).unionByName(versions, allowMissingColumns=True)
    return merge_versions(versions, keys)
