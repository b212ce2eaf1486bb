"""Chamber and month dimensions: small fixed tables, and lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisindex.functions.constants import (
    ALL_SALAS, ALL_STORE_NAME, DEFAULT_SALA_KEY, MES_CHOICES, SALA_CHOICES, SALAS, STORE_NAME_PREFIX,
)
from jurisindex.functions.binding import text_map
from jurisindex.functions.text import strip, text


def dim_sala(spark: SparkSession) -> DataFrame:
    """The seven chambers."""
    return spark.createDataFrame(
        SALAS, "sala_key string, code string, portal_id string, nombre string, alias array<string>"
    )


def sala_choices(spark: SparkSession) -> DataFrame:
    """The chambers a user may choose, first the one that means all of them."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(SALA_CHOICES)], "opcion int, key string, nombre string, code string"
    )


def mes_choices(spark: SparkSession) -> DataFrame:
    """The months a user may choose, first the whole year."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(MES_CHOICES)], "opcion int, key string, nombre string, code string"
    )


def _lookup(pairs: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(text_map(pairs)[key], F.lit(default))


def resolve_sala(reference: Column | str) -> Column:
    """Chamber key of a free reference: a key, else an alias, else the default chamber.

    Spaces become '_' first, so an alias written with a space is never found.
    """
    pairs = {alias: key for key, _, _, _, aliases in SALAS for alias in aliases}
    pairs |= {key: key for key, *_ in SALAS}
    cleaned = F.replace(strip(F.lower(text(reference))), F.lit(" "), F.lit("_"))
    return _lookup(pairs, cleaned, DEFAULT_SALA_KEY)


def sala_name(sala_key: Column | str) -> Column:
    """Chamber name of a chamber key."""
    names = {key: name for key, _, _, name, _ in SALAS}
    return _lookup(names, text(sala_key), names[DEFAULT_SALA_KEY])


def store_name(sala_key: Column | str) -> Column:
    """Name of a chamber's store; the store of all chambers for any other key."""
    pairs = {key: STORE_NAME_PREFIX + key for key, *_ in SALAS}
    return _lookup(pairs, text(sala_key), ALL_STORE_NAME)


def choice_row(key: Column | str, choices: list[tuple], by_code: bool = True) -> Column:
    """struct(key, nombre, code) of a choice given by key or code, the first choice if unknown."""
    as_struct = lambda row: F.struct(
        F.lit(row[0]).alias("key"), F.lit(row[1]).alias("nombre"), F.lit(row[2]).alias("code")
    )
    pairs = {row[2]: row for row in reversed(choices)} if by_code else {}
    pairs |= {row[0]: row for row in choices}
    table = F.create_map(*[x for k, row in pairs.items() for x in (F.lit(k), as_struct(row))])
    return F.coalesce(table[text(key)], as_struct(choices[0]))


def sala_keys(sala_key: str) -> list[str]:
    """The chambers a scan of `sala_key` visits."""
    return [key for key, *_ in SALAS] if sala_key == ALL_SALAS else [sala_key]
