"""The canonical row of a captured decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurisindex.sources.dimensions import sala_name

FIELDS = ["sala", "numero_sentencia", "expediente", "fecha", "ano", "tema", "materia", "asunto",
          "extracto", "ponente", "link_directo"]

# Wide enough for every response number with every position in an array, and the kind of source.
ARRIVAL_TYPE = "decimal(38,0)"
_PLACES = 2**32


def row_struct(pos: Column, patron: Column, **fields: Column) -> Column:
    """One found decision; every way of finding them makes the same struct."""
    return F.struct(
        pos.cast("int").alias("pos"), patron.alias("patron"), *[fields[f].alias(f) for f in FIELDS[1:]]
    )


def arrival_of(resp_id: Column | str, pos: Column | str, rendered: bool = False) -> Column:
    """One ascending number for (response, position); what a rendered page shows comes after its response."""
    resp_id = F.col(resp_id) if isinstance(resp_id, str) else resp_id
    pos = F.col(pos) if isinstance(pos, str) else pos
    place = resp_id.cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(11,0)") + (2 * pos.cast("bigint") + int(rendered))
    return place.cast(ARRIVAL_TYPE)


def captured_rows(responses: DataFrame, found: Column) -> DataFrame:
    """One canonical row per element of `found`, an array of `row_struct`.

    `patron` tells how it was found, `ano_escaneo` is the year of the scan; a row's own year may be
    the one in its address.
    """
    return (
        responses.select("resp_id", "sala_key", F.col("ano").alias("ano_escaneo"), F.explode(found).alias("d"))
        .select(
            arrival_of("resp_id", F.col("d.pos")).alias("arrival"),
            "sala_key",
            sala_name("sala_key").alias("sala"),
            *[F.col("d")[f].alias(f) for f in FIELDS[1:]],
            F.col("d.patron").alias("patron"),
            "ano_escaneo",
        )
    )
