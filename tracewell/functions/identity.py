"""Stable identifiers: sha-256 over parts joined by the unit separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import strip

SEPARATOR = "\x1f"


def _part(c) -> Column:
    """A part as text; missing, zero and false parts are the empty text, a text "0" is itself."""
    column = c if isinstance(c, Column) else F.lit(c)
    said = strip(column.cast("string"))
    kind = F.typeof(column)
    empty = (kind != "string") & said.rlike(r"^(?:false|-?0(?:\.0*)?(?:E-?\d+)?)$")
    return F.when(empty, "").when((kind == "boolean") & (said == "true"), "True").otherwise(said)


def _level(c) -> Column:
    column = c if isinstance(c, Column) else F.lit(c)
    return F.when(column == 0, "").otherwise(F.coalesce(column.cast("string"), F.lit("")))


def global_chunk_id(tenant, case, document, local, level) -> Column:
    joined = F.concat_ws(SEPARATOR, _part(tenant), _part(case), _part(document), _part(local), _level(level))
    return F.concat(F.lit("GCH_"), F.substring(F.sha2(joined, 256), 1, 32))


def upload_chunk_id(tenant, case, document, local) -> Column:
    """Upload path: full digest, parts as they are, level written as 0."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(c.cast("string"), F.lit("")) for c in (tenant, case, document, local)], F.lit("0"))
    return F.concat(F.lit("GCH_"), F.sha2(joined, 256))


def evidence_id(prefix: str, *parts) -> Column:
    joined = F.concat_ws(SEPARATOR, *[_part(p) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 20))


def safe_segment(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 20)
