"""Row-local helpers: metadata, noisy JSON, finding ladder, patch splice, array expansion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions.text import strip, text_of


def flatten_metadata(values: Mapping[str, Column]) -> Column:
    """JSON object of the non-null values as text; nested values are JSON-encoded first."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_filter(pairs, lambda _, v: v.isNotNull()))


def json_object(c: Column, schema: str) -> Column:
    """First to last brace of a noisy text, parsed; NULL when there is none or it is broken."""
    body = F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), F.from_json(body, schema))


def scale_finding(status: Column, severity: Column, reason: Column, span: Column, claim: Column,
                  evidence_rows: Column, evidence_ids: Column) -> Column:
    """Downgrade ladder of a verifier reply: a FAIL must be narrow, located and bound to evidence."""
    state, level, code = F.upper(status), F.upper(severity), F.upper(reason)
    known = state.isin("PASS", "WARN", "FAIL", "INSUFFICIENT_EVIDENCE") & level.isin("MINOR", "CLAIM_ERROR", "PARAGRAPH_ERROR")
    located = (span != "") & F.contains(claim, span)

    def outcome(s: str, c: str) -> Column:
        return F.struct(F.lit(s).alias("status"), F.lit(c).alias("reason_code"))

    return (
        F.when(~known, outcome("WARN", "VERIFIER_SCHEMA_ERROR"))
        .when(state != "FAIL", F.struct(state.alias("status"), code.alias("reason_code")))
        .when(evidence_rows == 0, outcome("INSUFFICIENT_EVIDENCE", "NO_EVIDENCE"))
        .when(~code.isin(*P.FAIL_REASONS), outcome("WARN", "UNSAFE_FAIL_REASON"))
        .when(level != "MINOR", outcome("WARN", "AUTO_PATCH_SCOPE_TOO_WIDE"))
        .when(~located, outcome("WARN", "INVALID_FAIL_SPAN"))
        .when(evidence_ids == 0, outcome("INSUFFICIENT_EVIDENCE", "UNBOUND_FAIL_EVIDENCE"))
        .otherwise(F.struct(state.alias("status"), code.alias("reason_code")))
    )


def splice_patch(claim: Column, span: Column, replacement: Column, severity: Column) -> Column:
    """Replace the first occurrence of a located span by a short patch, else NULL."""
    patch = strip(replacement)
    allowed = (
        (patch != "") & (severity == "MINOR") & (span != "") & F.contains(claim, span)
        & (F.length(patch) <= F.greatest(F.lit(120), F.length(span) * 2))
    )
    at = F.instr(claim, span)
    return F.when(allowed, F.concat(F.substring(claim, F.lit(1), at - 1), patch,
                                    F.substring(claim, at + F.length(span), F.length(claim))))


def aspect_fit(width: Column, height: Column, max_width: float, max_height: float) -> Column:
    """Largest size inside the box with the same proportions."""
    wide, high = F.greatest(width.cast("int"), F.lit(1)), F.greatest(height.cast("int"), F.lit(1))
    scale = F.least(F.lit(max_width) / wide, F.lit(max_height) / high)
    return F.struct(F.greatest(wide * scale, F.lit(1.0)).alias("width"), F.greatest(high * scale, F.lit(1.0)).alias("height"))


def repeat_each(values: Column, counts: Column) -> Column:
    """Element i of ``values`` repeated ``counts[i]`` times."""
    return F.flatten(F.zip_with(values, counts, lambda v, n: F.array_repeat(v, n)))


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps in one; of equal keys the right one counts."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def strict_zip(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """Pairs by position; arrays of different length are an error."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))
    return F.when(F.size(left) == F.size(right), pairs).otherwise(F.raise_error(F.concat(
        F.lit("lengths differ: "), F.size(left).cast("string"), F.lit(" and "), F.size(right).cast("string"))).cast(
        "void"))
