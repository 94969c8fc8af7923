"""Payloads and descriptions of sources as they come: decoded without failing, and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a source's description may hold, and how much of the source it may say was seen.
FIELDS = ("original_ref", "original_date", "author", "locator", "parser_version", "parent_source_key", "visibility")
VISIBILITY = ("unknown", "visible_only", "complete_visible")
LONGEST_VALUE = 1000


def _elements(payload: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(payload), "$", "array<variant>")


def decoded_messages(payload: Column) -> Column:
    """The elements of a JSON list as variants; what is null, no JSON or no list has none."""
    return F.coalesce(_elements(payload), F.array().cast("array<variant>"))


def payload_invalid(payload: Column) -> Column:
    """Whether a payload is not a JSON list."""
    return _elements(payload).isNull()


def messages_invalid(payload: Column) -> Column:
    """Whether a payload is not a list of messages that each have an id and a text."""

    def told(m: Column, field: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(m, f"$.{field}", "variant")) == "STRING", F.lit(False))

    return payload_invalid(payload) | ~F.forall(decoded_messages(payload), lambda m: told(m, "id") & told(m, "text"))


def locator_given(metadata: Column) -> Column:
    """Whether a description says where its source is from or where in it."""
    return F.exists(F.array(*(F.try_element_at(metadata, F.lit(k)) for k in ("original_ref", "locator"))), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))


def metadata_valid(metadata: Column) -> Column:
    """Whether a map of strings describes a source: only the known fields, each given and not too long, and a known visibility. A null map does not."""
    known = F.forall(F.map_keys(metadata), lambda k: k.isin(*FIELDS))
    given = F.forall(F.map_values(metadata), lambda v: v.isNotNull() & (F.length(F.coalesce(v, F.lit(""))) <= LONGEST_VALUE))
    seen = F.coalesce(F.try_element_at(metadata, F.lit("visibility")), F.lit("unknown")).isin(*VISIBILITY)
    return F.coalesce(known & given & seen, F.lit(False))


def visibility(metadata: Column) -> Column:
    """How much of a source its description says was seen; unknown where it does not say, or says something else."""
    said = F.try_element_at(metadata, F.lit("visibility"))
    return F.when(said.isin(*VISIBILITY), said).otherwise("unknown")
