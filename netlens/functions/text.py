"""Functions over JSON and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GEO

# Names of the trusted certificate authorities.
TRUSTED_CAS = ["TrustedCA1", "TrustedCA2", "TrustedCA3"]


def is_json_object(text: Column) -> Column:
    """True for a well-formed JSON object, false for anything else or null."""
    return F.coalesce(
        F.startswith(F.ltrim(text), F.lit("{"))
        & F.get_json_object(text, "$").isNotNull(),
        F.lit(False),
    )


def geo_fields(geo_json: Column) -> Column:
    """The eight shown fields of a geolocation answer; null unless a JSON object."""
    return F.when(is_json_object(geo_json), F.from_json(geo_json, GEO))


def trusted_issuer(issuer: Column, trusted: list[str] | None = None) -> Column:
    """True if the issuer is a trusted authority; the subject plays no part."""
    return F.coalesce(issuer.isin(TRUSTED_CAS if trusted is None else trusted), F.lit(False))
