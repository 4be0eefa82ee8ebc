"""Stable identities, content hashes, cost bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column, separator: str = "\n", length: int = 64) -> Column:
    """First hex digits of the SHA-256 of the parts; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def stable_id(prefix: str, event: Column, url: Column, meta: Sequence[Column]) -> Column:
    """Identity of a record: of its event if it has one, else of its URL, else of its other fields."""
    have = lambda c: F.coalesce(c, F.lit("")) != ""
    basis = F.when(have(event), F.concat(F.lit("event:"), event)).when(have(url), F.concat(F.lit("url:"), url))
    return F.concat(F.lit(prefix), digest(F.coalesce(basis, F.concat_ws("|", F.lit("meta:"), *[F.coalesce(m, F.lit("")) for m in meta])), length=16))


def blob_hash(text: Column) -> Column:
    """SHA-1 of the text as a version-control blob, line ends as LF."""
    unix = F.encode(F.replace(text, F.lit("\r\n"), F.lit("\n")), "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(unix).cast("string"), F.chr(F.lit(0))), "UTF-8"), unix))


def cost_bound(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, margin: float = 1.1, batch: bool = False) -> Column:
    """Upper bound of a call's cost; prices are for a million tokens, batches cost half."""
    return (tokens_in * (margin * price_in) + tokens_out * price_out) / F.lit(1e6) * F.lit(0.5 if batch else 1.0)


def mask(present: Sequence[Column]) -> Column:
    """Bit mask of the fields that are present, the first in the lowest bit."""
    out = F.lit(0)
    for i, p in enumerate(present):
        out = out + F.when(p, F.lit(1 << i)).otherwise(F.lit(0))
    return out
