"""Hosts of URLs and the domains that they belong to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host in lower case, without port and user; null where the URL can't be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def suffixes(host: Column) -> Column:
    """The host and every domain above it: ``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def within(host: Column, domains: tuple[str, ...] | list[str]) -> Column:
    """Whether the host is one of ``domains`` or below one; false for a null host.

    It compares sets within the row, so a fixed list needs no join.
    """
    if not domains:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(suffixes(host), F.array(*map(F.lit, domains))), F.lit(False))
