"""Registered queries and their SQL counterparts over the given tables."""

from __future__ import annotations


def registered() -> dict:
    """name -> (query(spark, sf_dir), SQL or None)."""
    from checks import approvals, files, registry, streams, validation

    return {**validation.QUERIES, **registry.QUERIES, **approvals.QUERIES, **files.QUERIES, **streams.QUERIES}
