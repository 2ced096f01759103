"""The query catalogue: every operator bound to the driver tables, with its SQL check."""

from __future__ import annotations


def catalogues() -> list:
    from . import feeds, graph, records, texts

    return [records.catalogue, texts.catalogue, feeds.catalogue, graph.catalogue]
