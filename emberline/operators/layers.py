"""Layered column definitions.

A detector is a list of layers; a layer is a dict of named columns that only read columns of
earlier layers.  Several detectors are merged layer by layer, so a plan of seven detectors has
as many projections as its deepest detector, not the sum - which keeps Catalyst's work (and
the generated code) proportional to what is computed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Layer = dict[str, Column]


def merge(*parts: Sequence[Layer]) -> list[Layer]:
    depth = max(len(p) for p in parts)
    out: list[Layer] = []
    for i in range(depth):
        layer: Layer = {}
        for p in parts:
            if i < len(p):
                layer |= p[i]
        out.append(layer)
    return out


def trimmed(layers: Sequence[Layer], fields: Mapping[str, Sequence[str]]) -> list[Layer]:
    """Layers whose named structs keep the given fields only; what nothing else reads then drops out of the plan."""
    return [
        {name: F.struct(*[c[f].alias(f) for f in fields[name]]) if name in fields else c for name, c in layer.items()}
        for layer in layers
    ]


def layered(df: DataFrame, *parts: Sequence[Layer]) -> DataFrame:
    """Apply merged layers and drop the temporaries (names starting with ``__``)."""
    layers = [x for x in merge(*parts) if x]
    for layer in layers:
        df = df.withColumns(layer)
    temps = [c for layer in layers for c in layer if c.startswith("__")]
    return df.drop(*temps) if temps else df
