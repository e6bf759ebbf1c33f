"""Three bin conventions over sorted edges; all give NULL for NULL or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(edges) -> Column:
    return F.array(*[F.lit(float(e)) for e in edges])


def _clean(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def _count(v: Column, edges, strict: bool) -> Column:
    test = (lambda e: e < v) if strict else (lambda e: e <= v)
    return F.size(F.filter(_array(edges), test))


def hist_bin(value: Column, edges) -> Column:
    """Histogram bin: [lo, hi), the last [lo, hi]; outside is NULL."""
    v = _clean(value)
    edges = list(edges)
    return F.when((v >= float(edges[0])) & (v <= float(edges[-1])), F.when(v == float(edges[-1]), F.lit(len(edges) - 2)).otherwise(_count(v, edges, False) - 1)).cast("int")


def digitize_bin(value: Column, edges) -> Column:
    """Digitised bin less one: [lo, hi), below the first -1, from the last on the number of edges less one."""
    v = _clean(value)
    return F.when(v.isNotNull(), _count(v, edges, False) - 1).cast("int")


def searchsorted_bin(value: Column, edges) -> Column:
    """Left search in the edges but the first: (lo, hi], clipped to the bins; a value on an edge falls to the lower bin."""
    v = _clean(value)
    edges = list(edges)
    return F.when(v.isNotNull(), F.least(_count(v, edges[1:], True), F.lit(len(edges) - 2))).cast("int")


def width_bin(value: Column, lo: float, hi: float, n: int) -> Column:
    """One of n equal bins from 0; the last closed; outside is NULL."""
    v = _clean(value)
    return F.when((v >= lo) & (v <= hi), F.least(F.floor((v - lo) * n / (hi - lo)), F.lit(n - 1))).cast("int")


def centers(edges, open_width: float = 10.0) -> list[float]:
    """True middles; an open last bin's is its lower edge and half of open_width."""
    return [(a + b) / 2 if b != float("inf") else a + open_width / 2 for a, b in zip(edges, edges[1:])]
