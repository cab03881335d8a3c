"""Rebuild the rows of a table from a full backup and the deltas after it.

Both kinds of delta say what is true afterwards: the row now held by a key, or the number of
copies a row now has. So a chain of any length is the base without everything a delta touched,
plus the last word on each touched key or row. The base is read once and only filtered by an
anti join (a broadcast when the number of touched rows is small), never sorted or regrouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tablevault.functions.fingerprint import FINGERPRINT, with_fingerprint
from tablevault.operators.delta import BEFORE, COPIES, OP, bounded_broadcast, repeat_rows, without_prints

_SEQ, _RANK = "_tv_seq", "_tv_rank"


def _last_word(deltas: list[DataFrame], by: list[str]) -> DataFrame:
    """The newest delta row of each key. The window sees delta rows only, and at most one per
    delta in a group."""
    if len(deltas) == 1:
        return deltas[0]
    stacked = reduce(DataFrame.unionByName, [d.withColumn(_SEQ, F.lit(i)) for i, d in enumerate(deltas)])
    newest = Window.partitionBy(*by).orderBy(F.col(_SEQ).desc())
    return stacked.withColumn(_RANK, F.row_number().over(newest)).where(F.col(_RANK) == 1).drop(_SEQ, _RANK)


def apply_keyed(base: DataFrame, deltas: list[DataFrame], keys: list[str], stored: int, touched: int) -> DataFrame:
    """``stored`` is the number of delta rows, ``touched`` how many keys existed before; when
    there are none the base needs no filter."""
    columns = [f"`{c}`" for c in base.columns]
    if not deltas:
        return base
    last = _last_word(deltas, keys)
    upserts = last.where(F.col(OP) == "U").select(*columns)
    if touched:
        names = bounded_broadcast(last.select(*keys), stored)
        base = base.join(names, keys, "left_anti").select(*columns)
    return base.unionByName(upserts)


def keyed_prints(base: DataFrame, deltas: list[DataFrame], keys: list[str], stored: int, touched: int) -> DataFrame:
    """Keys and fingerprints of the rows that :func:`apply_keyed` gives. Fingerprints are taken where the files are
    scanned, so joins carry keys and 16 bytes, never the rows."""
    columns = base.columns
    narrow = lambda df, *more: with_fingerprint(df, columns).select(*[f"`{k}`" for k in keys], *FINGERPRINT, *more)
    return apply_keyed(narrow(base), [narrow(d, OP) for d in deltas], keys, stored, touched)


def multiset_prints(base: DataFrame, deltas: list[DataFrame], touched: int) -> DataFrame:
    """Fingerprints of the rows that :func:`apply_multiset` gives, each with a number of copies; a fingerprint may
    come several times."""
    marked = [with_fingerprint(d, base.columns).select(*FINGERPRINT, COPIES, BEFORE) for d in deltas]
    prints = with_fingerprint(base).select(*FINGERPRINT)
    if touched:
        earlier = reduce(DataFrame.unionByName, [d.where(F.col(BEFORE) > 0).select(*FINGERPRINT) for d in marked])
        prints = prints.join(bounded_broadcast(earlier, touched), FINGERPRINT, "left_anti")
    prints = prints.withColumn(COPIES, F.lit(1).cast("bigint"))
    if not marked:
        return prints
    last = _last_word(marked, FINGERPRINT).where(F.col(COPIES) > 0)
    return prints.unionByName(last.select(*FINGERPRINT, COPIES))


def apply_multiset(base: DataFrame, deltas: list[DataFrame], touched: int, stored: int | None = None) -> DataFrame:
    """``touched`` is the number of delta rows that had copies before; when there are none the
    base needs no filter. ``stored`` is the number of all delta rows. The newest delta is passed on as it is, an older one
    without the rows that a later one speaks of."""
    columns = [f"`{c}`" for c in base.columns]
    marked = [with_fingerprint(d, base.columns) for d in deltas]
    present = []
    for i, d in enumerate(marked):
        d = d.where(F.col(COPIES) > 0)
        if later := [m.select(*FINGERPRINT) for m in marked[i + 1 :]]:
            d = without_prints(d, reduce(DataFrame.unionByName, later), stored)
        present.append(d.select(*columns, COPIES))
    present = repeat_rows(reduce(DataFrame.unionByName, present))
    if touched:
        earlier = reduce(DataFrame.unionByName, [d.where(F.col(BEFORE) > 0).select(*FINGERPRINT) for d in marked])
        base = without_prints(with_fingerprint(base), earlier, touched).select(*columns)
    return base.unionByName(present)
