"""Which tables a run touches: include and exclude lists."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame


def parse_names(text: str | None) -> list[str] | None:
    """Comma list of an option: trimmed, empty pieces dropped; nothing given means no filter."""
    if text is None:
        return None
    return [piece.strip() for piece in text.split(",") if piece.strip()]


def select_names(
    available: list[str], include: list[str] | None = None, exclude: list[str] | None = None
) -> list[str]:
    """Names kept, in the order available. ``*`` and ``?`` match as in the include and exclude
    switches of common dump tools; exclusion wins; an absent or empty include list means all."""
    kept = [n for n in available if not include or any(fnmatchcase(n, p) for p in include)]
    kept = [n for n in kept if not any(fnmatchcase(n, p) for p in exclude or [])]
    if include and not any(fnmatchcase(n, p) for n in available for p in include):
        raise ValueError(f"no table matches {include}")
    return kept


def select_tables(
    listing: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, column: str = "table_name"
) -> DataFrame:
    """The same rule on a listing held as a frame: semi join with the include names, anti join
    with the excluded ones. Several include lists are united first by the caller."""
    out = listing
    if include is not None:
        out = out.join(include.select(column).distinct(), column, "left_semi")
    if exclude is not None:
        out = out.join(exclude.select(column).distinct(), column, "left_anti")
    return out
