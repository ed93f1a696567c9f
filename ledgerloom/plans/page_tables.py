"""From extracted table cells to one de-duplicated table per document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import tables as T
from ..operators.skew import unbroadcast
from ..session import stage


def candidate_tables(cells: DataFrame) -> DataFrame:
    """Cleaned and unified rows of every table."""
    return T.unify_candidates(T.clean_tables(cells, [*T.TABLE, "cand"], labels=True))


def accepted_tables(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Tables that pass, in this order: completeness, junk, exact, near and consecutive duplicates.

    ``vectors(doc, page, grp, embedding)`` describe the tables' texts; without them the
    near-duplicate step is left out.
    """
    stats = T.table_stats(rows).filter(~T.is_incomplete() & ~T.is_junk())
    stats = T.drop_exact_duplicates(stats)
    if vectors is not None:
        offered = vectors.join(unbroadcast(stats.select(*T.TABLE)), T.TABLE, "left_semi")
        distinct = T.near_duplicates_dropped(offered, ["doc", "page"], "grp", "embedding")
        described = vectors.select(*T.TABLE)
        kept = stats.join(unbroadcast(distinct), T.TABLE, "left_semi")
        stats = kept.unionByName(stats.join(unbroadcast(described), T.TABLE, "left_anti"))
    return T.drop_consecutive_duplicates(stats)


def document_tables(cells: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Final rows per document: ``(doc, row_no, values)``."""
    rows = stage(candidate_tables(cells), "tables")
    return T.assemble(rows, stage(accepted_tables(rows, vectors), "accepted"))
