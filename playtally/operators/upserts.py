"""Change logs applied to dimension tables as one set-based job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.operators.numbering import numbered


def upsert_rows(
    table: DataFrame,
    changes: DataFrame,
    key: str,
    natural_key: Sequence[str],
    required: str,
    order: str,
    created: dict[str, Column] | None = None,
    modified: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Create or update dimension rows: (new table, rejected changes).

    A change with a positive key updates that row, any other creates a row and
    needs the text column ``required``, whose outer blanks are trimmed. Changes are
    whole: of several for one row, the one that is last by the column ``order``
    counts, and a column that is null in it keeps the value of the table. Of
    changes that tie in ``order`` the one with the greatest values is the last.

    Creations come after all updates. One whose ``natural_key`` a row of the updated
    table has - under its new name, not under one that was given up - updates the
    first such row; null is a value like any other there. Rows that are created get
    the ids above the highest one without gaps, in the order of their natural keys.

    ``created`` is set on rows that are created, ``modified`` on rows that were
    there and are updated. Rejects keep their columns and carry a ``reason``.
    """
    changed = [c for c in changes.columns if c not in (key, order)]
    rest = [c for c in changed if c not in natural_key]
    is_update = F.coalesce(F.col(key) > 0, F.lit(False))
    updates = changes.where(is_update)
    creations = changes.where(~is_update).withColumn(required, F.trim(required))
    is_named = F.coalesce(F.col(required) != "", F.lit(False))
    unknown = updates.join(table.select(key), key, "left_anti").select(*changes.columns)
    rejects = unknown.withColumn("reason", F.lit("not found")).unionByName(
        creations.where(~is_named).withColumn("reason", F.lit(f"{required} is required"))
    )

    updated = _patch(table, _last(updates, [key], changed, order), key, changed, modified)
    wanted = _last(creations.where(is_named), list(natural_key), rest, order)
    owners = updated.groupBy(*[F.col(c).alias(f"own_{c}") for c in natural_key]).agg(
        F.min(key).alias(key)
    )
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in natural_key]
    placed = wanted.join(owners, same, "left").select(key, *natural_key, *rest)
    known = placed.where(F.col(key).isNotNull()).select(key, *rest)
    fresh = placed.where(F.col(key).isNull()).drop(key)

    highest = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("highest")).scalar()
    new = numbered(fresh, [(c, "asc") for c in natural_key], key, highest + 1)
    new = new.withColumn(key, F.col(key).cast(table.schema[key].dataType))
    for name, stamp in (created or {}).items():
        new = new.withColumn(name, stamp)
    patched = _patch(updated, known, key, rest, modified)
    return patched.unionByName(new, allowMissingColumns=True).select(*table.columns), rejects


def _last(changes: DataFrame, keys: list[str], columns: Sequence[str], order: str) -> DataFrame:
    """The last whole change of each key. Combines on the map side, so a hot key is no burden."""
    last = changes.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in columns])


def _patch(
    table: DataFrame,
    changes: DataFrame,
    key: str,
    columns: Sequence[str],
    stamps: dict[str, Column] | None,
) -> DataFrame:
    """The table with the values of one change per key, where they are not null."""
    new = changes.select(
        key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("is_changed")
    )
    stamps = stamps or {}

    def value(name: str) -> Column:
        if name in stamps:
            return F.when(F.col("is_changed"), stamps[name]).otherwise(F.col(name))
        return F.coalesce(f"new_{name}", name) if name in columns else F.col(name)

    return table.join(new, key, "left").select(*[value(c).alias(c) for c in table.columns])
