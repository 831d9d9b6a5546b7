"""Rows -> nested documents of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from playtally.operators.numbering import numbered_within
from playtally.operators.stacking import stack

# Children per document row, on average. A parent with more is continued on further rows.
CHILDREN_PER_ROW = 10_000
# Sampled children per row; the more, the more even rows are.
SAMPLES_PER_ROW = 16


def child(id_column: str, name: Column | str, *fields: Column) -> Column:
    """Sortable child: by name, nulls last, then by id; ``fields`` are its content."""
    label = F.col(name) if isinstance(name, str) else name
    return F.struct(
        label.isNull().alias("nameless"),
        label.alias("by"),
        F.col(id_column).alias("then_by"),
        F.struct(*fields).alias("content"),
    )


def nest(
    key: str,
    heads: dict[str, DataFrame],
    children: list[tuple[str, DataFrame, DataFrame]],
    limit: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """One document per key: the head values and an array per kind of child.

    ``heads`` maps a column to a frame of (key, column); the lowest value of a
    key is kept, and the first head decides which keys there are. ``children``
    are triples of an id column, the links (key, id) and the members (id, one
    column of :func:`child` per kind).

    A document is the concatenation of its rows by ``part``, 0 to ``parts`` - 1,
    which all have the head values. Every kind of child is cut into contiguous
    ranges of its sort order, about ``limit`` children each. The ends of the
    ranges are children sampled by hash, so they are the same in every run, and
    gathering them takes ``SAMPLES_PER_ROW / limit`` of a parent's children; no row
    and no task holds an unbounded group, and no child is left out. Each kind is
    aggregated on its own, so nothing is multiplied. Heads are one row per key
    before they are repeated for the parts.
    """
    link_id = ["nest_source", "nest_id"]
    links = stack(
        [
            frame.select(key, *_source(number, id_column))
            for number, (id_column, frame, _) in enumerate(children)
        ]
    ).distinct()
    members = stack(
        [
            frame.select(*_source(number, id_column), *_kinds(frame, id_column))
            for number, (id_column, _, frame) in enumerate(children)
        ]
    )
    kinds = [name for name in members.columns if name not in link_id]
    order = _order(members, kinds)
    rate = max(1, limit // SAMPLES_PER_ROW)
    sampled = links.where(F.pmod(F.xxhash64(key, *link_id), F.lit(rate)) == 0)
    ends = (
        sampled.join(members, link_id)
        .groupBy(key, "nest_source")
        .agg(F.sort_array(F.collect_list(order)).alias("sampled"))
        .select(key, "nest_source", _every("sampled", -(-limit // rate)).alias("ends"))
        .where(F.size("ends") > 0)
    )
    parts = ends.groupBy(key).agg((F.max(F.size("ends")) + 1).alias("parts"))
    heads_in_all_parts = (
        stack(list(heads.values()))
        .groupBy(key)
        .agg(*[F.min(name).alias(name) for name in heads])
        .where(F.col(next(iter(heads))).isNotNull())
        .join(parts, key, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    part = _ends_up_to(F.col("ends"), F.col("nest_order"))
    placed = (
        links.join(members, link_id)
        .withColumn("nest_order", order)
        .join(ends, [key, "nest_source"], "left")
        .withColumn("part", F.when(F.col("ends").isNull(), 0).otherwise(part))
        .drop(*link_id, "nest_order", "ends")
    )
    # Spread by part as well: the join above gathered a parent's rows by key, and
    # grouping alone would be content with that.
    return (
        stack([heads_in_all_parts, placed])
        .repartition(key, "part")
        .groupBy(key, "part")
        .agg(
            F.max("parts").alias("parts"),
            *[F.min(name).alias(name) for name in heads],
            *[F.sort_array(F.collect_set(kind)).alias(kind) for kind in kinds],
        )
        .where(F.col(next(iter(heads))).isNotNull())
        .select(
            key,
            *heads,
            *[
                F.transform(kind, lambda item: item["content"]).alias(kind)
                for kind in kinds
            ],
            "part",
            "parts",
        )
    )


def flat_children(
    key: str, children: list[tuple[str, DataFrame, DataFrame]]
) -> DataFrame:
    """One row per child: key, kind, position from 0, and the fields of its content.

    ``children`` are those of :func:`nest`, with one content type for all kinds, and the
    rows of one key and kind in their order are its array there. One range
    partitioning by key, kind and order serves all parents, so a parent of any size
    is spread over as many tasks as it needs.
    """
    rows = []
    for id_column, links, members in children:
        kinds = [name for name in members.columns if name != id_column]
        each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("child")) for kind in kinds])
        rows.append(
            links.select(key, id_column).distinct()
            .join(members, id_column)
            .select(key, F.explode(each).alias("one"))
            .where(F.col("one.child").isNotNull())
            .select(key, "one.kind", "one.child.*")
            # Different members may look alike; an array has such a child once.
            .distinct()
        )
    order = [(name, "asc") for name in ("nameless", "by", "then_by")]
    return numbered_within(stack(rows), [key, "kind"], order).select(key, "kind", "position", "content.*")


def _ends_up_to(ends: Column, value: Column) -> Column:
    """How many of the sorted ends do not exceed the value, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ends) + 1)).cast("int"))

    def halve(bounds: Column, _: Column) -> Column:
        low, high = bounds["low"], bounds["high"]
        middle = F.floor((low + high) / 2).cast("int")
        is_left = F.get(ends, middle) <= value
        is_open = low < high
        return F.struct(
            F.when(is_open & is_left, middle + 1).otherwise(low).alias("low"),
            F.when(is_open & ~is_left, middle).otherwise(high).alias("high"),
        )

    bounds = F.struct(F.lit(0).alias("low"), F.size(ends).alias("high"))
    return F.aggregate(steps, bounds, halve, lambda found: found["low"])


def _order(members: DataFrame, kinds: list[str]) -> Column:
    """Place of a child in the sort order of its kinds; the kinds of one member agree in it."""
    return F.coalesce(
        *[
            F.when(
                F.col(kind).isNotNull(),
                F.struct(
                    F.col(kind)["nameless"].alias("nameless"),
                    F.col(kind)["by"].alias("by"),
                    F.col(kind)["then_by"].alias("then_by"),
                ),
            )
            for kind in kinds
        ]
    )


def _every(values: str, step: int) -> Column:
    """Every ``step``-th value but the first."""
    return F.filter(values, lambda _, i: (i > 0) & (i % step == 0))


def _source(number: int, id_column: str) -> list[Column]:
    """Identity of a member among the members of all sources."""
    return [
        F.lit(number).alias("nest_source"),
        F.col(id_column).cast("string").alias("nest_id"),
    ]


def _kinds(members: DataFrame, id_column: str) -> list[str]:
    return [name for name in members.columns if name != id_column]


def as_json(df: DataFrame) -> DataFrame:
    """Write every struct and array as JSON text, nulls included."""
    return df.select(
        *[
            F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name)
            if isinstance(f.dataType, (ArrayType, StructType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
