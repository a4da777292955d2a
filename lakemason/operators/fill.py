"""Filling missing values from records of the same entity, in the order of time.

Numbers are interpolated between the observed neighbours, categories carried from the nearer
neighbour within a gap limit; every filled value is marked with method and distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the time slices into which an entity's history is cut. An entity with a third of
#: all rows spreads over its slices; only one row a slice and entity is carried between them,
#: and rows of one instant meet in one row, so that no window depends on the number of rows.
SLICE_SECONDS = 7 * 86_400.0


def fill_in_time(rows: DataFrame, entity: str, order: Column, fields: dict[str, str], usable: dict[str, Column] | None = None, gap: dict[str, float] | None = None, slice_width: float = SLICE_SECONDS, undated: bool = False) -> DataFrame:
    """``rows`` with ``<field>_filled``, ``<field>_method`` and ``<field>_distance`` added.

    fields: name -> "number" or "category". order: seconds, or any number that grows with
    time; rows without it take no part (method ``none``) unless observed (``observed``).
    usable: where a held value may serve as a neighbour (default: wherever it isn't null).
    gap: largest distance to a neighbour (default: none). An observed value stays, with
    method ``observed`` and distance 0. A null number with neighbours on both sides is
    ``interpolated``, with one it is ``carried``; a category is ``carried`` from the nearer
    neighbour, the earlier on ties. Without a neighbour it stays null, method ``none``.
    undated: records without a place in the order supply their entity's rows that have no
    neighbour (the greatest value counts), and get the latest value of their entity: method
    ``undated``, and no distance, as there is none.
    Columns of ``rows`` stay, but for those of the added names. Null entities are nobody's records. Neighbours of one instant: the greatest value counts.
    """
    usable, gap = usable or {}, gap or {}
    # the row travels as one struct, so that its columns' names can't clash with the work's own
    packed = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    t = order.cast("double")
    placed = t.isNotNull() & F.col(entity).isNotNull()
    seen = []
    for f in fields:
        can = F.col(entity).isNotNull() & F.col(f).isNotNull() & F.coalesce(usable.get(f, F.lit(True)), F.lit(False))
        seen.append(F.when(can & placed, F.struct(t.alias("t"), F.col(f).alias("v"))).alias(f"_o_{f}"))
        seen.append(F.when(can & ~placed, F.col(f)).alias(f"_u_{f}"))
    base = rows.select(packed, F.col(entity).alias("_e"), t.alias("_t"), F.floor(t / F.lit(slice_width)).alias("_slice"), *seen)
    ends = base.where("_e is not null and _t is not null").groupBy("_e", "_slice").agg(
        *[F.max(f"_o_{f}").alias(f"_last_{f}") for f in fields], *[F.min(f"_o_{f}").alias(f"_first_{f}") for f in fields]
    )
    before = Window.partitionBy("_e").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_e").orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("_e", "_slice", *[F.last(f"_last_{f}", True).over(before).alias(f"_p_{f}") for f in fields], *[F.first(f"_first_{f}", True).over(after).alias(f"_n_{f}") for f in fields])
    # within a slice, instants are looked at once each, however many rows they hold
    ticks = base.where("_e is not null and _t is not null").groupBy("_e", "_slice", "_t").agg(*[F.max(f"_o_{f}").alias(f"_o_{f}") for f in fields])
    up_to = Window.partitionBy("_e", "_slice").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = Window.partitionBy("_e", "_slice").orderBy("_t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    joined = ticks.join(carried, ["_e", "_slice"], "left")
    sides = []
    for f in fields:
        sides.append(F.coalesce(F.last(f"_o_{f}", True).over(up_to), F.col(f"_p_{f}")).alias(f"_b_{f}"))
        sides.append(F.coalesce(F.first(f"_o_{f}", True).over(on), F.col(f"_n_{f}")).alias(f"_a_{f}"))
    out = base.select("_row", "_e", "_t").join(joined.select("_e", "_t", *sides), ["_e", "_t"], "left")
    if undated:
        free = base.where("_e is not null").groupBy("_e").agg(*[F.max(f"_u_{f}").alias(f"_free_{f}") for f in fields], *[F.max(f"_o_{f}")["v"].alias(f"_late_{f}") for f in fields])
        out = out.join(free, "_e", "left")
    # distances first, null where a side has no neighbour within the gap; then the values from them
    for f in fields:
        within = (lambda d, limit=gap.get(f): d) if gap.get(f) is None else (lambda d, limit=gap.get(f): F.when(d <= limit, d))
        out = out.withColumn(f"_db_{f}", within(F.col("_t") - F.col(f"_b_{f}.t"))).withColumn(f"_da_{f}", within(F.col(f"_a_{f}.t") - F.col("_t")))
    picks = []
    for f, kind in fields.items():
        db, da, earlier, later = F.col(f"_db_{f}"), F.col(f"_da_{f}"), F.col(f"_b_{f}.v"), F.col(f"_a_{f}.v")
        carry = F.when(F.coalesce(db <= da, db.isNotNull()), earlier).when(da.isNotNull(), later)
        value, method = carry, F.when(F.coalesce(db, da).isNotNull(), "carried").otherwise("none")
        if kind == "number":
            value = F.coalesce(earlier + (later - earlier) * F.try_divide(db, db + da), carry)
            method = F.when((db + da).isNotNull(), "interpolated").otherwise(method)
        if undated:
            rest = F.coalesce(F.col(f"_free_{f}"), F.when(F.col("_t").isNull(), F.col(f"_late_{f}")))
            value, method = F.coalesce(value, rest), F.when((method == "none") & rest.isNotNull(), "undated").otherwise(method)
        own = F.col(f"_row.`{f}`")
        held = own.isNotNull()
        picks += [F.coalesce(own, value).alias(f"{f}_filled"), F.when(held, "observed").otherwise(method).alias(f"{f}_method"), F.when(held, 0.0).otherwise(F.least(db, da)).alias(f"{f}_distance")]
    names = {f"{f}_{n}" for f in fields for n in ("filled", "method", "distance")}
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c not in names], *picks)


def unanimous(rows: DataFrame, entity: str, value: Column) -> DataFrame:
    """(entity, agreed): the one value that all rows of the entity with a value hold; others have none."""
    held = rows.select(F.col(entity), value.alias("_v")).where(F.col("_v").isNotNull() & F.col(entity).isNotNull())
    both = held.groupBy(entity).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    return both.where("lo = hi").select(entity, F.col("lo").alias("agreed"))


def majority(rows: DataFrame, entity: str, value: Column, share: float = 0.5) -> DataFrame:
    """(entity, agreed): the value that more than ``share`` of the entity's rows with a value hold."""
    held = rows.select(F.col(entity), value.alias("_v")).where(F.col("_v").isNotNull() & F.col(entity).isNotNull())
    counts = held.groupBy(entity, "_v").agg(F.count("*").alias("n"))
    top = counts.groupBy(entity).agg(F.max(F.struct("n", "_v")).alias("top"), F.sum("n").alias("total"))
    return top.where(F.col("top.n") > share * F.col("total")).select(entity, F.col("top._v").alias("agreed"))
