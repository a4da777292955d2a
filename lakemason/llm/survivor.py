"""Best representative of each duplicate group, field by field.

Method: currency reasoning. Timestamped rows teach which value of a field tends to follow
which (value-transition precedence). Within a group the values of the most trusted members
form a partial order: by time where both have one, by learned precedence where one's time is
missing or both are equal. The topologically latest value survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of the even prior on each learned transition.
SMOOTHING = 1.0
#: Seconds of the slices into which a group's history is cut, so that no window holds all of it.
SLICE = 7 * 86_400


def long_form(members: DataFrame, group: str, fields: dict[str, Column], trust: Column, time: Column) -> DataFrame:
    """(group, field_name, value, trust, time) of each member and field that holds a value."""
    held = F.array(*[F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("value")) for name, value in fields.items()])
    rows = members.select(F.col(group).alias("grp"), trust.alias("trust"), time.alias("time"), F.explode(held).alias("h"))
    return rows.select("grp", "h.field_name", "h.value", "trust", "time").where(F.col("value").isNotNull() & F.col("grp").isNotNull())


def learn_transitions(held: DataFrame) -> DataFrame:
    """(field_name, older, newer, wins, share): how often ``newer`` followed ``older`` in time.

    Consecutive different values of one group and field count, the greatest value of an
    instant standing for it; share is smoothed towards a half by the opposite direction's
    count. Histories are looked at slice by slice, and one row a slice is carried on. The
    table grows with the pairs of values, which are pre-aggregated on the map side.
    """
    keys = ["grp", "field_name"]
    ticks = held.where(F.col("time").isNotNull()).groupBy(*keys, "time").agg(F.max("value").alias("value"))
    ticks = ticks.withColumn("slice", F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / SLICE))
    ends = ticks.groupBy(*keys, "slice").agg(F.max(F.struct("time", "value")).alias("end"), F.min("time").alias("start"))
    carried = ends.select(*keys, F.col("start").alias("time"), F.lag("end.value").over(Window.partitionBy(*keys).orderBy("slice")).alias("carried"))
    within = F.lag("value").over(Window.partitionBy(*keys, "slice").orderBy("time"))
    steps = (
        ticks.withColumn("within", within).join(carried, [*keys, "time"], "left")
        .select("field_name", F.coalesce("within", "carried").alias("older"), F.col("value").alias("newer"))
        .where("older <> newer").groupBy("field_name", "older", "newer").agg(F.count("*").alias("wins"))
    )
    back = steps.select("field_name", F.col("older").alias("newer"), F.col("newer").alias("older"), F.col("wins").alias("losses"))
    both = steps.join(back, ["field_name", "older", "newer"], "left").fillna(0, ["losses"])
    share = (F.col("wins") + SMOOTHING) / (F.col("wins") + F.col("losses") + 2 * SMOOTHING)
    return both.select("field_name", "older", "newer", "wins", share.alias("share"))


def survivors(held: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """One row (grp, field_name, value, basis, n_values) for each group and field.

    The most trusted members decide (null trust is least). Of their values, those of the
    latest time and those without a time are on the front; learned precedence (a share above a
    half) draws arcs from older to newer values of the front, and a value that no arc leaves is
    topologically latest. Of several such values one with a time goes first, then one that more
    arcs reach, then the smallest string, so repeated runs agree. Where arcs close a circle and
    no value is latest, the one goes first whose arcs weigh least. ``basis`` says what decided:
    ``single`` value, ``trust_time``, ``precedence`` or ``tie``. Groups without any held value
    have no row. Everything is pre-aggregated per group, field and value first, so a group with
    a third of all rows never meets in one task.
    """
    keys = ["grp", "field_name"]
    per_value = held.groupBy(*keys, "value").agg(F.max(F.struct(F.coalesce("trust", F.lit(-(2**31))).alias("trust"), F.col("time").isNotNull().alias("timed"), "time")).alias("best"))
    top = per_value.groupBy(*keys).agg(F.max("best").alias("top"), F.max("best.trust").alias("trust"), F.count("*").alias("n_values"))
    front = per_value.join(top, keys).where((F.col("best.trust") == F.col("trust")) & ((F.col("best") == F.col("top")) | ~F.col("best.timed")))
    size = front.groupBy(*keys).agg(F.count("*").alias("n_front"), F.min("value").alias("only"), F.max("n_values").alias("n_values"))
    clear = size.where("n_front = 1").select(*keys, F.col("only").alias("value"), F.when(F.col("n_values") == 1, "single").otherwise("trust_time").alias("basis"), "n_values")
    tied = front.join(size.where("n_front > 1").select(*keys), keys).select(*keys, "value", "n_values", F.col("best.timed").alias("timed"))
    if transitions is None:
        transitions = learn_transitions(held)
    arcs = tied.select(*keys, F.col("value").alias("older")).join(transitions.where("share > 0.5").select("field_name", "older", "newer", "share"), ["field_name", "older"])
    arcs = arcs.join(tied.select(*keys, F.col("value").alias("newer")), [*keys, "newer"])
    ends = arcs.select(*keys, F.inline(F.array(F.struct(F.col("older").alias("value"), F.col("share").alias("lost"), F.lit(0).alias("reached")), F.struct(F.col("newer").alias("value"), F.lit(0.0).alias("lost"), F.lit(1).alias("reached")))))
    placed = tied.join(ends.groupBy(*keys, "value").agg(F.sum("lost").alias("lost"), F.sum("reached").alias("reached")), [*keys, "value"], "left").fillna(0, ["lost", "reached"])
    rank = F.struct(F.col("lost").alias("lost"), (~F.col("timed")).alias("undated"), (-F.col("reached")).alias("reached"), "value")
    won = placed.groupBy(*keys).agg(F.min(rank).alias("w"), F.max(F.col("reached") > 0).alias("ordered"), F.max("n_values").alias("n_values"))
    basis = F.when(F.col("ordered"), "precedence").otherwise("tie").alias("basis")
    return clear.unionByName(won.select(*keys, F.col("w.value").alias("value"), basis, "n_values"))
