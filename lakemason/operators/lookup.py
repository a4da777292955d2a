"""Resolving typed values against a reference list, once per distinct value."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemason.functions.names import Gazetteer
from lakemason.sources.tables import widen

#: Entries of the reference list that one task holds at a time; a longer list is worked
#: off in blocks of this size, each against all values, and the best entry of all wins.
BLOCK_ENTRIES = 50_000


def resolve_values(values: DataFrame, value: str, mapping: DataFrame, raw: str, standard: str, make: Callable = Gazetteer) -> DataFrame:
    """One row (value, standard, likeness) for each distinct non-null ``value``.

    ``standard`` is null where the value stands for no entry. Null entries of the list are
    ignored; an alias listed for two names stands for neither; an empty list leaves every
    value unmatched. Values that differ only in bytes are resolved once per distinct value.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    distinct = widen(distinct)  # comparing names is slow, and names are short
    entries = mapping.select(F.col(raw).alias("raw"), F.col(standard).alias("standard")).dropna().distinct()
    n_blocks = max(1, math.ceil(entries.count() / BLOCK_ENTRIES))
    scored = None
    for block in range(n_blocks):
        part = entries if n_blocks == 1 else entries.where(F.pmod(F.xxhash64("standard"), F.lit(n_blocks)) == block)
        pairs = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def score(batches: Iterator[pd.DataFrame], pairs=pairs) -> Iterator[pd.DataFrame]:
            names = make(pairs.value)
            for batch in batches:
                out = [(v, s, p) for v in batch["value"] for s, p in names.ranked(v) or [(None, 0.0)]]
                yield pd.DataFrame(out, columns=["value", "standard", "likeness"])

        got = distinct.mapInPandas(score, "value string, standard string, likeness double")
        scored = got if scored is None else scored.unionByName(got)
    limits = make([])
    pick = F.array_sort(F.collect_list(F.struct((-F.col("likeness")).alias("far"), "standard")))
    best = scored.groupBy("value").agg(pick.alias("ranked"))  # two rows a block at most
    first, second = F.col("ranked")[0], F.try_element_at("ranked", F.lit(2))
    gap = F.when(first["far"] > -0.9, F.lit(limits.margin)).otherwise(1e-9)
    unclear = second.isNotNull() & second["standard"].isNotNull() & (second["far"] - first["far"] < gap)
    ok = (first["far"] <= -limits.threshold) & ~F.coalesce(unclear, F.lit(False))
    return best.select("value", F.when(ok, first["standard"]).alias("standard"), (-first["far"]).alias("likeness"))
