"""Mapping free-entered values to a canonical list.

Method: a multi-pattern automaton over canonical names and aliases finds embedded mentions,
the longest non-overlapping match wins, and remaining values go to token-set likeness.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemason.functions.names import Gazetteer
from lakemason.operators.lookup import resolve_values

UNMATCHED = "UNMATCHED"


class MentionGazetteer(Gazetteer):
    """A gazetteer that looks for whole mentions with an automaton before it compares letters."""

    def __init__(self, pairs, **limits) -> None:
        super().__init__(pairs, **limits)
        self.automaton = ahocorasick.Automaton()
        for key, standard in self.exact.items():
            if standard:
                self.automaton.add_word(f" {key} ", (len(key) + 1, standard))
        if len(self.automaton):
            self.automaton.make_automaton()

    def mentions(self, value: str) -> list[tuple[int, int, str]]:
        """Longest non-overlapping (start, end, canonical name) in the value's words."""
        if not len(self.automaton):
            return []
        text = f" {' '.join(self.words(value))} "
        hits = [(end - size, end, standard) for end, (size, standard) in self.automaton.iter(text)]
        taken: list[tuple[int, int, str]] = []
        for hit in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(hit[1] <= t[0] or hit[0] >= t[1] for t in taken):
                taken.append(hit)
        return taken

    def ranked(self, value: str) -> list[tuple[str, float]]:
        """A mentioned name with likeness 1, the first two where several are; else by likeness."""
        named = list(dict.fromkeys(standard for _, _, standard in self.mentions(value)))
        return [(standard, 1.0) for standard in named[:2]] or super().ranked(value)


def canonicalise(rows: DataFrame, key: str, value: str, mapping: DataFrame, raw: str = "raw_name", standard: str = "standard_name") -> DataFrame:
    """One row (key, value, standard, likeness) for each distinct key and non-null value.

    ``standard`` is ``UNMATCHED`` where the value stands for no entry: blank values, words
    that name no place, values that mention two entries, and values as close to two. Null values give no row. An
    empty list leaves everything unmatched. Rows that repeat key and value count once.
    Every distinct value is resolved once, so a value held by a third of all rows costs one
    look-up; the join back is by value, where the adaptive planner splits a hot value.
    """
    pairs = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    names = resolve_values(rows, value, mapping, raw, standard, MentionGazetteer)
    out = pairs.join(names, "value", "left")
    return out.select("key", "value", F.coalesce("standard", F.lit(UNMATCHED)).alias("standard"), F.coalesce("likeness", F.lit(0.0)).alias("likeness"))


def unmatched_report(resolved: DataFrame) -> DataFrame:
    """Values that stand for no entry, with the number of keys that hold them."""
    return resolved.where(F.col("standard") == UNMATCHED).groupBy("value").agg(F.count("*").alias("n_keys"))
