"""Conflicting values of one field: candidates by source priority, folded in order, with lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<value: string, source: string, priority: int, conflicts: array<string>, invalid: array<string>>"


def candidate(value: Column, source: str, priority: int) -> Column:
    return F.struct(value.cast("string").alias("value"), F.lit(source).alias("source"), F.lit(priority).alias("priority"))


def resolve(candidates: Column, valid=None, same=None, families: dict[str, str] | None = None, weak: int = 0) -> Column:
    """Fold an array of candidates, in order, into struct(value, source, priority, conflicts, invalid).

    A missing candidate changes nothing; one that ``valid`` (value -> condition) refuses goes
    to ``invalid``. The first valid one fills the field. A later one that agrees (``same``, by
    default equality; a general value agrees with its specific one, given by ``families`` as
    specific -> general, and the specific stays) raises the source if it ranks higher; one
    that disagrees replaces it only if it ranks higher, and the loser is noted unless its
    priority is ``weak`` or less.
    """
    families = families or {}
    general = lambda v: F.coalesce(*[F.when(v == k, F.lit(g)) for k, g in families.items()], v)
    agree = same or (lambda a, b: (a == b) | (general(a) == b) | (general(b) == a))
    ok = valid or (lambda v: v.isNotNull())
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(-1).alias("priority"), empty.alias("conflicts"), empty.alias("invalid"))

    def state(value: Column, source: Column, priority: Column, conflicts: Column, invalid: Column) -> Column:
        return F.struct(value.alias("value"), source.alias("source"), priority.alias("priority"), conflicts.alias("conflicts"), invalid.alias("invalid"))

    def step(acc: Column, c: Column) -> Column:
        value, priority = c["value"], c["priority"]
        usable = F.coalesce(ok(value), F.lit(False))
        agrees = F.coalesce(agree(acc["value"], value), F.lit(False))
        higher = priority > acc["priority"]
        specific = F.when(general(value) == acc["value"], value).otherwise(acc["value"]) if families else acc["value"]
        note = F.concat(c["source"], F.lit("="), value)
        lost = F.concat(acc["source"], F.lit("="), acc["value"])
        noted = lambda text, rank: F.when(rank > weak, F.array_append(acc["conflicts"], text)).otherwise(acc["conflicts"])
        return (
            F.when(value.isNull(), acc)
            .when(~usable, state(acc["value"], acc["source"], acc["priority"], acc["conflicts"], F.array_append(acc["invalid"], note)))
            .when(acc["value"].isNull(), state(value, c["source"], priority, acc["conflicts"], acc["invalid"]))
            .when(agrees, state(specific, F.when(higher, c["source"]).otherwise(acc["source"]), F.greatest(priority, acc["priority"]), acc["conflicts"], acc["invalid"]))
            .when(higher, state(value, c["source"], priority, noted(lost, acc["priority"]), acc["invalid"]))
            .otherwise(state(acc["value"], acc["source"], acc["priority"], noted(note, priority), acc["invalid"]))
        )

    return F.aggregate(candidates, start.cast(STATE), lambda acc, c: step(acc, c).cast(STATE))


def recover(existing: Column, title: Column, description: Column) -> Column:
    """struct(value, source, confidence, raw, conflict): a field completed from text, never overwritten.

    title and description are extraction results struct(value, raw) or null.
    """
    differ = lambda r, name: F.when(existing.isNotNull() & (r["value"] != existing), F.concat(F.lit(f"{name}="), r["value"].cast("string"), F.lit(" from '"), r["raw"], F.lit("'")))
    conflicts = F.array_join(F.array_compact(F.array(differ(title, "title"), differ(description, "description"))), "; ")
    held, from_title = existing.isNotNull(), title["value"].isNotNull()
    described = description["value"].isNotNull()
    return F.struct(
        F.coalesce(existing, title["value"], description["value"]).alias("value"),
        F.when(held, "structured").when(from_title, "title").when(described, "description").alias("source"),
        F.when(~held & from_title, "high").when(~held & described, "medium").alias("confidence"),
        F.when(~held, F.coalesce(title["raw"], description["raw"])).alias("raw"),
        F.when(conflicts != "", conflicts).alias("conflict"),
    )


def open_conflicts(fields: Column, resolved: list[str], ending: str = "_conflict") -> Column:
    """Sorted names of fields with an unresolved conflict, from a map of dynamic columns."""
    held = F.map_filter(fields, lambda k, v: k.endswith(ending) & v.isNotNull() & (F.trim(v) != ""))
    names = F.transform(F.map_keys(held), lambda k: F.regexp_replace(k, f"{ending}$", ""))
    return F.array_sort(F.array_except(names, F.array(*[F.lit(r) for r in resolved]).cast("array<string>")))


def conflict_counts(df: DataFrame, fields: str, ending: str = "_conflict") -> DataFrame:
    """(key, n) of dynamic conflict columns."""
    held = F.map_filter(F.col(fields), lambda k, v: k.endswith(ending) & v.isNotNull() & (F.trim(v) != ""))
    return df.select(F.explode(F.map_keys(held)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def add_message(messages: Column, message: Column, sep: str = "; ") -> Column:
    """A joined ordered set of messages with one more."""
    parts = F.filter(F.split(F.coalesce(messages, F.lit("")), F.lit(sep.replace("|", r"\|"))), lambda m: m != "")
    joined = F.array_join(F.array_distinct(F.array_compact(F.concat(parts, F.array(message)))), sep)
    return F.when(joined != "", joined)
