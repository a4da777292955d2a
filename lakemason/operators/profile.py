"""Data profiling: counts, coverage, summaries, quantiles, outliers, correlations, crosstabs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
#: Values that the driver sorts at the end of an exact quantile search.
HOLD = 200_000


def value_counts(df: DataFrame, column: str, missing: str | None = None, share: bool = False) -> DataFrame:
    """(value, n[, pct]); null counted as ``missing``, or left out where that is None."""
    value = F.col(column).cast("string") if missing is None else F.coalesce(F.col(column).cast("string"), F.lit(missing))
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    if not share:
        return counts
    total = df.where(value.isNotNull()).count()
    return counts.select("value", "n", F.round(100 * F.col("n") / F.lit(max(total, 1)), 2).alias("pct"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, missing, non_missing, pct) for each column, in one pass."""
    one = df.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(F.col(c)).alias("non_missing")) for c in columns]).alias("all"))
    long = one.select("n", F.explode("all").alias("s"))
    held = F.col("s.non_missing")
    return long.select("s.column_name", (F.col("n") - held).alias("missing"), held.alias("non_missing"), F.when(F.col("n") > 0, F.round(100 * held / F.col("n"), 1)).alias("pct"))


def coverage_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.round(100 * F.avg(F.col(c).isNotNull().cast("int")), 1).alias(f"{c}_pct") for c in columns])


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, low, high, mean) with two decimals; nulls where a column is empty."""
    aggs = [a for c in columns for a in (F.count(c).alias(f"{c}_n"), F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi"), F.avg(c).alias(f"{c}_mean"))]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("n"), F.round(f"{c}_lo", 2).alias("low"), F.round(f"{c}_hi", 2).alias("high"), F.round(f"{c}_mean", 2).alias("mean")) for c in columns])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def type_profile(df: DataFrame, record: str) -> DataFrame:
    """(key, kind, n): runtime types of the top-level keys of JSON records, malformed ones left out."""
    pairs = df.select(F.explode(F.from_json(record, "map<string,string>")).alias("key", "text"))
    kind = (
        F.when(F.col("text").isNull(), "null").when(F.col("text").isin("true", "false"), "boolean").when(F.col("text").rlike(r"^-?\d+$"), "integer")
        .when(F.col("text").rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), "number").when(F.col("text").startswith("{"), "object").when(F.col("text").startswith("["), "array").otherwise("string")
    )
    return pairs.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of one column with linear interpolation between neighbours: see quantiles_of."""
    return quantiles_of(df, {column: shares})[column]


def quantiles_of(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns together, without a sort of all rows.

    A histogram of all columns finds the narrow bin of each wanted rank; the bins are searched
    again until few values are left, which alone come to one place. Each level is one job over
    the rows for all columns and ranks; nothing larger than BINS counts a rank, or HOLD values
    in all, is gathered. Nulls and NaN are left out; None where nothing is left.
    """
    names = list(wanted)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])
    held = df.select(F.explode(cells).alias("x")).select("x.c", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = {r["c"]: r for r in held.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    places = {i: [(sizes[i]["n"] - 1) * s for s in wanted[n]] for i, n in enumerate(names) if i in sizes}
    ranks = {i: sorted({r for p in at for r in (math.floor(p), math.ceil(p))}) for i, at in places.items()}
    found: dict[tuple[int, int], float] = {}
    open_ = [(i, sizes[i]["lo"], sizes[i]["hi"], sizes[i]["n"], 0, own) for i, own in ranks.items()]
    while open_:
        for i, lo, _, _, _, own in (x for x in open_ if x[1] == x[2]):
            found |= {(i, r): lo for r in own}
        open_ = [x for x in open_ if x[1] < x[2]]
        within = lambda x: (F.col("c") == x[0]) & F.col("v").between(x[1], x[2])
        most = HOLD // max(1, len(open_))
        large = [x for x in open_ if x[3] > most]
        if not large:
            kept: dict[int, list[float]] = {k: [] for k in range(len(open_))}
            if open_:
                for k, v in held.select(F.coalesce(*[F.when(within(x), F.lit(k)) for k, x in enumerate(open_)]).alias("k"), "v").where("k is not null").collect():
                    kept[k].append(v)
            for k, (i, _, _, _, before, own) in enumerate(open_):
                kept[k].sort()
                found |= {(i, r): kept[k][r - before] for r in own}
            break
        slot = lambda x: F.least(F.floor((F.col("v") - x[1]) / ((x[2] - x[1]) / BINS)), F.lit(BINS - 1)).cast("int")
        at = F.coalesce(*[F.when(within(x), F.lit(k * BINS) + slot(x)) for k, x in enumerate(large)])
        counts = held.select(at.alias("slot"), "v").where("slot is not null").groupBy("slot").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        open_ = [x for x in open_ if x[3] <= most]
        before = {k: x[4] for k, x in enumerate(large)}
        for row in sorted(counts):
            k = row["slot"] // BINS
            own = [r for r in large[k][5] if before[k] <= r < before[k] + row["n"]]
            if own:
                open_.append((large[k][0], row["lo"], row["hi"], row["n"], before[k], own))
            before[k] += row["n"]
    between = lambda i, p: found[i, math.floor(p)] + (found[i, math.ceil(p)] - found[i, math.floor(p)]) * (p - math.floor(p))
    return {n: [between(i, p) for p in places[i]] if i in places else [None for _ in wanted[n]] for i, n in enumerate(names)}


def describe(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(column_name, stat, value): count, mean, std (sample), min, exact quantiles, max."""
    one = df.agg(*[F.array(F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    found, rows = quantiles_of(df, dict.fromkeys(columns, shares)), []
    for i, c in enumerate(columns):
        n, mean, std, low, high = one[f"_{i}"]
        stats = [("count", n), ("mean", mean), ("std", std), ("min", low), *[(f"p{round(100 * s):02d}", q) for s, q in zip(shares, found[c], strict=True)], ("max", high)]
        rows += [(c, s, None if v is None else round(float(v), 6)) for s, v in stats]
    return df.sparkSession.createDataFrame(rows, "column_name string, stat string, value double")


def object_summary(df: DataFrame, column: str) -> DataFrame:
    """(n, n_unique, top, freq) of a text column; ties go to the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    top = F.min_by("v", F.struct((-F.col("n")).alias("n"), "v"))
    return counts.agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), top.alias("top"), F.max("n").alias("freq"))


def outliers(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """One row: fences at quartiles -/+ reach x their distance, and how many rows lie strictly beyond."""
    q1, q3 = exact_quantiles(df, column, (0.25, 0.75))
    low, high = (None, None) if q1 is None else (q1 - reach * (q3 - q1), q3 + reach * (q3 - q1))
    beyond = (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high))
    return df.agg(F.lit(column).alias("column_name"), F.round(F.lit(low).cast("double"), 4).alias("low_fence"), F.round(F.lit(high).cast("double"), 4).alias("high_fence"), F.count_if(beyond).alias("n_outliers"), F.round(F.try_divide(100 * F.count_if(beyond), F.count(column)), 2).alias("pct"))


def cap_at_quantile(df: DataFrame, column: str, share: float) -> DataFrame:
    """Rows up to a quantile of a column, it included."""
    return df.where(F.col(column) <= F.lit(exact_quantiles(df, column, (share,))[0]))


def sample_skewness(column: str) -> Column:
    """The sample-adjusted coefficient (G1) from the population one."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every unordered pair, rows with both values only."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}~{b}`"), 6).alias("r")) for a, b in pairs])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def average_ranks(df: DataFrame, column: str, rank: str) -> DataFrame:
    """Adds the average rank (from 1; ties share theirs). Rows without a value are left out.

    Ranks come from counts of values: within slices of the value range by a window each, and
    across slices by a window over the slices alone - no window spans all rows.
    """
    held = df.where(F.col(column).isNotNull())
    lo, hi = held.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    width = ((hi - lo) / BINS if hi is not None and hi > lo else 1.0) or 1.0
    counts = held.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_s", F.floor((F.col("_v") - F.lit(lo or 0.0)) / width))
    slices = counts.groupBy("_s").agg(F.sum("_n").alias("_m"))
    slices = slices.withColumn("_before", F.sum("_m").over(Window.orderBy("_s")) - F.col("_m"))  # BINS + 1 rows at most
    below = F.sum("_n").over(Window.partitionBy("_s").orderBy("_v")) - F.col("_n")
    ranks = counts.join(slices, "_s").select("_v", (F.col("_before") + below + (F.col("_n") + 1) / 2).alias(rank))
    return held.join(ranks, held[column] == ranks["_v"]).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, rho): Pearson's correlation of average ranks over rows that hold both values."""
    both = df.select(a, b).dropna()
    ranked = average_ranks(average_ranks(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) of equal-width bins over [low, high]; the last bin is closed; values outside are left out."""
    v = F.col(column)
    slot = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(v.between(low, high)).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], missing: str) -> DataFrame:
    """Counts with a column for each listed value, 0 where there are none; null is ``missing``."""
    keyed = df.withColumn("_c", F.coalesce(F.col(column).cast("string"), F.lit(missing)))
    return keyed.groupBy(*rows).pivot("_c", list(values)).agg(F.count(F.lit(1))).fillna(0, list(values))


def mode_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("mode_value"), F.max("_n").alias("mode_n"))


def determined_values(df: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    """(key, value) of keys that stand with exactly one value on ``least`` rows or more."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.count("*").alias("_k"), F.sum("_n").alias("_t"), F.min(value).alias(value)).where((F.col("_k") == 1) & (F.col("_t") >= least)).select(key, value)


def template_default(df: DataFrame, column: str, share: float = 0.5, least: int = 20) -> DataFrame:
    """(top_value, n, total) where one value makes up more than ``share`` of ``least`` values or more: a template's default."""
    counts = value_counts(df, column)
    return counts.agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"), F.max("n").alias("n"), F.sum("n").alias("total")).where((F.col("total") >= least) & (F.col("n") > share * F.col("total")))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(rmse, mae, mape, r2), percentages over non-zero actuals."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    total = F.var_pop(y) * F.count(y)
    return df.where(y.isNotNull() & F.col(predicted).isNotNull()).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (100 * F.avg(F.when(y != 0, F.abs(e / y)))).alias("mape"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"))


def systematic_sample(df: DataFrame, order: str, step: int) -> DataFrame:
    """Every ``step``-th row in order, from the first.

    Positions come from counts of value slices, so only one slice's rows meet in a window.
    """
    lo, hi = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    width = max(((hi or 0.0) - (lo or 0.0)) / BINS, 1e-9)
    sliced = df.withColumn("_s", F.floor((F.col(order) - F.lit(lo or 0.0)) / width))
    sizes = sliced.groupBy("_s").agg(F.count("*").alias("_m"))
    sizes = sizes.select("_s", (F.sum("_m").over(Window.orderBy("_s")) - F.col("_m")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy(order)) + F.col("_before") - 1
    return sliced.join(sizes, "_s").withColumn("_p", place).where(F.col("_p") % step == 0).drop("_s", "_before", "_p")


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n, low, q1, median, q3, high) with exact quartiles."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.where(F.col(column).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(column).alias("low"), q.alias("q"), F.max(column).alias("high"))
    return one.select(group, "n", "low", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high")


def distribution_by(df: DataFrame, group: str, groups: Sequence[str], column: str) -> DataFrame:
    """(value, one share in percent for each group): distributions side by side, 0 where a group lacks a value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(*[F.count_if(F.col(group) == g).alias(f"_{i}") for i, g in enumerate(groups)])
    totals = df.where(F.col(column).isNotNull()).agg(*[F.count_if(F.col(group) == g) for g in groups]).first()
    return counts.select("value", *[F.round(100 * F.col(f"_{i}") / max(totals[i], 1), 2).alias(g) for i, g in enumerate(groups)])


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows drawn by a hash of their key: the same on every run and cluster, without a full sort."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
