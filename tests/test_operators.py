import difflib
import itertools
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakemason.functions import matchings
from lakemason.operators import dedupe, fill, joins, location, pairs, profile, resolve, review, rules, scored
from lakemason.operators.components import components
from lakemason.operators.modelling import conformal_rank, conformal_width, split_label
from lakemason.plans import matching


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))


def test_sequential_fold_is_no_row_number(spark):
    df = spark.createDataFrame([(1, "1", "a"), (2, "1", "b"), (3, "2", "b"), (4, "3", "a"), (5, "3", "c"), (6, None, None), (7, None, None)], "seq long, id string, url string")
    got = {r["seq"]: r["duplicate_reason"] for r in dedupe.sequential_fold(df, "seq", ["id", "url"], "x").collect()}
    assert got == {1: None, 2: "duplicate_id", 3: None, 4: "duplicate_url", 5: None, 6: None, 7: None}


def test_sequential_fold_against_a_plain_loop(spark):
    rng = random.Random(1)
    data = [(i, str(rng.randrange(40)), str(rng.randrange(40))) for i in range(150)]
    seen_a, seen_b, want = set(), set(), {}
    for i, a, b in data:
        want[i] = "duplicate_a" if a in seen_a else "duplicate_b" if b in seen_b else None
        if want[i] is None:
            seen_a.add(a), seen_b.add(b)
    df = spark.createDataFrame(data, "seq long, a string, b string")
    assert {r["seq"]: r["duplicate_reason"] for r in dedupe.sequential_fold(df, "seq", ["a", "b"], "x").collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    want = {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fill_against_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), float(rng.randrange(0, 3000)), rng.choice([None, float(rng.randrange(9))]), rng.choice([None, None, "x", "y"])) for i in range(120)] + [(900, None, 5.0, None, None), (901, "a", None, None, "x")]
    df = spark.createDataFrame(data, "id long, e string, t double, n double, c string")
    got = {r["id"]: r for r in fill.fill_in_time(df, "e", F.col("t"), {"n": "number", "c": "category"}, gap={"c": 200.0}, slice_width=100.0).collect()}
    for i, e, t, n, c in data:
        r = got[i]
        mates = [d for d in data if d[1] == e and e is not None and d[2] is not None]
        if n is None and e is not None and t is not None:
            before = max(((d[2], d[3]) for d in mates if d[3] is not None and d[2] <= t), default=None)
            after_t = min((d[2] for d in mates if d[3] is not None and d[2] >= t), default=None)
            after = None if after_t is None else (after_t, max(d[3] for d in mates if d[3] is not None and d[2] == after_t))
            if before and after:
                width = after[0] - before[0]
                want = before[1] + (after[1] - before[1]) * ((t - before[0]) / width) if width else before[1]
                assert r["n_method"] == "interpolated" and r["n_filled"] == pytest.approx(want)
            else:
                assert r["n_filled"] == (before or after or (None, None))[1]
        else:
            assert r["n_filled"] == n
        if c is None and e is not None and t is not None:
            near = [(abs(d[2] - t), d[2]) for d in mates if d[4] is not None and abs(d[2] - t) <= 200]
            assert (r["c_filled"] is None) == (not near) and (not near or r["c_distance"] == min(near)[0])


def test_fill_of_undated_rows(spark):
    """Rows without a time take no part in its order: they supply what no other does, and get the latest value."""
    rows = [("a", 1, 0.0, "x"), ("a", 2, 10.0, None), ("a", 3, None, None), ("a", 4, None, "z"), ("b", 5, None, "y"), ("b", 6, 5.0, None), ("b", 7, None, None), (None, 8, None, "w"), ("c", 9, 1.0, None)]
    df = spark.createDataFrame(rows, "e string, id long, t double, v string")
    got = {r["id"]: (r["v_filled"], r["v_method"], r["v_distance"]) for r in fill.fill_in_time(df, "e", F.col("t"), {"v": "category"}, undated=True).collect()}
    assert got[2] == ("x", "carried", 10.0) and got[3] == ("z", "undated", None) and got[6] == ("y", "undated", None) and got[7] == ("y", "undated", None) and got[9] == (None, "none", None)
    near = {r["id"]: r["v_filled"] for r in fill.fill_in_time(df, "e", F.col("t"), {"v": "category"}, gap={"v": 5.0}).collect()}
    assert near[2] is None and near[3] is None


def test_fill_keeps_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.0, None, "p", 7), ("a", 2.0, "x", "q", 8)], "e string, _t double, c string, _e string, _row int")
    got = fill.fill_in_time(df, "e", F.col("_t"), {"c": "category"}).orderBy("_t").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, None, "p", 7, "x", "carried", 1.0), ("a", 2.0, "x", "q", 8, "x", "observed", 0.0)]
    assert fill.fill_in_time(df.limit(0), "e", F.col("_t"), {"c": "category"}).count() == 0


def test_agreement(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "x"), ("b", "y"), ("b", "y"), (None, "x"), ("c", "x"), ("c", "y")], "e string, v string")
    assert rows(fill.unanimous(df, "e", F.col("v"))) == [("a", "x")]
    assert rows(fill.majority(df, "e", F.col("v"))) == [("a", "x"), ("b", "y")]


def test_joins(spark):
    left = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c"), (" ", "d"), (None, "e")], "k string, v string")
    right = spark.createDataFrame([("1", "z"), ("3", "y")], "k string, w string")
    assert rows(joins.coverage_problems(left, right, "k")) == [(" ", "blank_left"), ("2", "only_left"), ("2", "repeated_left"), ("3", "only_right"), (None, "blank_left")]
    with pytest.raises(ValueError, match="not one to one"):
        joins.one_to_one(left, right, "k")
    listed, others = joins.split_by_ids(left, "k", right)
    assert (listed.count(), others.count()) == (1, 4)
    base = spark.createDataFrame([(1, "a", 0), (2, " ", None), (4, None, 5)], "k int, t string, n int")
    upd = spark.createDataFrame([(1, "b", 9), (2, "c", 7), (3, "d", None)], "k int, t string, n int")
    assert rows(joins.merge_nonempty(base, upd, "k", {"n"})) == [(1, "a", 9), (2, "c", 7), (3, "d", None), (4, None, 5)]
    versions = spark.createDataFrame([("a", "u", 1), ("a", "u", 3), (None, "u2", 2), (" ", "u2", 4)], "id string, url string, seq int")
    assert rows(joins.upsert_last(versions, versions.limit(0), ["id", "url"], "seq")) == [(" ", "u2", 4), ("a", "u", 3)]


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(4)
    values = [float(v) for v in np.round(rng.lognormal(3, 2, 5000), 2)] + [7.0] * 500
    df = spark.createDataFrame([(v, -v * v) for v in values] + [(None, None)], "v double, w double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    hold, profile.HOLD = profile.HOLD, 50
    try:
        assert profile.exact_quantiles(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)))
        assert profile.exact_quantiles(df.limit(0), "v", shares) == [None] * 6
    finally:
        profile.HOLD = hold
    assert profile.spearman(df, "v", "w").first()["rho"] == pytest.approx(-1.0)
    order = sorted(values)
    mean = {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(values[:50])}
    got = {r["v"]: r["rank"] for r in profile.average_ranks(df, "v", "rank").collect()}
    assert all(got[v] == m for v, m in mean.items())
    assert [r["v"] for r in profile.systematic_sample(df.select("v").dropna().distinct(), "v", 7).orderBy("v").collect()] == sorted(set(values))[::7]


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 4)], "g string, n int")
    assert rows(profile.value_counts(df, "g", "Missing")) == [("Missing", 1), ("a", 2), ("b", 1)]
    assert rows(profile.coverage(df, ["g", "n"])) == [("g", 1, 3, 75.0), ("n", 1, 3, 75.0)]
    assert rows(profile.determined_values(spark.createDataFrame([("k", "x"), ("k", "x"), ("l", "x"), ("l", "y")], "k string, v string"), "k", "v", 2)) == [("k", "x")]
    assert profile.mode_by(spark.createDataFrame([("g", "b"), ("g", "a")], "g string, v string"), "g", "v").first()["mode_value"] == "a"
    assert profile.numeric_summary(df.limit(0), ["n"]).first()[1:] == (0, None, None, None)


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None), (4, 500.0)], "id int, v double")
    out = rules.classify(df, [rules.Rule("big", "reject", F.col("v") > 100), rules.Rule("some", "review", F.col("v") > 10)])
    assert rows(out.select("id", "record_status", "reject_reasons", "review_reasons")) == [(1, "accepted", [], []), (2, "review", [], ["some"]), (3, "accepted", [], []), (4, "rejected", ["big"], ["some"])]
    assert rows(rules.mark_duplicates(out, F.col("id") == 4).where("id = 4").select("record_status", "reject_reasons")) == [("duplicate", [])]
    with pytest.raises(ValueError, match="add up"):
        rules.reconcile({"a": 1}, 2)


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ([("3", "url", 20), ("3", "title", 60)], ("3", "title", [], [])), ([("3", "url", 20), ("4", "title", 60)], ("4", "title", ["url=3"], [])), ([("3", "title", 60), ("4", "url", 20)], ("3", "title", ["url=4"], [])),
        ([("99", "title", 60), ("4", "url", 20)], ("4", "url", [], ["title=99"])), ([(None, "title", 60)], (None, None, [], [])), ([], (None, None, [], [])),
    ],
)
def test_priority_resolution(spark, given, wanted):
    schema = "c array<struct<value: string, source: string, priority: int>>"
    df = spark.createDataFrame([([Row(value=v, source=s, priority=p) for v, s, p in given],)], schema)
    r = df.select(resolve.resolve(F.col("c"), valid=lambda v: v.try_cast("int").between(0, 15)).alias("r")).first()["r"]
    assert (r["value"], r["source"], list(r["conflicts"]), list(r["invalid"])) == wanted


def test_families_and_conflicts(spark):
    cands = F.array(resolve.candidate(F.lit("Condo"), "a", 20), resolve.candidate(F.lit("Penthouse"), "b", 40))
    r = spark.range(1).select(resolve.resolve(cands, families={"Penthouse": "Condo"}).alias("r")).first()["r"]
    assert (r["value"], r["source"], list(r["conflicts"])) == ("Penthouse", "b", [])
    fields = F.create_map(F.lit("bed_conflict"), F.lit("x"), F.lit("size_conflict"), F.lit(" "), F.lit("type_conflict"), F.lit("y"))
    assert spark.range(1).select(resolve.open_conflicts(fields, ["type"])).first()[0] == ["bed"]
    assert spark.range(1).select(resolve.add_message(F.lit("a || b"), F.lit("a"), " || ")).first()[0] == "a || b"


def test_pairs(spark):
    df = spark.createDataFrame([(1, "x", "time square riverside", 60.0), (2, "y", "time square", 62.0), (3, "x", "time square", 61.0), (4, "y", None, None)], "id int, src string, t string, s double")
    keyed = df.withColumn("blocks", pairs.block_keys({}, {"size": ([F.lit("c")], F.array(F.bround(F.col("s") / 5.0)))}))
    assert rows(pairs.candidate_pairs(keyed, "id", "src", "blocks")) == [(1, 2), (2, 3)]
    many = spark.range(3000).select("id", F.when(F.col("id") < 2, "x").otherwise("y").alias("src"), F.array(F.lit("one")).alias("blocks"))
    assert pairs.candidate_pairs(many, "id", "src", "blocks").count() == 2 * 2998  # no block is too large
    sim = spark.createDataFrame([("time square 306 riverside tower", "time square riverside tower"), ("", "a")], "a string, b string").select(pairs.title_similarity(F.col("a"), F.col("b"))).collect()
    assert sim[0][0] == pytest.approx(0.9310, abs=1e-4) and sim[1][0] == 0.0
    assert spark.createDataFrame([("tower of london bridges a",)], "t string").select(pairs.longest_words(F.col("t"))).first()[0] == ["bridges", "london", "tower"]


def test_met_pairs_leave_out_no_block(spark):
    data = [(f"{'pq'[i % 2]}{i:03d}", "xy"[i % 2], ["hot"] + [f"b{i % 7}"] * (i % 3) + [None] * (i % 2)) for i in range(401)] + [("z1", "x", [None]), ("z2", "y", [None]), ("z3", "x", [])]
    df = spark.createDataFrame(data, "id string, src string, blocks array<string>").withColumn("v", F.upper("id"))
    want = sorted((a, b, a.upper(), b.upper()) for a, s, _ in data[:401] for b, t, _ in data[:401] if a < b and s != t)
    for part in (10_000, 50):
        assert rows(pairs.met_pairs(df, "id", "src", "blocks", ["v"], part).select("a", "b", "v_a", "v_b")) == want


def _adverts(spark, folder, classified, agency):
    fields = {"listing_id": "string", "title": "string", "property_type": "string", "district": "string", "bedrooms": "int", "bathrooms": "int", "unit_floor": "int", "price_usd": "double", "size_m2": "double"}
    base = {"property_type": "Condo", "district": "Chamkar", "bedrooms": 2, "bathrooms": 2, "unit_floor": 9, "price_usd": 100000.0, "size_m2": 80.0}
    for name, adverts in (("clean_khmer24", classified), ("clean_harbor", agency)):
        spark.createDataFrame([tuple((base | a)[f] for f in fields) for a in adverts], ", ".join(f"{k} {v}" for k, v in fields.items())).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_scored_and_judged_pairs_without_near_price_or_size(spark, tmp_path):
    title = "riverside tower corner unit"
    unknown, far = {"listing_id": "k1", "title": title, "price_usd": None}, {"listing_id": "k2", "title": title, "price_usd": 150000.0, "size_m2": 120.0}
    sf = _adverts(spark, tmp_path, [unknown, far], [{"listing_id": "h1", "title": title}])
    assert rows(matching.scored_pairs(spark, sf).select("a", "b", "score")) == [("h1", "k1", 95.0), ("h1", "k2", 75.0)]
    assert rows(matching.judged_pairs(spark, sf)) == [("price_differs", 2)]


def test_scored_pairs_meet_under_each_surveyed_family(spark, tmp_path):
    classified = [
        {"listing_id": "k1", "title": "alpha", "size_m2": 200.0, "price_usd": 300000.0}, {"listing_id": "k2", "title": "bravo", "district": None},
        {"listing_id": "k3", "title": "charlie", "bedrooms": None, "price_usd": 100700.0}, {"listing_id": "k4", "title": "garden palace", "district": None, "bedrooms": None},
    ]
    sf = _adverts(spark, tmp_path, classified, [{"listing_id": "h1", "title": "garden palace"}])
    assert rows(matching.judged_pairs(spark, sf)) == [("price_differs", 1), ("strict", 1), ("title_too_different", 2)]


def test_judged_pairs_are_counted_not_listed(spark, tmp_path, monkeypatch):
    """The same counts as of all pairs in a plain loop, with nulls and ids of both sources; blocks of thousands without their pairs."""
    rng = random.Random(11)
    words = ["garden", "palace", "riverside", "tower", "flat", "unit", "lotus"]

    def advert(i):
        return {
            "listing_id": i, "title": " ".join(rng.sample(words, rng.randrange(1, 4))), "property_type": rng.choice(["Condo", "Condo", " condo", "Villa", None]), "district": rng.choice(["A", "a ", "B", "", "-", None]), "bedrooms": rng.choice([1, 2, None]),
            "unit_floor": rng.choice([3, 4, None]), "price_usd": rng.choice([None, 0.0, -97.0, -100.0, 97000.0, 100000.0, rng.uniform(9e4, 1.3e5)]), "size_m2": rng.choice([None, 80.0, 82.0, 78.0, rng.uniform(60, 90)]),
        }

    sides = [[advert(i) for i in ids] for ids in ([f"k{i}" for i in range(150)] + ["x1", "x2", "x3"], [f"h{i}" for i in range(120)] + ["x1", "x2", "x3", "z"])]
    sf = _adverts(spark, tmp_path / "small", *sides)
    met = matching._both(spark, sf).select("listing_id", "source", "blocks", "title_key", *[c for c in matching.SIDES if c not in ("title_key", "letters")]).collect()
    keys = {(r["listing_id"], r["source"]): {b for b in r["blocks"] if b} for r in met}
    like, want = {}, {}
    for x, y in itertools.product(*[[r for r in met if r["source"] == s] for s in ("clean_khmer24", "clean_harbor")]):
        a, b = sorted((x, y), key=lambda r: r["listing_id"])
        if a["listing_id"] == b["listing_id"] or not keys[a["listing_id"], a["source"]] & keys[b["listing_id"], b["source"]]:
            continue
        near = lambda c, least: None not in (a[c], b[c]) and abs(a[c] - b[c]) <= max(0.03 * max(abs(a[c]), abs(b[c])), least)  # noqa: B023, E731
        conflict = next((n for c, n in (("district", "district"), ("bedrooms", "bedrooms"), ("unit_floor", "floors")) if None not in (a[c], b[c]) and a[c] != b[c]), None)
        known = None not in (a["unit_floor"], b["unit_floor"])
        pair = (a["title_key"], b["title_key"])
        if pair not in like:
            sim, (m, n) = difflib.SequenceMatcher(None, *pair).ratio(), [set(t.split()) for t in pair]
            like[pair] = round(max(sim, len(m & n) / len(m | n)), 4)
        out = f"{conflict}_conflict" if conflict else "price_differs" if not near("price_usd", 0) else "size_differs" if not near("size_m2", 2.0) else "title_too_different" if like[pair] < (0.68 if known else 0.75) else "strict" if known else "uncertain"
        want[out] = want.get(out, 0) + 1
    assert len(want) == 8

    def listed(*_, **__):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(pairs, "met_pairs", listed)
    assert dict(rows(matching.judged_pairs(spark, sf))) == want
    large = _adverts(spark, tmp_path / "large", [{"listing_id": f"k{i:05d}", "title": f"kilo{i}", "unit_floor": i} for i in range(5000)], [{"listing_id": f"h{i:05d}", "title": "other", "unit_floor": -1 - i} for i in range(4000)])
    assert rows(matching.judged_pairs(spark, large)) == [("floors_conflict", 20_000_000)]


def test_scored_pairs_against_a_plain_loop(spark, tmp_path, monkeypatch):
    """All pairs, scores and likenesses, with nulls, empty and long titles and ids of both sources; blocks cut into parts."""
    rng = random.Random(21)
    words = ["garden", "palace", "riverside", "tower", "flat", "unit", "lotus", "corner", "ab", "northern gate of the old royal market"]

    def advert(i):
        return {
            "listing_id": i, "title": " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 9, 30]))), "property_type": rng.choice(["Condo", "Condo", " condo", "Villa", None]), "district": rng.choice(["A", "a ", "B", "", "-", None]), "bedrooms": rng.choice([1, 2, None]), "bathrooms": rng.choice([1, 2, None]),
            "unit_floor": rng.choice([3, 4, 6, None]), "price_usd": rng.choice([None, 0.0, -97.0, -100.0, 97000.0, 100000.0, rng.uniform(9e4, 1.3e5)]), "size_m2": rng.choice([None, 80.0, 82.0, 78.0, rng.uniform(60, 90)]),
        }

    sides = [[advert(i) for i in ids] for ids in ([f"k{i}" for i in range(110)] + ["x1", "x2", "x3", None], [f"h{i}" for i in range(90)] + ["x1", "x2", "x3", "z", None])]
    sf = _adverts(spark, tmp_path, *sides)
    met = [r for r in matching._both(spark, sf).select("listing_id", "source", "blocks", *[c for c in matching.SIDES if c != "letters"]).collect() if r["listing_id"]]
    like, want = {}, []
    for x, y in itertools.product(*[[r for r in met if r["source"] == s] for s in ("clean_khmer24", "clean_harbor")]):
        a, b = sorted((x, y), key=lambda r: r["listing_id"])
        if a["listing_id"] == b["listing_id"] or not {k for k in a["blocks"] if k} & {k for k in b["blocks"] if k}:
            continue
        near = lambda c, rel, least=0.0: None not in (a[c], b[c]) and abs(a[c] - b[c]) <= max(rel * max(abs(a[c]), abs(b[c])), least)  # noqa: B023, E731
        same = lambda c: a[c] is not None and a[c] == b[c]  # noqa: B023, E731
        around, beside = near("price_usd", 0.08) and near("size_m2", 0.08, 5.0), near("price_usd", 0.03) and near("size_m2", 0.03, 2.0)
        base = sum(w for c, w in (("property_type", 5), ("district", 15), ("bedrooms", 15), ("bathrooms", 5)) if same(c)) + 10 * near("unit_floor", 0.0, 1)
        base += 10 * (near("price_usd", 0.08) + near("price_usd", 0.03) + near("size_m2", 0.08, 5.0) + near("size_m2", 0.03, 2.0))
        pair = (a["title_key"], b["title_key"])
        if pair not in like:
            m, n = (set(t.split()) for t in pair)
            exact = max(difflib.SequenceMatcher(None, *pair).ratio(), len(m & n) / max(1, len(m | n))) if "" not in pair else 0.0
            like[pair] = float(Decimal(repr(exact)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        score = base + 10 * (like[pair] >= 0.84) + 8 * (like[pair] >= 0.68) + 7 * (like[pair] >= 0.5)
        if score >= 60 or same("bedrooms") and (beside or same("district") and around) or around and like[pair] >= 0.84:
            want.append((a["listing_id"], b["listing_id"], float(score), "high" if score >= 85 else "medium" if score >= 70 else "low", like[pair]))

    want.sort(key=lambda r: tuple(str(x) for x in r))

    def listed(*_, **__):
        raise AssertionError("all pairs of all blocks are listed")

    monkeypatch.setattr(pairs, "met_pairs", listed)
    assert len(want) > 300 and max(len(t) for p in like for t in p) > 400
    assert rows(matching.scored_pairs(spark, sf)) == want
    monkeypatch.setattr(scored, "PART", 7)
    assert rows(matching.scored_pairs(spark, sf)) == want


def test_ratios_are_those_of_the_sequence_matcher():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdé ខ") for _ in range(rng.randrange(n))) for n in (3, 20, 64, 66, 90, 199, 201, 300) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (150, 200) for _ in range(4)]
    t, n = matchings.Texts(texts), len(texts)
    a, b = (np.array([rng.randrange(n) for _ in range(6000)]) for _ in range(2))
    want = np.array([difflib.SequenceMatcher(None, texts[i], texts[j]).ratio() if texts[i] and texts[j] else 0.0 for i, j in zip(a, b, strict=True)])
    assert (matchings.ratios(t, a, b, np.zeros(len(a))) == want).all()
    some = matchings.ratios(t, a, b, np.full(len(a), 0.5))
    assert (some[want >= 0.5] == want[want >= 0.5]).all() and ((some == want) | (some == 0)).all() and (some == 0).sum() > 1000
    sets = [{w for w in x.split(" ") if w} for x in texts]
    assert list(matchings.common_words(t, a, b)) == [len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i, j in zip(a, b, strict=True)]


def test_scored_pairs_of_a_large_block(spark, tmp_path):
    sf = _adverts(spark, tmp_path, [{"listing_id": f"k{i:03d}", "title": f"kilo{i}"} for i in range(310)], [{"listing_id": "h1", "title": "other"}])
    assert matching.scored_pairs(spark, sf).count() == 310


def test_band_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("pq"), rng.uniform(20, 40), rng.uniform(1e5, 1.3e5)) for i in range(120)]
    got = rows(dedupe.band_pairs(spark.createDataFrame(data, "id int, d string, s double, p double"), "id", ["d"], "s", 2.0, "p", 0.03))
    want = [(a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 2 and abs(a[3] - b[3]) <= 0.03 * max(a[3], b[3])]
    assert sorted(got) == want


def test_location(spark):
    df = spark.createDataFrame([("a", "D", "c1"), ("b", "D", "c1"), ("c", "D", "c1"), ("d", None, "c1"), ("e", None, "c2"), ("f", "E", "c2"), ("g", "F", "c2"), ("h", "E", "c2")], "id string, district string, commune string")
    out = location.waterfall(df, "district", [("commune", location.learned_fill("commune", "district", 3))])
    assert rows(out.where("id in ('d', 'e')").select("id", "district", "district_source")) == [("d", "D", "commune"), ("e", None, None)]
    points = spark.createDataFrame([(1, 11.5, 104.9), (2, 11.5, 104.9), (3, 10.6, 103.5), (4, None, 1.0), (5, 11.6, 104.8)], "id int, la double, lo double")
    assert [r[1] for r in rows(location.check_coordinates(points, "la", "lo", (11.3, 11.8, 104.7, 105.1)).select("id", "coordinate_check"))] == ["review_duplicate_coordinate", "review_duplicate_coordinate", "invalid_outside", "missing", "valid"]


def test_review(spark):
    df = spark.createDataFrame([("1", 5.0, 2), ("2", 6.0, 3)], "id string, price double, rooms int")
    given = spark.createDataFrame([("1", "7.5", "x")], "id string, corrected_price string, corrected_rooms string")
    assert rows(review.apply_corrections(df, given, "id", {"price": "double", "rooms": "int"})) == [("1", 7.5, 2, "price: 5.0 -> 7.5"), ("2", 6.0, 3, "")]
    pairs_ = spark.createDataFrame([("1", "2", "duplicate", "n", "1"), ("2", "3", "Duplicate", "n", "3"), ("4", "5", "keep", "n", None)], "a string, b string, manual_decision string, manual_note string, keep_listing_id string")
    actions = review.pair_actions(pairs_)
    assert rows(actions) == [("2", "1"), ("2", "3")]
    assert rows(review.conflicting_actions(actions)) == [("2", 2)]
    bad = spark.createDataFrame([("1", "approve", "ok"), ("2", "maybe", " "), ("3", None, "x")], "id string, d string, n string")
    assert rows(review.decision_problems(bad, "id", "d", "n", ["approve", "reject"])) == [("2", "missing_note"), ("2", "unknown_decision"), ("3", "unknown_decision")]


def test_conformal(spark):
    assert (conformal_rank(268), conformal_rank(10)) == (216, 9)
    df = spark.createDataFrame([(float(i) * (-1) ** i,) for i in range(268)], "r double")
    assert conformal_width(df, "r") == 216.0
    assert conformal_width(df.limit(0), "r") is None
    n = spark.range(20000).select(split_label(F.col("id")).alias("s")).groupBy("s").count().collect()
    assert abs({r["s"]: r["count"] for r in n}["train"] / 20000 - 0.7) < 0.02
