import json

import pytest
from pyspark.sql import functions as F

from lakemason.functions import html as H
from lakemason.operators import evidence, modelling, sequences


def test_numbering(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "v int, i int").repartition(7)
    got = {r["v"]: r["row_no"] for r in sequences.numbered(df, [F.col("v")]).collect()}
    assert got == {v: v + 1 for v in range(101)}
    assert sequences.pair_ids(df.where("v < 2"), [F.desc("v")]).orderBy("v").select("pair_id").collect()[0][0] == "pair_00002"
    assert sequences.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_stop_page(spark):
    pages = [("s", 1, ["a", "b"]), ("s", 2, ["c"]), ("s", 3, ["a"]), ("s", 4, []), ("s", 5, ["d"]), ("t", 1, ["x"]), ("t", 2, ["y"])]
    df = spark.createDataFrame(pages, "site string, page int, links array<string>")
    assert {r["site"]: r["last_page"] for r in sequences.stop_page(df, "site", "page", "links").collect()} == {"s": 4, "t": 2}


def test_validation(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", -1.0, None), ("b", None, "z")], "k string, n double, d string")
    assert sorted(map(tuple, evidence.violations(df, "k", ["d"], ["n"], {"d": ["x"]}).collect())) == [("a", "missing_d"), ("a", "not_positive_n"), ("a", "repeated"), ("b", "unknown_d")]
    with pytest.raises(ValueError, match="bad rows"):
        evidence.require(df, "bad rows")
    evidence.require(df.limit(0), "bad rows")
    got = evidence.validated(df, [("no_n", F.col("n").isNull())], [("low", F.col("n") < 0)]).orderBy("k", "n").select("status", "error", "warnings").collect()
    assert [tuple(r) for r in got] == [("ok", None, ["low"]), ("ok", None, []), ("error", "no_n", [])]
    scored = evidence.scored_estimates(spark.createDataFrame([(100.0, 128.0, 90.0, 140.0)], "a double, e double, l double, u double"), "a", "e", "l", "u").first()
    assert (scored["absolute_error"], scored["percentage_error"], scored["inside_range"]) == (28.0, 28.0, True)


def test_page_parsing(spark):
    with_json = '<script type="application/json">{"a": {"price": 5, "title": "t", "id": 1}}</script>'
    with_pairs = "<dl><dt>Rooms</dt><dd>3</dd></dl><p>$1,200 or $95,000</p>"
    df = spark.createDataFrame([(with_json,), (with_pairs,), (None,)], "h string")
    got = df.select(H.page_records_column(F.col("h")).alias("r"), H.first_price(F.col("h")).alias("p")).collect()
    assert [r["r"]["method"] for r in got] == ["json", "pairs", "none"] and got[1]["p"] == 95000.0 and got[2]["p"] is None
    text = json.dumps({"x": {"id": 1, "url": "u"}, "y": [{"id": 2, "url": "v", "title": "t"}]})
    assert json.loads(H.best_record(text, {"id": 20, "url": 20, "title": 4}))["id"] == 2
    assert H.best_record(text, {"id": 1}) is None and H.best_record(None, {"id": 30}) is None
    specs = '[{"type": "bed", "label": "2"}, {"type": "bed", "label": "3"}, {"type": "size", "shortLabel": "60"}]'
    assert spark.createDataFrame([(specs,)], "s string").select(H.spec_map(F.col("s"))).first()[0] == {"bed": "2", "size": "60"}


def test_model_workflow(spark, tmp_path):
    rows = [(i, float(i % 10), None if i % 7 == 0 else "ab"[i % 2], 3.0 + 0.1 * (i % 10) + (0.5 if i % 2 else 0.0)) for i in range(300)]
    df, medians = modelling.impute(spark.createDataFrame(rows, "id long, n double, w string, label double"), ["n"], ["w"])
    model = modelling.pipeline(["n"], ["w"], "label", "linear").fit(df)
    modelling.save_model(model, str(tmp_path / "m"), {"medians": medians})
    back, meta = modelling.load_model(spark, str(tmp_path / "m"))
    scored = back.transform(df)
    assert meta == {"medians": {"n": 4.5}} and scored.count() == 300
    width = modelling.conformal_width(scored.select((F.col("label") - F.col("prediction")).alias("r")), "r")
    inside = modelling.with_interval(scored, "prediction", width).where(F.expm1("label").between(F.col("lower"), F.col("upper"))).count()
    assert inside >= 240
    explained = modelling.linear_factors(scored, back, ["n"], ["w"], [0.0] * len(back.stages[-1].coefficients))
    r = explained.first()
    assert sum(f["effect"] for f in r["factors"]) + back.stages[-1].intercept == pytest.approx(r["prediction"])
    shares = {x["factor"]: x["share"] for x in modelling.importance(explained).collect()}
    assert sum(shares.values()) == pytest.approx(1.0)
    best = modelling.search(modelling.pipeline(["n"], ["w"], "label", "linear"), df, "label", {"regParam": [0.0, 5.0]}, folds=2)
    assert best.avgMetrics[0] < best.avgMetrics[1]
