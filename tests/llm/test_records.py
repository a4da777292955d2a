"""Matching, survivors, canonical lists, near-duplicates."""

import random

import pytest
from pyspark.sql import functions as F

from lakemason.llm import canonical, matching, neardup, survivor

ADVERT = "listing_id string, title string, project_name string, price_usd double, size_m2 double, unit_floor int, address string, bedrooms int, a_id string, k long"


def adverts(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r)), "clash", 1) for r in rows], ADVERT)


def found(df):
    return {(r["left_id"], r["right_id"]): r["rule"] for r in df.collect()}


def test_cascade(spark):
    left = adverts(
        spark, ("h1", "Nice 2BR Condo, Solphea Wind Park - level 12", "Solphea Wind Park", 100_000.0, 60.0, 12), ("h2", None, "Solphea Wind Park Phase 2", 100_000.0, 60.0, 12),
        ("h3", "Condo for Sale in Norvuthy Canal Court 2, Prek Mlu 150.0K 60 sqm", None, None, None, 5), ("h4", "2BR", None, 77_000.0, 50.0, 3, "No. 1, Street 2"), (None, "x", "Solphea Wind Park", 100_000.0, 60.0, 12), ("h5", None, None, None, None),
    )
    right = adverts(
        spark, ("k1", "SOLPHEA  WIND  PARK 2BR urgent sale!! $101,000", None, None, 60.9, 13), ("k2", "x", "The Solhpea Wind Park", 99_000.0, 60.0, None), ("k3", "x", "Solphea Wind Park", 110_000.0, 60.0, 12), ("k4", "x", "Solphea Wind Park II", 100_000.0, 60.0, 12),
        ("k5", "Condo 2BR at Norvuthy Canal Court II", None, 149_000.0, None, 5), ("k6", "good area", None, 77_500.0, 50.5, 3, "no. 1 street 2"), ("k1", "SOLPHEA  WIND  PARK 2BR urgent sale!! $101,000", None, None, 60.9, 13), ("k7", None, None, None, None), ("k8", "x", "Solphea Wind Park", 100_000.0, 60.0, 14), ("k9", "x", "Solphea Wind Park", None, 60.1, 12),
    )
    got = found(matching.match(left, right))
    assert got == {("h1", "k1"): "building_price_size", ("h1", "k2"): "slip_price_size", ("h3", "k5"): "building_price_floor", ("h4", "k6"): "address_price_size", ("h1", "k9"): "building_size"}
    assert found(matching.match(left.limit(0), right)) == {} and found(matching.match(left, right.limit(0))) == {}


def test_cascade_against_all_pairs(spark):
    rng = random.Random(1)
    names = [f"{a}{b} {c} {d}{e}" for a in ("Vor", "Lum") for b in ("phea", "tola") for c in ("Wind", "Canal") for d in ("Park", "Court") for e in ("", " Phase 2")]
    make = lambda tag, n: [(f"{tag}{i}", "x", rng.choice(names), float(rng.randrange(50, 90) * 1000), float(rng.randrange(40, 60)), rng.choice([None, *range(1, 6)])) for i in range(n)]
    left, right = make("h", 90), make("k", 160)
    got = set(found(matching.match(adverts(spark, *left), adverts(spark, *right))))
    ok = lambda a, b: a[2] == b[2] and abs(a[3] - b[3]) <= 0.04 * max(a[3], b[3]) and abs(a[4] - b[4]) <= 0.03 * max(a[4], b[4]) and (a[5] is None or b[5] is None or abs(a[5] - b[5]) <= 1)
    assert got == {(a[0], b[0]) for a in left for b in right if ok(a, b)}


def test_confidence_by_labels(spark):
    """Rooms, which no rule looks at, speak for or against a rule."""
    rows = lambda tag, rooms: adverts(spark, *[(f"{tag}{i}", "x", f"Vorphea Wind Park {'Phase 2' if i % 2 else ''}", 100_000.0 + 20_000 * i, 60.0 + (i % 5) * 10, None, None, rooms(i)) for i in range(40)])
    sure = {r["confidence"] for r in matching.match(rows("h", lambda i: i % 7), rows("k", lambda i: i % 7)).collect()}
    poor = {r["confidence"] for r in matching.match(rows("h", lambda i: i % 7), rows("k", lambda i: (i * 3 + 1) % 7)).collect()}
    none = {r["confidence"] for r in matching.match(rows("h", lambda i: None), rows("k", lambda i: None)).collect()}
    assert min(sure) > 0.9 and max(poor) < 0.3 and max(none) < 0.6


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("$181,700 849 sqft floor 15", (181700.0, pytest.approx(78.87, abs=0.01), 15)), ("0.197M 146m2", (197000.0, 146.0, None)), ("71.2K", (71200.0, None, None)), ("level 3 - USD 64400 78.7 sqm", (64400.0, 78.7, 3)), ("", (None, None, None)), (None, (None, None, None)),
    ],
)
def test_title_facts(text, wanted):
    assert matching.title_facts(text) == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Condo 2BR rail yard view Morvika Lantern Residence Grand", ("morvika", "lantern", "residence", "grand")), ("出售 Mirnopa Bridge Point 2 1 Bedroom Palrany", ("mirnopa", "bridge", "point", "2")), ("出售 Mirnopa Bridge Point 1 Bedroom", ("mirnopa", "bridge", "point", "")),
        ("1 bed near rail yard floor 21 city condo", None), ("Cosy Studio Condo, NavmolikaPalm Park Tower B - level 9", ("navmolika", "palm", "park", "tower b")), ("Condo 5BR at good area (palm court)", None),
    ],
)
def test_project_parts(text, wanted):
    assert matching.project_parts(text, False) == wanted


MAPPING = [("Boeung Sorya 1", "Boeung Sorya 1"), ("BS1", "Boeung Sorya 1"), ("បឹងសូរិយា១", "Boeung Sorya 1"), ("Boeung Sorya 2", "Boeung Sorya 2"), ("Tonlé Kesor", "Tonle Kesor"), ("Tonle Kesor", "Tonle Kesor"), ("twice", "Tonle Kesor"), ("twice", "Boeung Sorya 2"), (None, "x"), ("y", None)]


def test_canonical(spark):
    mapping = spark.createDataFrame(MAPPING, "raw_name string, standard_name string")
    values = {
        "a": "boeung-sorya-1", "b": "Khan Boeungg Soirya 1, Phnom Penh", "c": "ខណ្ឌ បឹង​សូរិយា1", "d": "Boeung Sorya", "e": "downtown", "f": "", "g": None, "h": "TONLE KESR", "i": "BoeungSorya II", "j": "twice", "k": "x" * 20_000, "l": "near Tonle Kesor market and Boeung Sorya 2 x", "m": "bs-1", "n": "Tonle Kesor / bs1", "o": "Tonle Kesor, TONLE KESOR",
    }
    rows = spark.createDataFrame([*values.items(), ("a", "boeung-sorya-1"), (None, "bs1")], "key string, value string").withColumn("standard", F.lit("clash"))
    got = {r["key"]: r["standard"] for r in canonical.canonicalise(rows, "key", "value", mapping).collect()}
    one, two, tonle, none = "Boeung Sorya 1", "Boeung Sorya 2", "Tonle Kesor", canonical.UNMATCHED
    assert got == {"a": one, "b": one, "c": one, "d": none, "e": none, "f": none, "h": tonle, "i": two, "j": none, "k": none, "l": none, "m": one, "n": none, "o": tonle, None: one}
    assert canonical.canonicalise(rows.limit(0), "key", "value", mapping).count() == 0
    everything = canonical.canonicalise(rows, "key", "value", mapping.limit(0))
    assert {r["standard"] for r in everything.collect()} == {none}
    report = {r["value"]: r["n_keys"] for r in canonical.unmatched_report(everything).collect()}
    assert report["downtown"] == 1 and report["boeung-sorya-1"] == 1


def test_index_gives_the_same_as_every_entry():
    """Names with a slip or two are found among many entries, and the same as by comparing all."""
    from lakemason.functions.names import Gazetteer

    rng = random.Random(6)
    parts = [a + b + c for a in ("bor", "vic", "tol", "kam", "pre") for b in ("da", "so", "mi", "ne") for c in ("ra", "l", "nth", "ka", "vy")]
    names = sorted({f"{rng.choice(parts)} {rng.choice(parts)}" for _ in range(3000)})
    fast, slow = Gazetteer((n, n) for n in names), Gazetteer((n, n) for n in names)
    slow._near = lambda numbers, pairs: range(len(slow.entries))
    for name in rng.sample(names, 60):
        at = rng.randrange(1, len(name) - 1)
        typed = name[:at] + rng.choice("aeiou") + name[at + rng.choice([0, 1]) :]
        assert fast.closest(typed) == slow.closest(typed)


def test_canonical_in_blocks(spark, monkeypatch):
    from lakemason.operators import lookup

    mapping = spark.createDataFrame(MAPPING, "raw_name string, standard_name string")
    rows = spark.createDataFrame([("a", "boeung sorya 1"), ("b", "tonle kesr"), ("c", "downtown"), ("d", "boeungsoriya 2")], "key string, value string")
    whole = sorted(map(tuple, canonical.canonicalise(rows, "key", "value", mapping).select("key", "standard").collect()))
    monkeypatch.setattr(lookup, "BLOCK_ENTRIES", 2)
    assert sorted(map(tuple, canonical.canonicalise(rows, "key", "value", mapping).select("key", "standard").collect())) == whole


def test_survivors(spark):
    rows = [
        ("g1", "web", 80, "2024-01-01", "2"), ("g1", "app", 60, "2024-05-01", "3"), ("g2", "web", 80, "2024-01-01", "2"), ("g2", "x", 80, "2024-02-01", "3"), ("g2", "x", 80, "2024-03-01", None), ("g3", "x", None, None, "7"), (None, "x", 80, "2024-01-01", "9"), ("g4", "x", 10, "2024-01-01", None),
        *[(f"t{i}", "x", 50, "2024-01-01", "old") for i in range(6)], *[(f"t{i}", "x", 50, "2024-02-01", "new") for i in range(6)], ("u", "x", 50, None, "new"), ("u", "x", 50, None, "old"), ("u", "x", 50, None, "old"), ("v", "x", 50, "2024-01-01", "p"), ("v", "x", 50, "2024-01-01", "q"),
    ]
    df = spark.createDataFrame(rows, "g string, src string, trust int, at string, v string").withColumn("grp", F.lit("clash"))
    held = survivor.long_form(df, "g", {"f": F.col("v")}, F.col("trust"), F.try_to_timestamp("at"))
    got = {r["grp"]: (r["value"], r["basis"]) for r in survivor.survivors(held).collect()}
    assert got["g1"] == ("2", "trust_time") and got["g2"] == ("3", "trust_time") and got["g3"] == ("7", "single") and "g4" not in got and None not in got
    assert got["u"] == ("new", "precedence") and got["t0"] == ("new", "trust_time") and got["v"] == ("p", "tie")
    assert survivor.survivors(held.limit(0)).count() == 0


def test_latest_by_partial_orders(spark):
    """Groups without times: the values' order is learned from groups with times."""
    chains = [(f"c{i}", 5, f"2024-0{k + 1}-01", v) for i in range(4) for k, v in enumerate("abc")]
    rings = [(f"{pair}{i}", 5, f"2024-0{k + 1}-01", v) for i in range(3) for pair in ("xy", "yz", "zx") for k, v in enumerate(pair)]
    undated = [("u1", 5, None, v) for v in "bca"] + [("u2", 5, None, v) for v in "ab"] + [("u3", 5, None, v) for v in "xyz"] + [("u4", 5, None, v) for v in "qp"] + [("u5", 5, "2024-01-01", "c"), ("u5", 5, None, "a"), ("u6", 5, "2024-01-01", "a"), ("u6", 5, None, "b"), ("u7", 9, None, "a"), ("u7", 5, None, "c")]
    df = spark.createDataFrame(chains + rings + undated, "g string, trust int, at string, v string")
    held = survivor.long_form(df, "g", {"f": F.col("v")}, F.col("trust"), F.try_to_timestamp("at"))
    got = {r["grp"]: (r["value"], r["basis"]) for r in survivor.survivors(held).collect()}
    want = {"u1": ("c", "precedence"), "u2": ("b", "precedence"), "u3": ("x", "precedence"), "u4": ("p", "tie"), "u6": ("b", "precedence"), "u7": ("a", "trust_time")}
    assert {g: got[g] for g in want} == want and got["u5"][0] == "c"


def test_transitions_over_slices(spark):
    """Steps from one slice of time into the next count as those within one."""
    df = spark.createDataFrame([("g", 1, f"2024-{m:02d}-{d:02d}", v) for m, d, v in ((1, 1, "a"), (1, 2, "b"), (3, 1, "b"), (6, 1, "c"), (6, 1, "b"), (9, 1, None))], "g string, trust int, at string, v string")
    held = survivor.long_form(df, "g", {"f": F.col("v")}, F.col("trust"), F.try_to_timestamp("at"))
    assert {(r["older"], r["newer"], r["wins"]) for r in survivor.learn_transitions(held).collect()} == {("a", "b", 1), ("b", "c", 1)}


WORDS = [f"{a}{b}{c}" for a in ("vor", "lum", "sil", "tan") for b in ("phea", "tola", "rith", "mony") for c in ("n", "ka", "s", "vi", "dor")]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = {}
    for base in range(150):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(25, 90))]
        texts[f"b{base}"] = " ".join(words)
        for copy in range(rng.choice([0, 0, 1, 2])):
            new = list(words)
            for _ in range(rng.randrange(1, 5)):
                new[rng.randrange(len(new))] = f"typo{rng.randrange(10**6)}"
            texts[f"b{base}c{copy}"] = " ".join(new).upper() + " !!"
    grams = {k: {tuple(w[i : i + 3]) for w in [[x for x in v.lower().replace("!", "").replace(".", "").split()]] for i in range(len(w) - 2)} for k, v in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.5}
    df = spark.createDataFrame([*texts.items(), *list(texts.items())[:20], ("n", None), ("e", ""), (None, "x"), ("w", "one two"), ("w2", "ONE, two!"), ("p", "...")], "id string, text string").withColumn("node", F.lit(7))
    got = {tuple(r) for r in neardup.near_pairs(df, "id", F.col("text")).collect()}
    assert ("w", "w2") in got and len(want & got) >= 0.99 * len(want)
    extra = got - want - {("w", "w2")}
    assert all(len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= neardup.LIKENESS for a, b in extra)
    classes = {r["key"]: r["n_links"] for r in neardup.near_duplicates(df, "id", F.col("text")).collect()}
    assert classes == {x: sum(x in p for p in got) for x in {x for p in got for x in p}}
    spread = neardup.near_pairs(df.repartition(7), "id", F.col("text"))
    assert {tuple(r) for r in spread.collect()} == got  # whatever the batches


def test_hot_group_of_copies(spark):
    same = [(f"s{i:04d}", "exactly the same advert text for every one of these rows with words enough to count as a text") for i in range(1500)]
    df = spark.createDataFrame([*same, ("z", "quite another text that shares nothing at all with the many copies beside it here or anywhere else")], "id string, text string")
    got = neardup.near_duplicates(df, "id", F.col("text"))
    assert got.select("class_id").distinct().count() == 1 and got.count() == 1500 and {r["n_links"] for r in got.collect()} == {1499}
    assert neardup.near_duplicates(df.limit(0), "id", F.col("text")).count() == 0


def test_near_duplicates_of_common_wording(spark):
    """The wording a third of the texts share isn't rare; tails of rare words don't hide it."""
    rng = random.Random(8)
    shared = " ".join(f"{rng.choice(WORDS)}{i}" for i in range(72))
    tails = [[f"tail{i}x{k}" for k in range(17)] for i in range(100)]
    texts = [(f"c{i:03d}", f"{shared} {' '.join(t)}") for i, t in enumerate(tails)]
    texts += [(f"o{i:03d}", " ".join([*rng.sample(t, 17), *(f"own{i}y{k}" for k in range(30))])) for i, t in enumerate(tails)]
    texts += [(f"u{i:03d}", " ".join(f"u{i}z{k}" for k in range(30))) for i in range(100)]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "id string, text string"), "id", F.col("text"))
    assert {r["key"] for r in got.collect()} == {f"c{i:03d}" for i in range(100)} and got.select("class_id").distinct().count() == 1


@pytest.mark.parametrize("block", [2048, 16])
def test_candidates_hold_every_pair_within_the_distance(spark, block):
    """Texts of one template: many strangers share each key, and part no pair."""
    import numpy as np

    from lakemason.functions.textcodes import minwise, shingles, words

    rng = random.Random(9)
    template = [f"{rng.choice(WORDS)}{i}" for i in range(40)]
    texts = [" ".join(template + [f"t{i // 2}w{rng.randrange(60)}" for _ in range(15)] + [f"s{i // 2}e{k}" for k in range(30)]) for i in range(400)]
    hashes, docs = words(texts)
    grams, owner, _ = shingles(hashes, docs, neardup.SHINGLE_WORDS)
    signature = minwise(grams, owner, len(texts), neardup.SYMBOLS, 11)
    a, b = np.nonzero((signature[:, None] == signature[None]).sum(2) >= neardup.AGREE)
    want = {(int(x), int(y)) for x, y in zip(a, b, strict=True) if x < y}
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = neardup.candidates(df) if block == 2048 else neardup.candidates(df, block)
    assert len(want) > 200 and want <= {(r["a"], r["b"]) for r in found.collect()}


def test_near_duplicates_of_bare_titles(spark):
    titles = [("a1", "Stylish 1 Bedroom Condo for sale Morvika Lantern Residence Grand"), ("a2", "Spotless 1 Bedroom Condo for sale Morvika Lantern Residence Grand"), ("b1", "good area 2+1 BR urgent sale!!"), ("b2", "good area 2+1 BR urgent sale!! 81m2"), ("c", "quite another title of a villa by the lake")]
    chain = [(f"d{i}", " ".join(f"w{k}" for k in range(2 * i, 2 * i + 9))) for i in range(4)]  # neighbours share 5 of 9, others less
    df = spark.createDataFrame(titles + chain, "id string, text string")
    got = neardup.near_pairs(df, "id", F.col("text"))
    assert {tuple(r) for r in got.collect()} == {("a1", "a2"), ("b1", "b2"), ("d0", "d1"), ("d1", "d2"), ("d2", "d3")}
    assert neardup.near_duplicates(df, "id", F.col("text")).count() == 8


def test_likeness():
    import numpy as np

    pack = lambda lo, hi: np.arange(lo, hi, dtype=np.uint32).tobytes()
    assert neardup.likeness(pack(0, 100), pack(0, 100)) == 1.0 and neardup.likeness(pack(0, 100), pack(50, 150)) == pytest.approx(50 / 150)
    assert neardup.likeness(pack(0, 100), b"") == 0.0


def test_key_with_two_texts(spark):
    """Each of a key's texts counts, and its texts' copies fall into one class."""
    one, two = "a wide flat near the old market with two rooms", "quite another wording of a house beside the river bank"
    df = spark.createDataFrame([("x", one), ("x", two), ("y", one), ("z", two), ("z", two), ("u", "alone")], "id string, text string")
    assert {tuple(r) for r in neardup.near_pairs(df, "id", F.col("text")).collect()} == {("x", "y"), ("x", "z")}
    got = {r["key"]: r["class_id"] for r in neardup.near_duplicates(df, "id", F.col("text")).collect()}
    assert set(got) == {"x", "y", "z"} and len(set(got.values())) == 1


def test_adverts_without_description_are_told_apart_by_their_flats(spark, tmp_path):
    from lakemason.llm.queries import p5_classes, p5_found

    told = " ".join(f"word{i}" for i in range(30))
    adverts = [
        ("a1", "good area 2BR urgent sale!!", None, "Condo", 2, 80.0, 9), ("a2", "good area 2BR urgent sale!!", "", "Condo", 2, 61.0, 9), ("a3", "good area 2BR urgent sale!! 80m2", None, "Condo", 2, 80.0, 9),
        ("b1", "new building 3BR", None, "Condo", 3, None, None), ("b2", "new building 3BR", None, "Condo", 3, None, None), ("b3", "new building 3BR", None, "Condo", None, 3.0, None),
        ("c1", "one title", told, "Condo", 1, 40.0, 2), ("c2", "one title", told + " more", "Condo", None, 40.0, None),
    ]
    spark.createDataFrame(adverts, "listing_id string, title string, description string, property_type string, bedrooms int, size_m2 double, unit_floor int").write.parquet(f"{tmp_path}/clean_khmer24.parquet")
    assert {tuple(r) for r in p5_found(spark, str(tmp_path)).collect()} == {("a1", "a3"), ("b1", "b2"), ("c1", "c2")}
    assert {r["listing_id"] for r in p5_classes(spark, str(tmp_path)).collect()} == {"a1", "a3", "b1", "b2", "c1", "c2"}
