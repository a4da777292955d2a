"""Personal details, encoding, leakage, sentences."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakemason.llm import encoding, leakage, pii, sentences

VOCABULARY = f"{encoding.tokenizer_folder()}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


def details(text, terms=None):
    return [(k, text[s:e]) for k, s, e in pii.details(text, terms or {})]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Tel (030) 622/772.", [("phone", "(030) 622/772")]), ("ring +855 30 794 658", [("phone", "+855 30 794 658")]), ("(+855)303185040", [("phone", "(+855)303185040")]), ("00855-40-227-0216", [("phone", "00855-40-227-0216")]), ("ring O3O 436 19O", [("phone", "O3O 436 19O")]),
        ("០២០ ២០៦ ៧៨១", [("phone", "០២០ ២០៦ ៧៨១")]), ("0 5 0 9 1 9 5 2 2,", [("phone", "0 5 0 9 1 9 5 2 2")]), ("Ref code: 033463302.", []), ("price 302,000 - 100,000 USD in 2019-2026", []), ("Call 020 585 140 (Borith Bantol).", [("phone", "020 585 140"), ("name", "Borith Bantol")]),
        ("mail: a.b+flat@home.example.org only", [("email", "a.b+flat@home.example.org")]), ("to sova at post dot test.", [("email", "sova at post dot test")]), ("x(at)flat.example", [("email", "x(at)flat.example")]), ("Meet at the lobby @ 9:00.", []), ("Open 24/7 @ lobby desk.", []),
        ("Seller's ID card 168176760(16), name Sova Kesmun.", [("id_number", "168176760(16)"), ("name", "Sova Kesmun")]), ("Passport N-3049-3888 on file for Venda.", [("id_number", "N-3049-3888"), ("name", "Venda")]), ("Listing no 770932513 on our board.", []),
        ("lives at No. 459A, Street 364.", [("address", "No. 459A, Street 364")]), ("at House 5, Lane 12, Nilmony Boulevard.", [("address", "House 5, Lane 12, Nilmony Boulevard")]), ("to Mr. Ratho, 59 Marvira Road.", [("name", "Ratho"), ("address", "59 Marvira Road")]), ("no 241 st 582.", [("address", "no 241 st 582")]),
        ("ផ្ទះលេខ ១៨២ ផ្លូវ ៧១៧", [("address", "ផ្ទះលេខ ១៨២ ផ្លូវ ៧១៧")]), ("Five minutes from Street 923.", []), ("on Callarin Road for March", []), ("Ms. S. Yimsorn will meet", [("name", "S. Yimsorn")]), ("联系人 Keovi Mavuth ，电话", [("name", "Keovi Mavuth")]), ("The owner is leaving. Owner's desk", []), ("", []),
    ],
)
def test_details(text, wanted):
    assert details(text) == wanted


def test_learned_terms_find_names_without_a_cue(spark):
    texts = [(f"Contact Sova Kesmun at 030 688 {i:04d}. The lobby shows Kamkola stone.",) for i in range(9)] + [("The lobby of Kamkola Park is wide.",)] * 9 + [(None,), ("",)]
    df = spark.createDataFrame(texts, "text string")
    terms = {r["term"]: r["bits"] for r in pii.revealing_terms(df).collect()}
    assert set(terms) == {"sova", "kesmun"} and all(v > 0 for v in terms.values())
    assert pii.finish(*pii.outline("KESMUN sova", pii.Sieve(pii.sieve_of(pii.revealing_terms(df))))) == [("name", 0, 11)]
    assert details("a flat of KESMUN sova near Kamkola Park", terms) == [("name", "KESMUN sova")]
    assert details(None or "", terms) == [] and pii.details(None, terms) == []
    assert pii.revealing_terms(df.limit(0)).count() == 0


def test_terms_stay_when_texts_are_added(spark):
    """What is learned from some texts isn't lost among more of another kind."""
    few = [(f"Contact Sova Kesmun at 030 688 {i:04d}.",) for i in range(4)]
    more = [(f"The lobby of the tower is wide, with {i} lamps and a quiet garden.",) for i in range(3000)]
    for texts in (few, few + more):
        assert {r["term"] for r in pii.revealing_terms(spark.createDataFrame(texts, "text string")).collect()} == {"sova", "kesmun"}


PARTS = ["House 12", "no. 5", "# 4", "villa 7b,", "st 24", "street 3a", "Norodom", "Blvd", "avenue", "AVE", "lane", "borey x", "dara.sok", " at ", "@", "(at)", "[AT]", "mail", ".com", " dot ", "[dot]", "test", ", ", " ", "\n", "59 Marvira Road", "ផ្ទះលេខ ១", "ផ្លូវ ៧", "ID card", "passport", "N-3049-3888", "168176760", ", name", " on file"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8))
def test_gates_drop_nothing(parts):
    """What a pattern finds by itself is found behind its gate."""
    import unittest.mock as mock

    text = "".join(parts)
    seen = set(pii._plain_words(text))
    behind = pii.fixed_details(text, seen)
    with mock.patch.multiple(pii, _may=lambda *_: True, _ID_PARTS=("",), _ID_ENDS=("",), _ADDRESSES=tuple((p, m, w, None) for p, m, w, _ in pii._ADDRESSES)):
        assert pii.fixed_details(text, seen) == behind


@pytest.mark.parametrize("text", ["House 12, Norodom Blvd", "No. 5, Sothearos Ave", "dara.sok at mail.com"])
def test_forms_behind_gates(text):
    assert [text[s:e] for _, s, e in pii.details(text, {})] == [text]


def test_find_and_sanitise(spark):
    df = spark.createDataFrame([("1", "Call 020 585 140 (Borith Bantol).", None), ("1", "Call 020 585 140 (Borith Bantol).", None), ("2", None, "to a@b.test now"), (None, "020 585 140", None), ("3", "", "x" * 50_000 + " 020 585 140")], "id string, title string, description string").withColumn("key", F.lit(1))
    none = spark.createDataFrame([], "term string, bits double")
    got = sorted(map(tuple, pii.find_details(df, "id", ["title", "description"], none).collect()))
    assert got == [("1", "title", "name", 18, 31), ("1", "title", "phone", 5, 16), ("2", "description", "email", 3, 11), ("3", "description", "phone", 50_001, 50_012)]
    clean = {(r["id"], r["title"], (r["description"] or "")[:14]) for r in pii.sanitise(df, ["title", "description"], none).collect()}
    assert ("1", "Call [PHONE] ([NAME]).", "") in clean and ("2", None, "to [EMAIL] now") in clean
    assert pii.find_details(df.limit(0), "id", ["title"], none).count() == 0


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab'sd 12\n,.។ខ្ម房。 é", max_size=60), st.text(max_size=40), st.sampled_from(["it's ", "   ", "<|endoftext|>", "don''t", "ខ្មែរ", "\r\n\r\n", "🙂"])), max_size=8), st.randoms())
def test_assembled_chunks_equal_the_whole(parts, rng):
    encode = encoding.encoder(VOCABULARY).encode_ordinary
    text = "".join(parts)
    cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), 5))) if text else []
    pieces = [p for p in (text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)) if p]
    assert encoding.assemble([(p, encode(p)) for p in pieces], encode) == encode(text)


@needs_vocabulary
def test_encoding(spark):
    rng = random.Random(1)
    shared = " ".join(rng.choice(["lobby", "garden", "Sorpel's", "1,200", "房东说", "ខ្មែរ"]) for _ in range(400))
    texts = [shared, "x " + shared, shared + "!", "", None, "   ", "<|endoftext|> a", "a" * 30_000, "房" * 5000, "line\r\n\r\n" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = {r["doc_id"]: list(r["ids"]) for r in encoding.encode_corpus(df, "doc_id", "text", VOCABULARY).collect()}
    encode = encoding.encoder(VOCABULARY).encode_ordinary
    assert got == {i: encode(t or "") for i, t in enumerate(texts)}
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


@needs_vocabulary
def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{encoding.tokenizer_folder()}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("It's 12,000 riel.\n\n  Ok", "ខ្មែរ 房东说：“好。”", " a  b   c", "<|endoftext|>"):
        assert encoding.encoder(VOCABULARY).encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


def test_chunks_are_shared_by_content():
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    (_, a), (_, b) = encoding.chunks([body, "an inserted start " + body])
    assert "".join(a) == body and len(set(a) & set(b)) > 0.8 * len(set(a))


ITEM = "The surveyor Kolpar walked south along Tirthea Canal on 14 March and noted 6 plots whose markers stood 5.5 metres off the line, whereas agent Morsel promised the river to a buyer named Vannak. How many dollars does the investor finally pay for lot 218?"
OTHER = ITEM.replace("Kolpar", "Ransel").replace("Tirthea", "Nalsamo").replace("14 March", "3 May").replace(" 6 ", " 9 ").replace("5.5", "2.1").replace("Morsel", "Dintor").replace("Vannak", "Sopheak").replace("218", "77").replace("south", "west")
NOISE = "Parking slot 450 sits north-east of the ramp, beside the sky bar. Security walks the lobby every 13 hours."


def test_leaks(spark):
    words = ITEM.split()
    changed = [w if i % 11 else "xyz" for i, w in enumerate(words)]
    docs = {
        1: NOISE + " " + ITEM.upper().replace(",", " ") + " " + NOISE, 2: NOISE + "\n" + " ".join(words[:28]) + "\n" + NOISE, 3: " ".join(changed), 4: OTHER, 5: NOISE, 6: None, 7: "", 8: " ".join(words[:9]), 9: NOISE * 3000 + ITEM, 10: "施工队从Nallarin运来310袋水泥，结果堵住了邻居10天的大门，后来一对从Carpura来的夫妻以580千美元预订了第4号公寓。", 11: "施工队从Vorpich运来25袋水泥，结果堵住了邻居7天的大门，后来一对从Sormala来的夫妻以190千美元预订了第9号公寓。",
    }
    items = spark.createDataFrame([(100, ITEM), (101, docs[10]), (102, None), (103, ""), (100, ITEM)], "item_id long, text string")
    df = spark.createDataFrame([*docs.items(), (1, docs[1])], "doc_id long, text string").withColumn("i", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 100), (2, 100), (3, 100), (9, 100), (10, 101)}
    assert leakage.find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leaks_among_many_items(spark):
    """Facts told by rarity over all items; what is found of one item stays when others are added."""
    rng = random.Random(5)
    pick = lambda: f"{rng.choice(['Kol', 'Ran', 'Dor', 'Sil'])}{rng.choice(['par', 'sel', 'tin', 'ma'])}{rng.choice(['va', 'ra', 'na', 'so'])}{''.join(rng.choices('bdgklmnprstv', k=3))}"
    make = lambda i: f"The surveyor {pick()} walked along the canal of {pick()} on day {i % 28 + 1} and noted {i} plots whose markers stood off the line, whereas agent {pick()} promised the river to a buyer named {pick()}. How many dollars does the investor finally pay for lot {i * 7}?"
    texts = [ITEM] + [make(i) for i in range(130)]
    docs = spark.createDataFrame([(1, f"{NOISE} {ITEM}"), (2, f"{NOISE} {texts[40]} {NOISE}"), (3, OTHER), (4, f"{NOISE} How many dollars does the investor finally pay for lot 9?")], "doc_id long, text string")
    for n in (1, 41, 131):
        items = spark.createDataFrame(list(enumerate(texts[:n])), "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
        assert got == {(1, 0)} | ({(2, 40)} if n > 40 else set())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.booleans()), min_size=1, max_size=40), st.lists(st.integers(0, 30), max_size=60))
def test_bound_by_facts_is_exact(item, text):
    """No passage that counts is out of reach by the bound."""
    import numpy as np

    units, fact = [u for u, _ in item], np.array([f for _, f in item])
    best = leakage.best_passage(units, fact, text, 0)
    counts = best[0] >= leakage.SPAN and leakage._same(best)
    assert not counts or leakage.within_reach(units, fact, set(text))


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Turavel paid 5.85 dollars.", "The lift, e.g. the old one, works!"], ["Market note, May 2024", "It is quiet."], ['"Is it new?" asked the buyer.', "Yes."], ['The agent said, "Bring 14 photos."', "It rained."], ["(The gym was closed during our visit.)", "We left."],
        ["房东说：“这里很安静。”", "“电梯是新的吗？”买家问中介。", "2013年换了水泵……住户少付了6.95美元。"], ["ខ្យល់ចេញចូល ។ល។ និងយ៉រធំ។", "ទេសភាពស្អាតណាស់!", "លោក Pradok បាននិយាយថា «ផ្ទះនេះស្ងាត់ណាស់» ហើយចុះកិច្ចសន្យា៕"], ["Quel calme !", "M. Sarnok a visité le lot 9 (cf. p. 20).", "« La vue est belle », a dit Mme Hengdor."],
        ["The owner hesitated... and then accepted.", "J. K. Kesmun left at 4 a.m.", "The guard has the key."], ["Visit www.a-homes.example for the plan, or ask at desk No. 26.", "The U.S. buyer came."], ["- fee 8.80 USD per m²", "- title: owner booklet"], ["1. Mini mart on level 26", "2. Shower room"],
    ],
)
def test_sentences(units):
    for sep in ("\n\n", "\n" if units[0][0] in "-1M" else " "):
        text = f"  {sep.join(units)}\n"
        assert [text[s:e] for s, e in sentences.sentences(text)] == units


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("It moves west.Our tiler left.Dr. Kesmun came.", ["It moves west.", "Our tiler left.", "Dr. Kesmun came."]), ("the seller, a ph.d. from x, left. we paid 5 usd per sq. m. and went.", ["the seller, a ph.d. from x, left.", "we paid 5 usd per sq. m. and went."]),
        ("Most units face the\nriver and were sold.\nThe rest stayed.", ["Most units face the\nriver and were sold.", "The rest stayed."]), ("ថ្លៃសេវា ២៦\nអគារ Tortola\nផ្ទះ", ["ថ្លៃសេវា ២៦", "អគារ Tortola", "ផ្ទះ"]), ("បាន។ភ្ញៀវ ។ ផ្ទះ", ["បាន។", "ភ្ញៀវ ។", "ផ្ទះ"]), ("", []), (None, []), (" \n​ ", []), ("...", ["..."]), ("a.b.c" * 20_000, ["a.b.c" * 20_000]),
    ],
)
def test_layout_and_edges(text, units):
    assert [text[s:e] for s, e in sentences.sentences(text)] == units


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB. !?\"“”«»()។。\n-1'…", max_size=80))
def test_units_part_the_text(text):
    at = 0
    for s, e in sentences.sentences(text):
        assert at <= s < e <= len(text) and not text[at:s].strip() and text[s:e].strip() == text[s:e]
        at = e
    assert not text[at:].strip()


def test_sentence_units(spark):
    df = spark.createDataFrame([(1, "A cat. A dog."), (2, None), (3, " ")], "doc_id long, text string").withColumn("key", F.lit(0))
    assert sorted(map(tuple, sentences.sentence_units(df, "doc_id", "text").collect())) == [(1, 0, 6), (1, 7, 13)]
    assert sentences.sentence_units(df.limit(0), "doc_id", "text").count() == 0
