"""Evaluation texts leaking into training text.

Method: spaced-seed hashing. A seed hashes the units of a text that a fixed mask selects and
ignores the others, so that a changed word between them does no harm. Seeds of the test
items are joined with seeds of the documents; around each hit the passage is compared unit by
unit, with substitutions and gaps allowed, and judged by its length and by the facts (names,
numbers, rare words) that it shares with the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemason.functions.textcodes import blocks, mix, units
from lakemason.llm.sieve import passes, slot_bits
from lakemason.sources.tables import cut_lineage

#: Masks over units: for words, and (longer) for letters of scripts without blanks.
WORD_MASKS = ("110101", "1101001", "101011", "1110001")
LETTER_MASKS = ("111011010111", "1101101011101", "11101001101011")
#: Slots of the sieve that tells seeds of documents before they are moved: fixed, whatever the number of items.
SIEVE = 1 << 27
#: A word that at most this share of all items holds is a fact.
RARE = 0.02
_OPENING = re.compile(r"(?:^|[.!?;:]\s+)\W*[A-Z]")
#: Share of an item that a passage must span, of the passage that must agree, and of its facts;
#: and what the last two must come to together.
SPAN, AGREE, FACTS, TOGETHER = 0.5, 0.84, 0.6, 1.58
#: Seeds of an item that a document must hold for a comparison, as a share of the item's units,
#: for words and for letters: half of an item with AGREE of its units the same holds three to
#: four times as many on average (share of seeds whose units all agree x masks x positions).
HITS = (0.25, 0.05)
#: Units that may be skipped within a passage, on either side.
GAP = 4


def _same(score: tuple[float, float, float]) -> bool:
    """Is a passage of this (span, agreement, agreement of facts) the item's own, whatever its length?"""
    return score[1] >= AGREE and score[2] >= FACTS and score[1] + score[2] >= TOGETHER


def _better(score: tuple[float, float, float]) -> tuple[bool, float]:
    return _same(score), score[0]


def _seeds(hashes: np.ndarray, docs: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first unit's position) of all seeds of a mask that lie within one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += mix(hashes[k : k + n] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64))
    at = np.flatnonzero(docs[:n] == docs[len(mask) - 1 :])
    return mix(total[at]), at


def item_units(items: DataFrame) -> DataFrame:
    """(i, units, fact) of every item (i, t) that has units: their hashes, and which are facts.

    Facts are words with digits, words with capitals that don't open a sentence, words in
    other letters within a script without blanks, and words that at most RARE of all items
    hold: one rule, whatever the number of items. Counts cover all items.
    """
    kind = dict(items.dtypes)["i"]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["i"].tolist()
            for at, texts in blocks(batch["t"].tolist()):
                hashes, docs, kinds = units(texts)
                as_typed = units([_OPENING.sub(lambda m: m[0].lower(), t) for t in texts], fold_case=False)[0]
                capital = as_typed != hashes if len(as_typed) == len(hashes) else np.zeros(len(hashes), bool)
                cuts = np.searchsorted(docs, np.arange(len(texts) + 1))
                out = []
                for k in range(len(texts)):
                    own, kind, named = (v[cuts[k] : cuts[k + 1]] for v in (hashes, kinds, capital))
                    letters = (kind == 2).sum() * 2 > len(kind)
                    sure = (kind == 3) | (kind == 1) & (letters | named)
                    if len(own):
                        out.append((ids[at + k], own.view(np.int64), sure, (kind == 1) & ~sure, bool(letters)))
                yield pd.DataFrame(out, columns=["i", "units", "sure", "word", "letters"])

    taken = cut_lineage(items.mapInPandas(take, f"i {kind}, units array<long>, sure array<boolean>, word array<boolean>, letters boolean"))
    words = taken.select("i", F.explode(F.array_distinct("units")).alias("u"))
    rare = words.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") <= RARE * taken.count())
    held = words.join(rare.select("u").hint("merge"), "u").groupBy("i").agg(F.collect_set("u").alias("rare"))
    fact = F.transform(F.arrays_zip("units", "sure", "word"), lambda z: z["sure"] | z["word"] & F.array_contains("rare", z["units"]))
    return taken.join(held.hint("merge"), "i", "left").select("i", "units", F.when(F.col("rare").isNull(), F.col("sure")).otherwise(fact).alias("fact"), "letters")


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, i, j, size, least): every seed of every item, where it stands, the item's units, and the seeds that a document needs."""
    kind = dict(items.dtypes)["i"]

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, own, letters in zip(batch["i"], batch["units"], batch["letters"], strict=True):
                own = np.asarray(own, np.int64).view(np.uint64)
                for mask in LETTER_MASKS if letters else WORD_MASKS:
                    found, at = _seeds(own, np.zeros(len(own), np.int64), mask)
                    yield pd.DataFrame({"h": found.view(np.int64), "i": i, "j": at, "size": len(own), "least": int(HITS[bool(letters)] * len(own))})

    return items.mapInPandas(seed, f"h long, i {kind}, j int, size int, least int").distinct()


def best_passage(item: list[int], fact: np.ndarray, text: list[int], near: int) -> tuple[float, float, float]:
    """(span, agreement, agreement of facts) of the item's best passage around a position."""
    size = len(item)
    lo = max(0, near - size - size // 3 - 8)
    window = text[lo : near + size + size // 3 + 8]
    found = SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks()
    chains: list[list] = []
    for a, b, n in found:
        if n and chains and 0 <= a - chains[-1][-1][0] - chains[-1][-1][2] <= GAP and 0 <= b - chains[-1][-1][1] - chains[-1][-1][2] <= GAP:
            chains[-1].append((a, b, n))
        elif n:
            chains.append([(a, b, n)])
    best = (0.0, 0.0, 0.0)
    for chain in chains:
        best = max(best, _judge(chain, size, fact), key=_better)
    return best


def _judge(chain: list, size: int, fact: np.ndarray) -> tuple[float, float, float]:
    """Ends that agree in common words only are cut off before the passage is judged.

    A passage without any of its item's facts is anybody's.
    """
    plain = 0.0 if fact.any() else 1.0
    same = np.zeros(size, bool)
    for a, _, n in chain:
        same[a : a + n] = True
    best = (0.0, 0.0, 0.0)
    lo, hi = chain[0][0], chain[-1][0] + chain[-1][2]
    starts, ends = sorted({c[0] for c in chain}), sorted({c[0] + c[2] for c in chain})
    held, facts, right = (np.concatenate([[0], np.cumsum(v)]) for v in (same, fact, same & fact))
    for s in starts:
        for e in ends:
            if e - s < SPAN * size and (s, e) != (lo, hi):
                continue
            if e > s:
                n_fact = facts[e] - facts[s]
                score = ((e - s) / size, (held[e] - held[s]) / (e - s), (right[e] - right[s]) / n_fact if n_fact else plain)
                best = max(best, score, key=_better)
    return best


def within_reach(item: list[int], fact: np.ndarray, held: set[int]) -> bool:
    """Can a document of these units hold enough of the facts of any passage that is long enough?

    A passage of SPAN has the facts of some window of that length at least, and FACTS of them
    must agree, one in any case: an exact bound, without looking at the passages.
    """
    if not fact.any():
        return True
    length = int(np.ceil(SPAN * len(item)))
    sums = np.concatenate([[0], np.cumsum(fact)])
    fewest = int((sums[length:] - sums[: len(sums) - length]).min())
    return sum(item[i] in held for i in np.flatnonzero(fact).tolist()) >= max(1, FACTS * fewest)


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """One row (doc_id, item_id, span, agreement, facts) for each document and item it holds.

    A passage counts from SPAN of the item on, with AGREE of its units and FACTS of its facts
    the same. Whole documents are read, once; null and empty ones hold nothing, null or empty
    items are held by none. Documents repeated under several ids count each; rows that repeat
    an id give one row an item, that of the longest passage. Only seeds that pass the sieve of
    the items' seeds are moved; they meet those of the items by a merge join, in which the
    adaptive planner splits a seed that very many documents hold.
    """
    given = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).dropna().distinct()
    docs = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("text")).where("d is not null and text is not null").withColumn("r", F.xxhash64("d", "text"))
    known = cut_lineage(item_units(given))
    seeds = cut_lineage(item_seeds(known))
    slot = F.pmod("h", F.lit(SIEVE))
    held = documents.sparkSession.sparkContext.broadcast(slot_bits(seeds.select(slot.alias("slot")), SIEVE))

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            rows = batch["r"].to_numpy(np.int64)
            for at, texts in blocks(batch["text"].tolist()):
                hashes, owner, _ = units(texts)
                begins = np.searchsorted(owner, np.arange(len(texts) + 1))
                for mask in WORD_MASKS + LETTER_MASKS:
                    found, first = _seeds(hashes, owner, mask)
                    found = found.view(np.int64)
                    ok = passes(bits, found & (SIEVE - 1))
                    yield pd.DataFrame({"h": found[ok], "r": rows[at + owner[first[ok]]], "at": first[ok] - begins[owner[first[ok]]]})

    hits = docs.select("r", "text").mapInPandas(sift, "h long, r long, at int").join(seeds.hint("merge"), "h")
    # hits of one passage lie on about one diagonal
    wide = F.greatest(F.lit(8), F.floor(F.col("size") / 2))
    spots = hits.groupBy("r", "i").agg(F.collect_set(F.floor((F.col("at") - F.col("j")) / wide).cast("int")).alias("diagonals"), F.count("*").alias("n"), F.max("least").alias("least"))
    spots = spots.where("n >= least").drop("n", "least")
    met = spots.join(known.select("i", "units", "fact").hint("merge"), "i").join(docs.dropDuplicates(["r"]).hint("merge"), "r").select("r", "d", "text", "i", "units", "fact", "diagonals")
    kinds = dict(met.dtypes)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own, has = None, [], set()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.r != last:  # rows of one document come one after the other
                    last, own = row.r, units([row.text])[0].view(np.int64).tolist()
                    has = set(own)
                item, fact = [int(u) for u in row.units], np.asarray(row.fact, bool)
                if not within_reach(item, fact, has):
                    continue
                size = max(8, len(item) // 2)
                best = max((best_passage(item, fact, own, max(0, int(g) * size + size)) for g in sorted(row.diagonals)), key=_better)
                if best[0] >= SPAN and _same(best):
                    out.append((row.d, row.i, *map(float, best)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "span", "agreement", "facts"])

    found = met.mapInPandas(verify, f"doc_id {kinds['d']}, item_id {kinds['i']}, span double, agreement double, facts double")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("span", "agreement", "facts")).alias("m"))
    return best.select("doc_id", "item_id", *[F.round(f"m.{c}", 4).alias(c) for c in ("span", "agreement", "facts")])
