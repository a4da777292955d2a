"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: content-defined chunk reuse. A rolling hash over code points cuts texts where their
content says so, so that texts with common passages have common chunks. Every distinct chunk
is encoded once, and travels as its digest and its ids in two bytes each, from which its text
can be read back; a document's ids are those of its chunks, laid end to end, with each join
repaired: the text around it is encoded anew from the last place before to the first place
behind it where the tokenizer must cut whatever stands beside, and the ids between replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemason.functions.textcodes import blocks, code_points, mix

#: Window of the rolling hash; a cut where its low bits are zero, no chunk shorter or longer.
WINDOW, MASK, SHORTEST, LONGEST = 16, 255, 64, 4096
#: Ids of vocabularies up to 65,536 entries fit two bytes.
ID_TYPE = np.uint16
# Fixed value: the pattern by which this family of tokenizers splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_folder() -> str:
    """The folder of vocabulary files: LAKEMASON_TOKENIZERS, or the one of this machine."""
    return os.environ.get("LAKEMASON_TOKENIZERS", "/opt/tokenizers")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def cut_points(codes: np.ndarray, start: int, end: int, at: np.ndarray) -> list[int]:
    """Chunk ends of the text at [start, end), from the sorted hash cuts of the whole block."""
    out, last = [], start
    for c in at[np.searchsorted(at, start) : np.searchsorted(at, end)].tolist():
        while c - last > LONGEST:
            last += LONGEST
            out.append(last)
        if c - last >= SHORTEST:
            out.append(c)
            last = c
    while end - last > LONGEST:
        last += LONGEST
        out.append(last)
    if end > last:
        out.append(end)
    return out


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(position, chunks) of every text; an empty text has none."""
    codes, begins = code_points(texts)
    c = mix(codes.astype(np.uint64))
    rolled = np.zeros(len(codes), np.uint64)
    for k in range(min(WINDOW, len(c))):
        rolled[k:] += np.left_shift(c[: len(c) - k], np.uint64(k)) if k else c
    at = np.flatnonzero(mix(rolled) & np.uint64(MASK) == 0) + 1
    for i, text in enumerate(texts):
        start = int(begins[i])
        ends = cut_points(codes, start, start + len(text), at)
        yield i, [text[a - start : b - start] for a, b in zip([start, *ends][:-1], ends, strict=True)]


@lru_cache(maxsize=100_000)
def _kind(char: str) -> str:
    """S blank, L letter, N number, O other, as SPLIT tells them apart; ? where tables may differ."""
    if char.isspace():
        return "S"
    if not (char < "\u3000" or "\u4e00" <= char <= "\u9fff" or "\uff00" <= char <= "\uffef"):
        return "?"
    category = unicodedata.category(char)
    return "?" if category == "Cn" else category[0] if category[0] in "LN" else "O"


def _sure(left: str, right: str) -> bool:
    """Must the tokenizer split between two characters, whatever stands further away?

    Its pieces are one optional blank and a run of letters, numbers or others, or blanks. So a
    piece ends before a blank and where the kind changes - but an apostrophe may go on
    with letters.
    """
    a, b = _kind(left), _kind(right)
    return a not in "S?" and b != "?" and a != b and left != "'"


def _first(text: str) -> int:
    """The first place of a sure split within the text, 0 for none."""
    return next((i for i in range(1, len(text)) if _sure(text[i - 1], text[i])), 0)


def _last(text: str) -> int:
    return next((i for i in range(len(text) - 1, 0, -1) if _sure(text[i - 1], text[i])), 0)


def assemble(parts: list[tuple[str, list[int]]], encode) -> list[int]:
    """Ids of the joined chunks: inside, those of the chunks; around joins, encoded anew."""
    if len(parts) < 2:
        return list(parts[0][1]) if parts else []
    out: list[int] = []
    held = ""  # text since the last sure split, not yet encoded
    for n, (text, ids) in enumerate(parts):
        lo = 0 if n == 0 else _first(text)
        hi = len(text) if n == len(parts) - 1 else _last(text)
        if (n and not lo) or not hi:  # no sure split within: the chunk's own ids can't stand
            held += text
            continue
        if n:
            out += encode(held + text[:lo])
        # between two sure splits the chunk's own ids hold: its ends' ids are cut off
        head = len(encode(text[:lo])) if lo else 0
        tail = len(encode(text[hi:])) if hi < len(text) else 0
        out += ids[head : len(ids) - tail] if hi > lo else []
        held = text[hi:]
    return out + (encode(held) if held else [])


def digest(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


def encode_corpus(documents: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """(row, doc_id, ids array<int>) of every row, without special tokens.

    Null and empty texts give an empty list; strings of special tokens in a text are ordinary
    text. Rows that repeat both id and text give one row. Chunks are shared by content over the
    whole corpus: a chunk that a third of all documents holds is encoded once, collapsed on
    the map side before the shuffle, and joined back with the adaptive planner's skew
    handling. Each text is moved once, as chunks; all else that is moved is digests and ids.
    """
    given = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = given.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    kind = dict(given.dtypes)["doc_id"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows, out = batch["doc_id"].tolist(), batch["row"].tolist(), []
            for at, texts in blocks(batch["text"].tolist()):
                for i, parts in chunks(texts):
                    out += [(rows[at + i], ids[at + i], n, digest(p)) for n, p in enumerate(parts or [""])]
            yield pd.DataFrame(out, columns=["row", "doc_id", "n", "h"])

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in blocks(batch["text"].tolist()):
                own = {p for _, parts in chunks(texts) for p in parts or [""]}
                yield pd.DataFrame({"chunk": sorted(own)})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(path)
        for batch in batches:
            held = batch["chunk"].tolist()
            yield pd.DataFrame({"h": [digest(c) for c in held], "ids": [np.array(tokens.encode_ordinary(c), ID_TYPE).tobytes() for c in held]})

    once = numbered.select("text").mapInPandas(contents, "chunk string").distinct().mapInPandas(encode, "h binary, ids binary")
    placed = numbered.mapInPandas(pieces, f"row long, doc_id {kind}, n int, h binary")
    coded = placed.join(once, "h")
    # a document's chunks meet by document: one text's size, never a group of texts; rows that repeat one fall together
    whole = coded.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set(F.struct("n", "ids"))).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(path)
        for batch in batches:
            out = []
            for parts in batch["parts"]:
                lists = [np.frombuffer(p["ids"], ID_TYPE).tolist() for p in parts]
                out.append(assemble([(tokens.decode_bytes(ids).decode(), ids) for ids in lists], tokens.encode_ordinary) if len(lists) > 1 else lists[0])
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "ids": out})

    return whole.mapInPandas(join, f"row long, doc_id {kind}, ids array<int>")
