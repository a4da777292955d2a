"""Words, shingles and minwise values of whole batches of texts as numpy arrays.

Texts of a batch are laid end to end as code points; words, their hashes and shingles then
come from a few array operations instead of a loop over characters. The same text always
gets the same hashes, in every batch and process.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

#: Code points worked on at once; one longer text makes a block of its own.
BLOCK_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _class_table() -> np.ndarray:
    """For the basic plane: is the code point a letter, mark or digit?"""
    if "word" not in _tables:
        _tables["word"] = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x10000)])
    return _tables["word"]


def is_word_code(codes: np.ndarray) -> np.ndarray:
    return _class_table()[np.minimum(codes, 0xFFFF)] & (codes < 0x10000) | ((codes >= 0x20000) & (codes < 0x30000))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, BLOCK_CHARS + 2)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
    return _powers["up"], _powers["down"]


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) in runs of about BLOCK_CHARS; null counts as empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = "" if text is None or text != text else text
        if held and size + len(text) > BLOCK_CHARS:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield start, held


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, one 0 after each; position where each text begins)."""
    joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    return codes, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, independent of where it stands."""
    up, down = _power(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's position) of every word of the lower-cased texts, in order."""
    codes, begins = code_points([t.lower() for t in texts])
    inside = is_word_code(codes)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hash(codes, starts, ends), np.searchsorted(begins, starts, "right") - 1


def shingles(hashes: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's position, position of the first word) of all runs of ``size`` words.

    A text of fewer words, but one at least, has the one run of all its words.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    same = np.ones(n, bool)
    for k in range(size):
        moved = np.zeros(n, np.uint64)
        moved[: max(0, n - k)] = hashes[k:]
        fits = np.zeros(n, bool)
        fits[: max(0, n - k)] = docs[k:] == docs[: max(0, n - k)]
        same &= fits
        total += np.where(fits, moved * np.uint64(2 * k + 1), np.uint64(0)) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
    first = np.concatenate([[True], docs[1:] != docs[:-1]])
    counts = np.bincount(docs)
    short = first & (counts[docs] < size)
    keep = np.flatnonzero(same | short)
    return mix(total[keep]), docs[keep], keep


def minwise(hashes: np.ndarray, docs: np.ndarray, n_docs: int, count: int, seed: int) -> np.ndarray:
    """n_docs x count array of 16-bit minwise symbols; rows without hashes are all zero."""
    out = np.zeros((n_docs, count), np.uint16)
    if not len(hashes):
        return out
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    rows = docs[at]
    rng = np.random.default_rng(seed)
    for k, (a, b) in enumerate(rng.integers(1, 2**63, (count, 2), np.int64).astype(np.uint64)):
        low = np.minimum.reduceat((hashes ^ b) * (a | np.uint64(1)), at)
        out[rows, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _unit_table() -> np.ndarray:
    """0 gap, 1 part of a word, 2 a unit of its own (scripts without blanks), 3 left out."""
    if "unit" not in _tables:
        kind = np.zeros(0x10000, np.int8)
        for c in range(0x10000):
            category = unicodedata.category(chr(c))
            if category[0] in "LMN":
                kind[c] = 1
            elif category == "Cf":
                kind[c] = 3
        for lo, hi in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17DF), (0x3040, 0x30FF), (0x3400, 0x9FFF)):
            part = np.arange(lo, hi + 1)
            kind[part[kind[part] == 1]] = 2
        for c in (*range(0x17B4, 0x17D4), 0x17DD):
            kind[c] = 3  # Khmer vowel signs and marks: typed in differing order, so not compared
        _tables["unit"] = kind
    return _tables["unit"]


def _plain(text: str, fold_case: bool) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_KHMER_DIGITS)
    return text.lower() if fold_case else text


def units(texts: Sequence[str], fold_case: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's position, kind) of comparison units, case, marks and punctuation left out.

    Kind 1 is a word, 2 a letter of a script without blanks, 3 a word with a digit.
    """
    codes, begins = code_points([_plain(t, fold_case) for t in texts])
    owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(codes))))
    kind = np.where(codes < 0x10000, _unit_table()[np.minimum(codes, 0xFFFF)], np.where((codes >= 0x20000) & (codes < 0x30000), 2, 0))
    digit = (codes >= 48) & (codes <= 57)
    inner = np.zeros(len(codes), bool)  # 331,000 and 331000 are one number
    inner[1:-1] = ((codes[1:-1] == 44) | (codes[1:-1] == 46)) & digit[:-2] & digit[2:]
    keep = (kind != 3) & ~inner
    codes, kind, owner = codes[keep], kind[keep], owner[keep]
    word = kind == 1
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    digits = np.concatenate([[0], np.cumsum((codes >= 48) & (codes <= 57))])
    single = np.flatnonzero(kind == 2)
    at = np.concatenate([starts, single])
    hashes = np.concatenate([span_hash(codes, starts, ends), mix(codes[single].astype(np.uint64) + np.uint64(1 << 32))])
    kinds = np.concatenate([np.where(digits[ends] > digits[starts], 3, 1), np.full(len(single), 2)])
    order = np.argsort(at, kind="stable")
    return hashes[order], owner[at[order]], kinds[order]


_KHMER_DIGITS = {0x17E0 + d: str(d) for d in range(10)}
