"""Normalising and comparing short free-typed names (districts, projects, brands).

Pure Python on purpose: it runs over *distinct* values only, inside Arrow batches.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

# Digits of the Khmer script, and marks without width.
KHMER_DIGITS = str.maketrans("០១២៣៤៥៦៧៨៩", "0123456789")
ZERO_WIDTH = regex.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}
#: Words that say what kind of place follows, or in which city it lies.
PLACE_WORDS = frozenset("khan sangkat district area city phnom penh near around zone ខណ្ឌ សង្កាត់ ភ្នំពេញ រាជធានី".split())

_CAMEL = regex.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_DIGIT_EDGE = regex.compile(r"(?<=\p{N})(?=[\p{L}])|(?<=[\p{L}\p{M}])(?=\p{N})")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_KHMER_PREFIX = regex.compile("^(ខណ្ឌ|សង្កាត់)")


def fold(text: str) -> str:
    """NFKC, no zero-width marks, ASCII digits, no accents on Latin letters, lower case."""
    text = ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text)).translate(KHMER_DIGITS)
    parts = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(c for c in parts if not "\u0300" <= c <= "\u036f")).lower()


def name_words(text: str, camel: bool = True) -> list[str]:
    """Words of a name; digits stand alone, a trailing roman number becomes a digit."""
    text = unicodedata.normalize("NFKC", text)
    if camel:
        text = _CAMEL.sub(" ", text)
    words = _WORD.findall(_DIGIT_EDGE.sub(" ", fold(text)))
    words = [w for w in (_KHMER_PREFIX.sub("", w) for w in words) if w]
    if len(words) > 1 and words[-1] in ROMAN:
        words[-1] = ROMAN[words[-1]]
    return words


class Pattern:
    """One string compared against many: optimal-string-alignment distance on bit vectors."""

    __slots__ = ("text", "masks", "full", "last", "letters")

    def __init__(self, text: str) -> None:
        self.text, self.masks = text, {}
        for i, ch in enumerate(text):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i
        self.full = (1 << len(text)) - 1
        self.last = 1 << max(0, len(text) - 1)
        self.letters = frozenset(text)

    def distance(self, other: str) -> int:
        if not self.text:
            return len(other)
        plus, minus, diagonal, before, score, full = self.full, 0, 0, 0, len(self.text), self.full
        for ch in other:
            match = self.masks.get(ch, 0)
            swap = ((~diagonal & match) << 1) & before
            diagonal = ((((match & plus) + plus) ^ plus) | match | minus | swap) & full
            up = minus | (full & ~(diagonal | plus))
            down = diagonal & plus
            score += bool(up & self.last) - bool(down & self.last)
            up = (up << 1 | 1) & full
            down = down << 1 & full
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            before = match
        return score

    def likeness(self, other: str, floor: float = 0.0) -> float:
        """1 - distance / longer length; 0.0 without work where ``floor`` can't be reached."""
        longer = max(len(self.text), len(other))
        if not longer:
            return 1.0
        allowed = (1 - floor) * longer
        if abs(len(self.text) - len(other)) > allowed or len(set(other) - self.letters) > allowed:
            return 0.0
        return 1 - self.distance(other) / longer


def bigrams(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


class Gazetteer:
    """Canonical names with aliases; resolves a typed value by token-set likeness.

    A value and an alias must carry the same numbers, and SHARED of the pairs of letters of
    the shorter, and at least half as many as the alias that has most of the value's pairs:
    an index over these gives the aliases that a value is compared with. Each
    word is paired with its closest partner, weighted by length; where the numbers of words
    differ, the joined letters are compared too (a blank may be lost or moved).
    """

    #: Share of the shorter one's pairs of letters that value and alias must have in common.
    SHARED = 0.25

    def __init__(self, pairs, threshold: float = 0.55, margin: float = 0.05) -> None:
        self.threshold, self.margin = threshold, margin
        self.exact: dict[str, str | None] = {}
        self._known: dict[tuple[str, ...], tuple[tuple[str, float], ...]] = {}
        self.entries: list[tuple[str, Pattern, list[Pattern]]] = []
        index: dict[tuple[str, ...], dict[str, list[int]]] = {}
        sizes: list[int] = []
        for raw, standard in sorted((r, s) for r, s in pairs if r and s):
            words = self.words(raw)
            key = " ".join(words)
            if not key:
                continue
            if self.exact.setdefault(key, standard) != standard:
                self.exact[key] = None  # an alias of two entries stands for neither
            letters = [w for w in words if not w.isdigit()]
            joined = "".join(letters)
            places = index.setdefault(self.numbers(words), {})
            for pair in bigrams(joined):
                places.setdefault(pair, []).append(len(self.entries))
            sizes.append(len(bigrams(joined)))
            self.entries.append((standard, Pattern(joined), [Pattern(w) for w in letters]))
        self.sizes = np.array(sizes, np.int64)
        self.index = {n: {p: np.array(v, np.int64) for p, v in places.items()} for n, places in index.items()}

    @staticmethod
    def words(value: str, camel: bool = True) -> list[str]:
        words = name_words(value, camel)
        kept = [w for w in words if w not in PLACE_WORDS]
        return kept or words

    @staticmethod
    def numbers(words) -> tuple[str, ...]:
        return tuple(sorted(w for w in words if w.isdigit()))

    def ranked(self, value: str) -> list[tuple[str, float]]:
        """The two closest canonical names with their likeness, best first."""
        best: dict[str, float] = {}
        for camel in (True, False):
            words = tuple(self.words(value, camel))
            if self.exact.get(" ".join(words)):
                return [(self.exact[" ".join(words)], 1.0)]
            for standard, score in self._scored(words):
                if score > best.get(standard, 0.0):
                    best[standard] = score
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:2]

    def _scored(self, words: tuple[str, ...]) -> tuple[tuple[str, float], ...]:
        if words in self._known:
            return self._known[words]
        best: dict[str, float] = {}
        letters = [w for w in words if not w.isdigit()]
        joined = "".join(letters)
        if len(joined) >= 3:
            for k in self._near(self.numbers(words), bigrams(joined)):
                standard, whole, parts = self.entries[k]
                floor = max(self.threshold - 0.1, best.get(standard, 0.0))
                score = self._token_set(parts, letters, len(whole.text), len(joined))
                if len(parts) != len(letters):
                    score = max(score, whole.likeness(joined, floor))
                if score > floor:
                    best[standard] = score
        if len(self._known) > 20_000:
            self._known.clear()
        self._known[words] = tuple(best.items())
        return self._known[words]

    def _near(self, numbers: tuple[str, ...], pairs: set[str]) -> list[int]:
        """The aliases with enough pairs of letters in common, in order."""
        places = self.index.get(numbers, {})
        held = [places[p] for p in pairs if p in places]
        if not held:
            return []
        found, shared = np.unique(np.concatenate(held), return_counts=True)
        enough = np.maximum(self.SHARED * np.minimum(self.sizes[found], len(pairs)), shared.max() / 2)
        return found[shared >= enough].tolist()

    def decide(self, ranked) -> str | None:
        """The first of the ranked names, unless it is too far or the second is as close."""
        if not ranked or ranked[0][1] < self.threshold:
            return None
        if len(ranked) > 1 and ranked[0][1] - ranked[1][1] < (self.margin if ranked[0][1] < 0.9 else 1e-9):
            return None
        return ranked[0][0]

    def closest(self, value: str) -> tuple[str | None, float]:
        """(canonical name or None, likeness of the closest entry)."""
        ranked = self.ranked(value)
        return self.decide(ranked), ranked[0][1] if ranked else 0.0

    @staticmethod
    def _token_set(parts: list[Pattern], letters: list[str], size: int, other: int) -> float:
        shared = 0.0
        left = list(letters)
        for part in sorted(parts, key=lambda p: -len(p.text)):
            if not left:
                break
            score, i = max((part.likeness(w, 0.5), -i) for i, w in enumerate(left))
            if score >= 0.5:
                shared += score * (len(part.text) + len(left[-i]))
                left.pop(-i)
        return shared / max(1, size + other)

    def resolve(self, value: str | None) -> str | None:
        return None if value is None else self.closest(value)[0]

