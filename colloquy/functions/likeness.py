"""How alike two names are: the weighted ratio of whole names, their words and parts of them, 0 to 100.

Plain functions for pairs that a join has found. A ratio is twice the longest common subsequence over both
lengths; words are those between white space.
"""

from __future__ import annotations

from collections.abc import Iterable

#: What a likeness of sorted words and of parts counts.
WORDS, PART, SMALL_PART = 0.95, 0.9, 0.6
#: From these ratios of the lengths on parts count, and count little.
LONGER, MUCH_LONGER = 1.5, 8.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one integer whose zero bits are matches so far."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def share(same: int, size: int) -> float:
    return 200.0 * same / size if size else 0.0


def ratio(a: str, b: str) -> float:
    return share(common(a, b), len(a) + len(b))


def part_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer of its length, or with less of it at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    n = len(a)
    stretches = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    best = max(ratio(a, s) for s in stretches)
    return max(best, part_of_equal(b, a)) if len(a) == len(b) else best


def part_of_equal(a: str, b: str) -> float:
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def word_ratio(a: str, b: str) -> float:
    """Of the words in order: whole, or what both share against each with its rest."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    ordered = ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    return max(ordered, set_ratio(set(x), set(y)))


def set_ratio(x: set[str], y: set[str]) -> float:
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    shared, left, right = " ".join(both), " ".join(only_x), " ".join(only_y)
    gap = 1 if both else 0
    size_x, size_y = len(shared) + gap + len(left), len(shared) + gap + len(right)
    apart = len(left) + len(right) - 2 * common(left, right)
    best = 100.0 - 100.0 * apart / (size_x + size_y)
    if both:
        best = max(best, share(len(shared), len(shared) + size_x), share(len(shared), len(shared) + size_y))
    return best


def part_word_ratio(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    if set(x) & set(y):
        return 100.0
    best = part_ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    if len(set(x)) == len(x) and len(set(y)) == len(y):
        return best
    return max(best, part_ratio(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the whole and its words and, where one is at least half as long again, of parts of it."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < LONGER:
        return max(best, word_ratio(a, b) * WORDS)
    part = PART if longer <= MUCH_LONGER else SMALL_PART
    return max(best, part_ratio(a, b) * part, part_word_ratio(a, b) * WORDS * part)


def scores(kind: str, left: Iterable[str], right: Iterable[str]) -> list[float]:
    of = {"weighted": weighted_ratio, "words": word_ratio}[kind]
    return [of(a, b) for a, b in zip(left, right)]
