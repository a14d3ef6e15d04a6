"""The cutting-stock linear program over a length histogram, by column generation.

Master: at least n_l pieces of each length l from patterns (multisets of lengths whose sum is within the capacity), with
as few sequences as possible, solved by the revised simplex method. Pricing: an unbounded knapsack by dynamic programming
over the capacity, whose values are the master's duals. All sizes depend on the capacity alone, not on the corpus.
"""

from __future__ import annotations

import numpy as np


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The multiset of lengths within the capacity with the largest sum of values: (sum, index -> copies)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    use = values > 0
    at, val, where = lengths[use], values[use], np.flatnonzero(use)
    if not len(at):
        return 0.0, {}
    ends = np.searchsorted(at, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        e = ends[c]
        best[c], choice[c] = best[c - 1], -1
        if e:
            sums = best[c - at[:e]] + val[:e]
            k = int(sums.argmax())
            if sums[k] > best[c] + 1e-13:
                best[c], choice[c] = sums[k], k
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[int(where[choice[c]])] = pattern.get(int(where[choice[c]]), 0) + 1
            c -= int(at[choice[c]])
    return float(best[capacity]), pattern


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-3, most_rounds: int = 20_000) -> list[tuple[dict[int, int], float]]:
    """Patterns (index into lengths -> copies) and how often each is used, within the gap of the optimum of the program."""
    m = len(lengths)
    # Distinct right-hand sides keep the simplex method from standing still at ties; whole_patterns() deals out the rest.
    demand = counts * (1 + 1e-5 * np.random.default_rng(7).random(m)) + 1e-2 * np.random.default_rng(8).random(m)
    patterns: list[dict[int, int]] = [{i: int(capacity // n)} for i, n in enumerate(lengths)]
    diagonal = np.array([float(p[i]) for i, p in enumerate(patterns)])
    inverse = np.diag(1 / diagonal)
    x = demand / diagonal
    duals = 1 / diagonal  # every pattern costs one sequence
    bound = 0.0
    for _ in range(most_rounds):
        value, pattern = best_pattern(lengths, duals, capacity)
        total = x.sum()
        bound = max(bound, float(demand @ duals) / max(value, 1.0))
        if value <= 1 + 1e-9 or total - bound <= gap * total:
            break
        direction = sum(inverse[:, i] * k for i, k in pattern.items())
        positive = direction > 1e-10
        ratios = np.where(positive, x / np.where(positive, direction, 1.0), np.inf)
        out = int(ratios.argmin())
        step = max(0.0, ratios[out])
        x -= step * direction
        np.maximum(x, 0, out=x)
        x[out] = step
        row = inverse[out] / direction[out]
        direction[out] -= 1.0
        touched = np.flatnonzero(np.abs(direction) > 1e-14)
        columns = np.flatnonzero(row)
        inverse[np.ix_(touched, columns)] -= np.outer(direction[touched], row[columns])
        duals = duals + (1.0 - value) * row
        patterns[out] = pattern
    x = inverse @ counts.astype(float)
    return [(p, v) for p, v in zip(patterns, x.tolist(), strict=True) if v > 1e-9]


def whole_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """Rounded: patterns and whole uses that hold every piece exactly once. Uses are rounded down, what is left (a bounded
    number of pieces, however many documents there are) is dealt out best fit decreasing."""
    if not len(lengths):
        return []
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    for pattern, used in solve(lengths, counts, capacity, gap):
        times = min([int(used + 1e-6), *(int(left[i] // k) for i, k in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for i, k in pattern.items():
                left[i] -= times * k
    room: dict[int, list[dict[int, int]]] = {}
    spaces = np.zeros(capacity + 1, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        while left[i] > 0:
            fits = np.flatnonzero(spaces[n:])
            if len(fits):
                space = n + int(fits[0])
                sequence = room[space].pop()
                spaces[space] -= 1
                copies = 1
            else:
                space, sequence = capacity, {}
                copies = min(int(left[i]), capacity // n) if int(left[i]) > capacity // n else 1
                if copies > 1:  # many equal pieces left: whole sequences of them
                    times = int(left[i]) // copies
                    out.append(({i: copies}, times))
                    left[i] -= times * copies
                    continue
            sequence[i] = sequence.get(i, 0) + copies
            left[i] -= copies
            room.setdefault(space - n, []).append(sequence)
            spaces[space - n] += 1
    out += [(s, 1) for group in room.values() for s in group if s]
    return out
