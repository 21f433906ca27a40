"""Equality of long stretches of a sequence, by recompression.

A sequence is shrunk level by level: runs of one symbol become one symbol (block
compression), then pairs whose first symbol falls on the left and whose second on the right
of a cut through the alphabet become one (pair compression), and so on until little is left.
The levels are a run-length grammar of the sequence.  As each level is made from symbols
alone, equal stretches get equal symbols but for a few at their ends, so the longest common
extension of two places is found by climbing while the symbols agree and descending where
they do not, a few steps a level, whatever the stretch is long.  Queries are answered side
by side.
"""

import numpy as np


class _Level:
    """Symbols of a level, the place of each in the sequence, and its links.

    ``up`` is the number of the symbol above, ``down`` that of the first one below, ``heads``
    says whether a symbol is the first one below its ``up``.  ``ends`` is the number behind the
    run of equal symbols that a symbol is in.
    """

    def __init__(self, symbols, starts, down=None):
        self.symbols, self.starts, self.down = symbols, starts, down
        self.up = self.heads = None
        changes = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        lengths = np.diff(np.concatenate([[0], changes, [len(symbols)]]))
        self.runs = np.concatenate([[0], changes])
        self.ends = np.repeat(self.runs + lengths, lengths)

    def above(self, heads, symbols):
        """The next level, whose symbols begin at ``heads``."""
        sizes = np.diff(np.append(heads, len(self.symbols)))
        self.up = np.repeat(np.arange(len(heads)), sizes)
        self.heads = np.zeros(len(self.symbols), bool)
        self.heads[heads] = True
        return _Level(symbols, self.starts[heads], heads)

    def mirrored(self, length, below):
        """The same level of the reversed sequence."""
        turned = object.__new__(_Level)
        n = len(self.symbols)
        turned.symbols = self.symbols[::-1]
        turned.starts = length - np.append(self.starts[1:], length)[::-1]
        turned.ends = n - np.repeat(self.runs, np.diff(np.append(self.runs, n)))[::-1]
        turned.up = turned.heads = turned.down = None
        if self.up is not None:
            turned.up = self.up[-1] - self.up[::-1]
            turned.heads = np.append(True, turned.up[1:] != turned.up[:-1])
        if below is not None:
            turned.down = np.flatnonzero(below.heads)
        return turned


def _named(first, second):
    """Dense numbers for pairs of numbers; equal pairs, equal numbers."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def _side(symbols, turn):
    """Whether each symbol is on the right of the cut of this turn, by the symbol alone."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) & np.uint64(1) == 1


class Grammar:
    """The levels of a sequence of numbers, until a level has no more than ``least`` symbols.

    Two places are only compared up to where they differ, so a caller ends each of several
    texts with a number of its own.
    """

    def __init__(self, sequence, least=1):
        symbols = np.unique(np.asarray(sequence, np.int64), return_inverse=True)[1]
        self.length = len(symbols)
        level = _Level(symbols, np.arange(self.length))
        self.levels = [level]
        turn = 0
        while len(level.symbols) > max(least, 1):
            if len(level.runs) < len(level.symbols):
                sizes = level.ends[level.runs] - level.runs
                level = level.above(level.runs, _named(level.symbols[level.runs], sizes))
            else:
                right = _side(level.symbols, turn)
                joins = ~right[:-1] & right[1:]
                turned = right[:-1] & ~right[1:]
                if turned.sum() > joins.sum():
                    joins = turned
                turn += 1
                if not joins.any():
                    continue
                heads = np.flatnonzero(np.append(True, ~joins))
                paired = np.append(joins, False)[heads]
                second = np.where(paired, level.symbols[np.minimum(heads + 1, len(level.symbols) - 1)] + 1, 0)
                level = level.above(heads, _named(level.symbols[heads], second))
            self.levels.append(level)
        below = [None, *self.levels]
        turned = []
        for number, own in enumerate(self.levels):
            turned.append(own.mirrored(self.length, turned[number - 1] if below[number] is not None else None))
        self.backward = turned

    def ahead(self, one, other):
        """How many numbers agree from two arrays of places on."""
        return _extended(self.levels, self.length, one, other)

    def behind(self, one, other):
        """How many numbers agree before two arrays of places, going backwards."""
        return _extended(self.backward, self.length, self.length - np.asarray(one), self.length - np.asarray(other))


def _agreeing(level, x, y):
    inside = (x < len(level.symbols)) & (y < len(level.symbols))
    last = len(level.symbols) - 1
    return inside & (level.symbols[np.minimum(x, last)] == level.symbols[np.minimum(y, last)])


def _passed(level, x, y, moving):
    """Move past the runs that begin at both places, as far as the shorter one goes."""
    steps = np.minimum(level.ends[x[moving]] - x[moving], level.ends[y[moving]] - y[moving])
    x[moving] += steps
    y[moving] += steps


def _extended(levels, length, one, other):
    x, y = np.array(one, np.int64), np.array(other, np.int64)
    first = x.copy()
    top = np.zeros(len(x), np.int64)
    climbing = np.arange(len(x))
    for height, level in enumerate(levels):
        while True:
            agree = _agreeing(level, x[climbing], y[climbing])
            climbing = climbing[agree]
            if level.up is None or not len(climbing):
                break
            # Beside equal symbols, either both places begin a symbol of the next level or neither.
            inner = climbing[~(level.heads[x[climbing]] & level.heads[y[climbing]])]
            if not len(inner):
                break
            _passed(level, x, y, inner)
        if level.up is None or not len(climbing):
            break
        x[climbing], y[climbing] = level.up[x[climbing]], level.up[y[climbing]]
        top[climbing] = height + 1
    for height in range(len(levels) - 1, -1, -1):
        level = levels[height]
        here = np.flatnonzero(top >= height)
        if height < len(levels) - 1:
            above = levels[height + 1]
            for places in (x, y):
                lowered = np.flatnonzero(top > height)
                end = places[lowered] >= len(above.symbols)
                places[lowered] = np.where(
                    end, len(level.symbols), above.down[np.minimum(places[lowered], len(above.symbols) - 1)]
                )
        while len(here):
            here = here[_agreeing(level, x[here], y[here])]
            if len(here):
                _passed(level, x, y, here)
    return np.append(levels[0].starts, length)[x] - first
