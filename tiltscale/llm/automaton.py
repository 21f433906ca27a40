"""Regular expressions as one deterministic automaton over bytes.

Each rule is compiled on its own by subset construction, the rules are multiplied and
the product is minimised, so that one table lookup a byte advances all of them.

A state of a rule's automaton is a list of threads, the earliest start first, which makes
the automaton find what a leftmost search finds: a match cuts off the threads that started
later, and none starts until it is over.  The match with the leftmost start wins, and of
those the longest; then the search goes on behind it.  Rules have to end in a way that each
further byte either prolongs the match or ends it (``x+``, ``x{8,}``, a fixed end), so that
no byte is ever read twice; others are refused when compiled.
"""

from dataclasses import dataclass

import numpy as np

_DIGITS = "0123456789"


@dataclass(frozen=True)
class Rule:
    """A named pattern; a match also needs ``least`` bytes, of the part that ``measured`` returns."""

    name: str
    pattern: str
    least: int = 0
    measured: object = bytes


class _Parser:
    """A pattern as nested tuples.

    Literals, escapes, ``\\xHH``, classes, groups, ``(?i:…)``, ``|``, ``? * + {m} {m,} {m,n}``,
    all of ASCII.
    """

    def __init__(self, pattern):
        self.pattern, self.at, self.any_case = pattern, 0, False

    def _peek(self):
        return self.pattern[self.at : self.at + 1]

    def _take(self):
        char = self._peek()
        if not char:
            raise ValueError(f"pattern ends early: {self.pattern}")
        self.at += 1
        return char

    def parse(self):
        tree = self._either()
        if self._peek():
            raise ValueError(f"unbalanced pattern: {self.pattern}")
        return tree

    def _either(self):
        ways = [self._sequence()]
        while self._peek() == "|":
            self._take()
            ways.append(self._sequence())
        return ways[0] if len(ways) == 1 else ("either", ways)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated(self._atom()))
        return ("sequence", parts)

    def _repeated(self, part):
        while self._peek() and self._peek() in "?*+{":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(mark := self._take(), (0, 0))
            if mark == "{":
                body = ""
                while (char := self._take()) != "}":
                    body += char
                first, comma, last = body.partition(",")
                low = int(first)
                high = low if not comma else int(last) if last else None
            part = ("repeat", part, low, high)
        return part

    def _atom(self):
        char = self._take()
        if char == "(":
            before = self.any_case
            if self._peek() == "?":
                self._take()
                flag = self._take()
                if flag == "i":
                    self.any_case = True
                    flag = self._take()
                if flag != ":":
                    raise ValueError(f"unknown group: {self.pattern}")
            inside = self._either()
            if self._take() != ")":
                raise ValueError(f"unbalanced pattern: {self.pattern}")
            self.any_case = before
            return inside
        if char == "[":
            return self._bytes(self._class())
        if char in ".^$":
            raise ValueError(f"{char} is not supported: {self.pattern}")
        return self._bytes({self._escaped() if char == "\\" else ord(char)})

    def _escaped(self):
        char = self._take()
        if char == "x":
            return int(self._take() + self._take(), 16)
        if char.isalnum():
            raise ValueError(f"\\{char} is not supported: {self.pattern}")
        return ord(char)

    def _class(self):
        found = set()
        if self._peek() == "^":
            raise ValueError(f"negated classes are not supported: {self.pattern}")
        while (char := self._take()) != "]":
            low = self._escaped() if char == "\\" else ord(char)
            if self._peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self._take()
                char = self._take()
                found.update(range(low, (self._escaped() if char == "\\" else ord(char)) + 1))
            else:
                found.add(low)
        return found

    def _bytes(self, found):
        if max(found) > 127:
            raise ValueError(f"patterns are of ASCII: {self.pattern}")
        if self.any_case:
            found = {ord(c) for b in found for c in (chr(b).lower(), chr(b).upper())}
        return ("bytes", frozenset(found))


class _Threads:
    """States with empty moves and byte moves; 0 is the start, ``last`` the end."""

    def __init__(self, tree):
        self.empty, self.moves = [], []
        start, self.last = self._build(tree)
        assert start == 0

    def _new(self):
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def _build(self, tree):
        start = self._new()
        kind, value = tree[0], tree[1]
        if kind == "bytes":
            end = self._new()
            self.moves[start].append((value, end))
            return start, end
        if kind == "sequence":
            end = start
            for part in value:
                first, last = self._build(part)
                self.empty[end].append(first)
                end = last
            return start, end
        if kind == "either":
            ways = [self._build(way) for way in value]
            end = self._new()
            for first, last in ways:
                self.empty[start].append(first)
                self.empty[last].append(end)
            return start, end
        low, high = tree[2], tree[3]
        end, ends = start, []
        for n in range(max(low, 1) if high is None else high):
            if n >= low:
                ends.append(end)
            first, last = self._build(value)
            self.empty[end].append(first)
            end = last
            if high is None and n == max(low, 1) - 1:
                self.empty[last].append(first)
        final = self._new()
        for skipped in [*ends, end]:
            self.empty[skipped].append(final)
        return start, final

    def reversed(self):
        turned = object.__new__(_Threads)
        # The end becomes state 0 by swapping the numbers of both.
        swap = {0: self.last, self.last: 0}
        turned.empty = [[] for _ in self.empty]
        turned.moves = [[] for _ in self.moves]
        turned.last = self.last
        for state in range(len(self.empty)):
            here = swap.get(state, state)
            for target in self.empty[state]:
                turned.empty[swap.get(target, target)].append(here)
            for found, target in self.moves[state]:
                turned.moves[swap.get(target, target)].append((found, here))
        return turned

    def closure(self, states):
        """States that empty moves lead to and that read a byte or are the end."""
        seen, left = set(states), list(states)
        while left:
            for target in self.empty[left.pop()]:
                if target not in seen:
                    seen.add(target)
                    left.append(target)
        return frozenset(s for s in seen if self.moves[s] or s == self.last)

    def step(self, states, byte):
        return self.closure([target for s in states for found, target in self.moves[s] if byte in found])


def _classes(rules):
    """Byte → number of its class: bytes that no pattern tells apart share one."""
    sets = sorted({found for threads in rules for moves in threads.moves for found, _ in moves}, key=sorted)
    numbers, classes = {}, []
    for byte in range(256):
        classes.append(numbers.setdefault(tuple(byte in found for found in sets), len(numbers)))
    return np.array(classes)


def _explored(start, step, symbols):
    """Subset construction from ``start``: the states found, and the table of what ``step`` gives."""
    numbers, order, table = {start: 0}, [start], []
    for state in order:
        row = []
        for symbol in symbols:
            target, *more = step(state, symbol)
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append((numbers[target], *more))
        table.append(row)
    return order, table


def _groups(rows):
    """A number for each row of an array; equal rows, equal numbers.

    Rows are told apart by a hash of them, which is then checked against the rows.
    """
    weights = np.random.default_rng(0).integers(1, 2**63, rows.shape[1], dtype=np.uint64)
    hashed = (rows.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    first, group = np.unique(hashed, return_index=True, return_inverse=True)[1:]
    if (rows != rows[first[group]]).any():
        return np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    return group


def _minimised(following, marks):
    """Class of each state: states are one if their ``marks``, and all that follows, agree.

    ``following`` is the table of next states; ``marks`` an array with a row per state.
    """
    group = _groups(marks)
    while True:
        finer = _groups(np.column_stack([group, group[following]]))
        if finer.max() == group.max():
            return group
        group = finer


class _Search:
    """One rule's automaton: table of next states, whether a move ends a match, whether a state holds one."""

    def __init__(self, rule, threads, symbols):
        self.rule, self.threads = rule, threads
        begin = threads.closure([0])
        if threads.last in begin:
            raise ValueError(f"{rule.name} matches the empty text")
        self.begin = begin
        order, table = _explored(((begin,), False), self._step, symbols)
        following = np.array([[target for target, _ in row] for row in table])
        ends = np.array([[over for _, over in row] for row in table])
        holds = np.array([matched for _, matched in order])
        group = _minimised(following, np.column_stack([holds, ends]))
        first = np.unique(group, return_index=True)[1]
        self.following, self.ends, self.holds = group[following[first]], ends[first], holds[first]
        self.start = int(group[0])
        # Backwards from the end of a match, the furthest place where the pattern can start.
        back = threads.reversed()
        order, table = _explored(back.closure([0]), lambda s, b: (back.step(s, b),), symbols)
        self.back = [[target for (target,) in row] for row in table]
        self.back_holds = [back.last in s for s in order]
        self.back_dead = [not s for s in order]

    def _step(self, state, byte):
        groups, matched = state
        moved, seen, accepts = [], set(), False
        for group in groups:
            left = self.threads.step(group, byte) - seen
            if left:
                moved.append(frozenset(left))
                seen |= left
                if self.threads.last in left:
                    accepts = True
                    break
        if matched and not moved:
            after, _ = self._step(((self.begin,), False), byte)
            return after, True
        if matched and not accepts:
            raise ValueError(f"{self.rule.name}: a match that is not prolonged has to end")
        if not accepts:
            fresh = self.begin - seen
            if fresh:
                moved.append(frozenset(fresh))
        return (tuple(moved), accepts), False


class Automaton:
    """All rules at once; ``spans(data)`` gives ``(start, rule number, end)`` in bytes."""

    def __init__(self, rules):
        self.rules = tuple(rules)
        threads = [_Threads(_Parser(rule.pattern).parse()) for rule in self.rules]
        classes = _classes(threads)
        symbols = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
        searches = [_Search(rule, t, symbols) for rule, t in zip(self.rules, threads)]
        self._multiply(searches, len(symbols))
        self.translation = bytes(classes.astype(np.uint8))
        self.back = [(s.back, s.back_holds, s.back_dead) for s in searches]

    def _multiply(self, searches, width):
        """The product that can be reached, level by level, then minimised.

        A product state is a number in mixed radix, of the rules' states.  A move that ends
        matches leads to an *event*, which stands behind the states: the set of rules whose
        match is over, and the state that follows.
        """
        radix = [len(s.holds) for s in searches]
        places = [int(p) for p in np.cumprod([1, *radix[:-1]], dtype=object)]
        if places[-1] * radix[-1] >= 2**62 or len(searches) >= 62:
            raise ValueError("too many rules for one automaton")

        def parts(keys):
            return [keys // place % size for place, size in zip(places, radix)]

        known = np.array([sum(s.start * p for s, p in zip(searches, places))])
        frontier, order, moves, overs = known, [known], [], []
        while len(frontier):
            target, over = np.zeros((2, len(frontier), width), np.int64)
            for number, (search, states) in enumerate(zip(searches, parts(frontier))):
                target += search.following[states] * places[number]
                over += search.ends[states].astype(np.int64) << number
            moves.append(target)
            overs.append(over)
            frontier = np.setdiff1d(target, known)
            known = np.union1d(known, frontier)
            order.append(frontier)
        order, target, over = np.concatenate(order), np.concatenate(moves), np.concatenate(overs)
        at = np.argsort(order)
        following = at[np.searchsorted(order[at], target)]
        held = sum(s.holds[p].astype(np.int64) << n for n, (s, p) in enumerate(zip(searches, parts(order))))
        group = _minimised(following, np.column_stack([held, over]))
        first = np.unique(group, return_index=True)[1]
        self.start, self.held = int(group[0]), held[first]
        table, over = group[following[first]], over[first]
        events, which = np.unique(np.column_stack([over.ravel(), table.ravel()]), axis=0, return_inverse=True)
        # Events without an ended match come first; they are left out as plain moves.
        plain = int((events[:, 0] == 0).sum())
        which = which.reshape(table.shape)
        self.table = np.where(which < plain, table, len(first) + which - plain).astype(np.int32)
        self.events = events[plain:]

    def scanner(self):
        return Scanner(self)


class Scanner:
    """A worker's form of an automaton: plain lists, which a loop over bytes reads fastest."""

    def __init__(self, automaton):
        self.rules, self.back = automaton.rules, automaton.back
        self.rows = automaton.table.tolist()
        self.start = automaton.start
        self.translation = automaton.translation
        numbers = range(len(self.rules))
        self.events = [([n for n in numbers if over >> n & 1], state) for over, state in automaton.events.tolist()]
        self.held = [[n for n in numbers if mask >> n & 1] for mask in automaton.held.tolist()]

    def _begin(self, number, symbols, floor, end):
        table, holds, dead = self.back[number]
        state, at, begin = 0, end, end
        while at > floor and not dead[state]:
            at -= 1
            state = table[state][symbols[at]]
            if holds[state]:
                begin = at
        return begin

    def spans(self, data):
        """Matches of all rules, in order of start and then rule; one pass over the bytes."""
        symbols = data.translate(self.translation)
        rows, states, state = self.rows, len(self.rows), self.start
        floors, found = [0] * len(self.rules), []
        for at, symbol in enumerate(symbols):
            state = rows[state][symbol]
            if state >= states:
                over, state = self.events[state - states]
                self._close(over, at, data, symbols, floors, found)
        self._close(self.held[state], len(data), data, symbols, floors, found)
        return sorted(found)

    def _close(self, numbers, end, data, symbols, floors, found):
        for number in numbers:
            begin = self._begin(number, symbols, floors[number], end)
            floors[number] = end
            rule = self.rules[number]
            if len(rule.measured(data[begin:end])) >= rule.least:
                found.append((begin, number, end))
