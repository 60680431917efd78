"""Error-correcting chart parsing of token classes, with cells shared between files.

A text is lexed to one character per token. Brackets are paired at least cost (a table over all intervals of those that do
not match as they are); then, bottom up, the content of each pair becomes a cell of the chart, whose cost is the least
number of token insertions, deletions and substitutions that make it derivable, and the pair counts as one symbol. Within
a cell, the pieces between separators are parsed against a right-linear grammar of phrases, by the sets of states that
each number of edits reaches. Cells depend on their symbols only, so equal ones are parsed once a worker, whatever file
they stand in; the cost of a text is the sum of its cells' and of its brackets'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


#: Edits of a phrase up to which sets of states are kept per number of edits.
MANY = 48
#: Rows of the table of brackets without a match that are met at once.
ROWS = 64


class Phrases:
    """Least edit cost of a string against a grammar, given as an expression over characters: [..] ( ) | * + ?"""

    def __init__(self, expression: str):
        self.text, self.at = expression.replace(" ", "").replace("\n", ""), 0
        self.edges: list[list[tuple[str | None, int]]] = []
        start, end = self._choice()
        if self.at != len(self.text):
            raise ValueError(f"unbalanced expression at {self.at}")
        self.accept, self.start = end, start
        self._closures: dict[int, tuple[int, ...]] = {}
        self._step: dict[tuple[int, str], int] = {}
        self._any: dict[int, int] = {}
        self._final: dict[int, bool] = {}
        self.first = self._bits((start,))
        self.letters = {x for edges in self.edges for chars, _ in edges if chars for x in chars}
        self._arrays: tuple | None = None
        self.memo: dict[str, int] = {}

    def _state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _choice(self) -> tuple[int, int]:
        start, end = self._state(), self._state()
        while True:
            a, b = self._sequence()
            self.edges[start].append((None, a))
            self.edges[b].append((None, end))
            if self.at < len(self.text) and self.text[self.at] == "|":
                self.at += 1
                continue
            return start, end

    def _sequence(self) -> tuple[int, int]:
        start = last = self._state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            a, b = self._atom()
            self.edges[last].append((None, a))
            last = b
        return start, last

    def _atom(self) -> tuple[int, int]:
        char = self.text[self.at]
        self.at += 1
        if char == "(":
            a, b = self._choice()
            self.at += 1
        else:
            if char == "[":
                stop = self.text.index("]", self.at)
                chars = self.text[self.at : stop]
                self.at = stop + 1
            elif char == "\\":
                chars = self.text[self.at]
                self.at += 1
            else:
                chars = char
            a, b = self._state(), self._state()
            self.edges[a].append((chars, b))
        while self.at < len(self.text) and self.text[self.at] in "*+?":
            mark = self.text[self.at]
            self.at += 1
            start, end = self._state(), self._state()
            self.edges[start].append((None, a))
            self.edges[b].append((None, end))
            if mark in "*?":
                self.edges[start].append((None, end))
            if mark in "*+":
                self.edges[b].append((None, a))
            a, b = start, end
        return a, b

    def _closure(self, state: int) -> tuple[int, ...]:
        known = self._closures.get(state)
        if known is None:
            seen, todo = {state}, [state]
            while todo:
                for chars, target in self.edges[todo.pop()]:
                    if chars is None and target not in seen:
                        seen.add(target)
                        todo.append(target)
            # only states that something leaves by a character, and the end, tell sets apart
            known = self._closures[state] = tuple(s for s in seen if s == self.accept or any(c is not None for c, _ in self.edges[s]))
        return known

    def _bits(self, states) -> int:
        out = 0
        for state in states:
            for inner in self._closure(state):
                out |= 1 << inner
        return out

    @staticmethod
    def _members(bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out

    def step(self, bits: int, char: str) -> int:
        """The states behind a set of states and a character; sets are built once, as they come up."""
        key = (bits, char)
        known = self._step.get(key)
        if known is None:
            if len(self._step) > 100_000:
                self._step.clear()
            known = self._step[key] = self._bits({t for s in self._members(bits) for c, t in self.edges[s] if c is not None and char in c})
        return known

    def step_any(self, bits: int) -> int:
        """The states behind a set of states and any one character of the grammar."""
        known = self._any.get(bits)
        if known is None:
            if len(self._any) > 100_000:
                self._any.clear()
            known = self._any[bits] = self._bits({t for s in self._members(bits) for c, t in self.edges[s] if c is not None})
        return known

    def cost(self, word: str) -> int:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[word] = self._least(word)
        return known

    def _least(self, word: str) -> int:
        """Least number of insertions, deletions and substitutions, exact: the sets of states reached at each place with
        none, one, two ... edits, until one of them holds the end. A token in no phrase costs one wherever it stands, and
        opens no further set. Beyond MANY edits a table of all states is carried along instead."""
        end, step, step_any = 1 << self.accept, self.step, self.step_any
        unknown = [char not in self.letters for char in word]
        reached = [self.first]
        for char, odd in zip(word, unknown):
            last = reached[-1]
            reached.append((last | step_any(last)) if odd else step(last, char) if last else 0)
        edits = 0
        while not reached[-1] & end:
            edits += 1
            if edits > MANY:
                return self._table(word)
            before = reached
            reached = [before[0] | step_any(before[0])]
            for at, char in enumerate(word):
                # a match; the token left out; the token taken for another; a token put in
                if unknown[at]:
                    here = reached[at] | step_any(reached[at]) | before[at + 1]
                else:
                    here = step(reached[at], char) | before[at] | step_any(before[at]) | before[at + 1]
                if before[at + 1]:
                    here |= step_any(before[at + 1])
                reached.append(here)
        return edits + sum(unknown)

    def _table(self, word: str) -> int:
        """The same by the least cost of every state at every place, an array a token."""
        if self._arrays is None:
            at = {self.start: 0}
            edges, todo = [], [self.start]
            while todo:
                state = todo.pop()
                for inner in self._closure(state):
                    for chars, target in self.edges[inner]:
                        if chars is not None:
                            if target not in at:
                                at[target] = len(at)
                                todo.append(target)
                            edges.append((at[target], at[state], chars))
            edges.sort(key=lambda e: e[:2])
            to, source = (np.array([e[k] for e in edges]) for k in (0, 1))
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            ends = np.array([self.accept in self._closure(s) for s in at])
            self._arrays = (to[first], first, source, [e[2] for e in edges], ends, {})
        to, first, source, labels, ends, misses = self._arrays
        cost = np.full(len(ends), 1 << 29, np.int64)
        cost[0] = 0

        def put_in(cost: np.ndarray) -> np.ndarray:
            while True:
                more = cost.copy()
                more[to] = np.minimum(more[to], np.minimum.reduceat(cost[source], first) + 1)
                if (more == cost).all():
                    return cost
                cost = more

        cost = put_in(cost)
        for char in word:
            if char not in misses:
                misses[char] = np.array([char not in c for c in labels], np.int64)
            after = cost + 1
            after[to] = np.minimum(after[to], np.minimum.reduceat(cost[source] + misses[char], first))
            cost = put_in(after)
        return int(cost[ends].min())


@dataclass
class Result:
    """What a text's repair costs, and where: token positions of the edits, and how many brackets were open at the end."""

    cost: int = 0
    tokens: int = 0
    open: int = 0
    foreign: int = 0
    places: list[int] = field(default_factory=list)


PAIRS = {"(": ")", "[": "]", "{": "}"}
SYMBOL = {"(": "P", "[": "B", "{": "C"}


def pairing(brackets: str, pairs: dict[str, str]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost of balancing a string of brackets, and the pairs of places it leaves; places in no pair are left out.

    Adjacent matches are taken first, which costs nothing; what they leave is settled over all intervals: two brackets may
    be a pair at the cost of the ones taken for another, a single one is left out (or gets a partner) at a cost of 1.
    """
    closes = {v for v in pairs.values()}
    stack: list[int] = []
    found: list[tuple[int, int]] = []
    for at, char in enumerate(brackets):
        if stack and char in closes and pairs.get(brackets[stack[-1]]) == char:
            found.append((stack.pop(), at))
        else:
            stack.append(at)
    m = len(stack)
    if not m:
        return 0, found
    opens = np.array([brackets[at] in pairs for at in stack])
    first_open = int(opens.argmax()) if opens.any() else m
    if opens[first_open:].all():
        # only closing ones, then only opening ones: two neighbours of a kind are a pair at a cost of 1
        single = first_open % 2
        found += [(stack[i], stack[i + 1]) for i in range(0, first_open - single, 2)]
        if single and (m - first_open) % 2:
            first_open -= 1  # what is left of both
        found += [(stack[i], stack[i + 1]) for i in range(first_open, m - 1, 2)]
        return (m + 1) // 2 + (single and not m % 2), found
    kinds = {c: k for k, (o, v) in enumerate(pairs.items()) for c in (o, v)}
    kind = np.array([kinds[brackets[at]] for at in stack])
    # cost[i, j] of stack[i:j], at most half of all and one; below the diagonal more than any. Twice that must fit
    number = np.int16 if m < 20_000 else np.int32
    cost = np.full((m + 1, m + 1), m + 5 if m < 20_000 else 1 << 29, number)

    def change(i: int, until: int) -> np.ndarray:
        """What it takes to make a pair of i and each one behind it."""
        behind = opens[i + 1 : until]
        return np.where(behind, 1 + (not opens[i]), np.where(opens[i], kind[i] != kind[i + 1 : until], 1)).astype(number)

    cost[m, m] = 0
    for i in range(m - 1, -1, -1):
        cost[i, i], cost[i, i + 1] = 0, 1
        if i + 2 > m:
            continue
        # i alone, or with k: inside i+1..k, and what is left of k+1..j
        with_k = cost[i + 1, i + 1 : m] + change(i, m)
        least = cost[i, i + 2 :]
        np.add(cost[i + 1, i + 2 :], 1, out=least)
        for k in range(i + 2, m + 1, ROWS):
            rows = cost[k : k + ROWS, k:] + with_k[k - i - 2 : k - i - 2 + ROWS, None]
            np.minimum(least[k - i - 2 :], rows.min(0), out=least[k - i - 2 :])
    todo = [(0, m)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        with_k = cost[i + 1, i + 1 : j] + change(i, j) + cost[i + 2 : j + 1, j]
        best = int(with_k.argmin())
        if with_k[best] <= 1 + cost[i + 1, j]:
            k = i + 1 + best
            found.append((stack[i], stack[k]))
            todo += [(i + 1, k), (k + 1, j)]
        else:
            todo.append((i + 1, j))
    return int(cost[0, m]), found


class Chart:
    """A language's chart: phrases for each kind of cell and for the top level, and the separators between phrases.

    kinds tells the kind of a cell by its bracket and what stands before it in its own cell, where the bracket alone does
    not; whole cells are parsed as one phrase. pairs and symbols are those of the language's brackets.
    """

    def __init__(
        self,
        phrases: dict[str, Phrases],
        separators: str = ",;N",
        after_block: str = "C",
        joiners: str = "",
        top: str | None = None,
        kinds: Callable[[str, str], str] | None = None,
        whole: tuple[str, ...] = (),
        pairs: dict[str, str] = PAIRS,
        symbols: dict[str, str] = SYMBOL,
        order: Callable[[str, list[str]], int] | None = None,
        ended: dict[str, bool] | None = None,
    ):
        self.top = separators if top is None else top
        self.phrases, self.separators, self.after_block, self.joiners = phrases, separators, after_block, joiners
        self.kinds, self.whole, self.pairs, self.symbols, self.order = kinds, whole, pairs, symbols, order
        #: kinds of cells whose last phrase needs its separator unless it is a block; always, or only if one has it
        self.ended = ended or {}
        self.brackets = set(pairs) | set(pairs.values())
        self.cells: dict[tuple[str, str], int] = {}

    def cell(self, kind: str, content: str) -> int:
        key = (kind, content)
        known = self.cells.get(key)
        if known is None:
            if len(self.cells) > 200_000:
                self.cells.clear()
            known = self.cells[key] = self._parse(kind, content)
        return known

    def _parse(self, kind: str, content: str) -> int:
        grammar = self.phrases[kind]
        if kind in self.whole:
            return grammar.cost(content)
        cost, start, separators = 0, 0, self.top if kind == "top" else self.separators
        last, round_ = len(content), kind[0] == "("
        pieces = []
        for at, char in enumerate(content):
            if char in separators:
                if at > start:
                    cost += grammar.cost(content[start:at])
                    pieces.append(content[start:at])
                elif char == "," and (at == 0 or content[at - 1] == ",") and round_:
                    cost += 1
                start = at + 1
            elif char == self.after_block and at + 1 < last and content[at + 1] not in self.joiners and not round_ and kind[0] != "[":
                cost += grammar.cost(content[start : at + 1])
                start = at + 1
        if last > start:
            cost += grammar.cost(content[start:])
            pieces.append(content[start:])
            if kind in self.ended and content[-1] != self.after_block and (self.ended[kind] or ";" in content):
                cost += 1
        if self.order is not None:
            cost += self.order(kind, pieces)
        return cost

    def parse(self, tokens: str) -> Result:
        """tokens has brackets as such and X for what no token begins with."""
        out = Result(tokens=len(tokens), foreign=tokens.count("X"))
        places = [at for at, char in enumerate(tokens) if char in self.brackets]
        cost, pairs = pairing("".join([tokens[at] for at in places]), self.pairs)
        out.cost += cost
        other = {}
        for a, b in pairs:
            other[places[a]] = places[b]
        closing = set(other.values())
        if cost:
            alone = [at for at in places if at not in other and at not in closing]
            out.places += alone
            # open at the end: an opening bracket that has no closing one, or one that is none
            out.open = sum(tokens[at] in self.pairs and (at not in other or tokens[other[at]] not in self.pairs.values()) for at in places)
        stack: list[list] = [["top", [], -1]]
        for at, char in enumerate(tokens):
            if at in other:
                kind = char if char in self.pairs else "{" if "{" in self.pairs else next(iter(self.pairs))
                stack.append([self.kinds(kind, "".join(stack[-1][1])) if self.kinds else kind, [], kind])
            elif at in closing:
                kind, content, bracket = stack.pop()
                found = self.cell(kind, "".join(content))
                if found:
                    out.cost += found
                    out.places.append(at)
                stack[-1][1].append(self.symbols[bracket] if content or bracket + "0" not in self.symbols else self.symbols[bracket + "0"])
            elif char not in self.brackets:
                stack[-1][1].append(char)
        found = self.cell("top", "".join(stack[0][1]))
        if found:
            out.cost += found
            out.places.append(len(tokens) - 1)
        return out
