"""Regular expressions over bytes, compiled to minimal DFA transition arrays.

A rule set becomes one automaton: the rules' syntax trees, reversed, are
joined into one NFA, subset construction makes it deterministic and partition
refinement minimises it.  Read backwards over a text, the state after byte
``p`` says which rules have a match that *starts* at ``p``, so a single byte
pass serves every rule, and matches come out leftmost-longest.

Supported syntax: literals, ``\\xHH`` and escaped punctuation, ``\\d``,
``[...]`` and ``[^...]``, ``(...)``, ``(?:...)``, ``(?i:...)``, ``|``, and the
quantifiers ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

#: Never occurs in UTF-8: it parts the documents of a buffer.
SEPARATOR = 0xFF

Bytes = frozenset
Tree = tuple


class _Parser:
    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.peek(token):
            self.at += len(token)
            return True
        return False

    def parse(self) -> Tree:
        tree = self.either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at:]!r}")
        return tree

    def either(self) -> Tree:
        options = [self.sequence()]
        while self.take("|"):
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    def sequence(self) -> Tree:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self.repeat())
        return ("seq", *parts)

    def repeat(self) -> Tree:
        tree = self.atom()
        while self.at < len(self.text):
            if self.take("?"):
                tree = ("rep", tree, 0, 1)
            elif self.take("*"):
                tree = ("rep", tree, 0, None)
            elif self.take("+"):
                tree = ("rep", tree, 1, None)
            elif self.take("{"):
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                break
        return tree

    def atom(self) -> Tree:
        if self.take("("):
            fold = self.fold
            if self.take("?i:"):
                self.fold = True
            else:
                self.take("?:")
            tree = self.either()
            if not self.take(")"):
                raise ValueError("missing )")
            self.fold = fold
            return tree
        if self.take("["):
            return self.folded(self.members())
        return self.folded(self.single())

    def single(self) -> Bytes:
        char = self.text[self.at]
        self.at += 1
        if char != "\\":
            if ord(char) > 127:
                raise ValueError("patterns are ASCII")
            return frozenset([ord(char)])
        char = self.text[self.at]
        self.at += 1
        if char == "x":
            self.at += 2
            return frozenset([int(self.text[self.at - 2 : self.at], 16)])
        if char == "d":
            return frozenset(range(48, 58))
        if char.isalnum():
            raise ValueError(f"unsupported escape \\{char}")
        return frozenset([ord(char)])

    def members(self) -> Bytes:
        negated = self.take("^")
        found: set[int] = set()
        first = True
        while first or not self.peek("]"):
            first = False
            one = self.single()
            if self.peek("-") and not self.peek("-]"):
                self.at += 1
                (low,), (high,) = one, self.single()
                found.update(range(low, high + 1))
            else:
                found |= one
        self.at += 1
        return frozenset(range(128)) - found if negated else frozenset(found)

    def folded(self, members: Bytes) -> Tree:
        if self.fold:
            chars = {chr(b) for b in members}
            members = frozenset(ord(x) for c in chars for x in (c.lower(), c.upper()))
        return ("set", members)


def parse(pattern: str) -> Tree:
    return _Parser(pattern).parse()


def reversed_tree(tree: Tree) -> Tree:
    kind = tree[0]
    if kind == "seq":
        return ("seq", *[reversed_tree(t) for t in reversed(tree[1:])])
    if kind == "or":
        return ("or", *[reversed_tree(t) for t in tree[1:]])
    if kind == "rep":
        return ("rep", reversed_tree(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[Bytes, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree: Tree, start: int) -> int:
        """States for ``tree`` from ``start`` on; returns the end state."""
        kind = tree[0]
        if kind == "set":
            source, end = self.state(), self.state()
            self.empty[start].append(source)
            self.moves[source] = (tree[1], end)
            return end
        if kind == "seq":
            for part in tree[1:]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for option in tree[1:]:
                entry = self.state()
                self.empty[start].append(entry)
                self.empty[self.add(option, entry)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(inner, start)
        self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """``table[state * width + classes[byte]]`` is the next state times width.

    States from ``first_accepting`` on accept; ``accepts`` has, by state, the
    bits of the rules that do.  State 0 is the start.
    """

    table: np.ndarray
    classes: np.ndarray
    width: int
    accepts: np.ndarray
    first_accepting: int

    @property
    def states(self) -> int:
        return len(self.accepts)


def compile_rules(trees: list[Tree], search: bool) -> Dfa:
    """One minimal DFA for all ``trees``; with ``search`` a match may begin anywhere."""
    nfa = _Nfa()
    start = nfa.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        entry = nfa.state()
        nfa.empty[start].append(entry)
        ends[nfa.add(tree, entry)] = 1 << k

    classes, width, samples = _byte_classes([m[0] for m in nfa.moves if m])
    closures: dict[int, frozenset] = {}

    def closure(state: int) -> frozenset:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closures[state] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
        return closures[state]

    first = closure(start)
    numbers, todo, rows, accepts = {first: 0}, deque([first]), [], []
    while todo:
        here = todo.popleft()
        accepts.append(sum({ends[x] for x in here if x in ends}))
        targets: list[set] = [set(first) if search else set() for _ in samples]
        for x in here:
            if nfa.moves[x]:
                members, to = nfa.moves[x]
                for c, byte in enumerate(samples):
                    if byte in members:
                        targets[c] |= closure(to)
        row = []
        for c, target in enumerate(targets):
            key = first if c == classes[SEPARATOR] and search else frozenset(target)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            row.append(numbers[key])
        rows.append(row)
    return _minimised(np.array(rows), np.array(accepts, dtype=np.int64), classes, width)


def _byte_classes(sets: list[Bytes]) -> tuple[np.ndarray, int, list[int]]:
    """Bytes that no set tells apart share a class."""
    signature: dict[tuple, int] = {}
    distinct = sorted(set(sets), key=sorted)
    classes, samples = np.zeros(256, dtype=np.uint8), []
    for byte in range(256):
        key = tuple(byte in s for s in distinct) if byte != SEPARATOR else ("end",)
        if key not in signature:
            signature[key] = len(signature)
            samples.append(byte)
        classes[byte] = signature[key]
    return classes, len(samples), samples


def _minimised(rows: np.ndarray, accepts: np.ndarray, classes: np.ndarray, width: int) -> Dfa:
    """Moore's refinement: split blocks by where their states lead until none splits."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        signature = np.column_stack([block, block[rows]])
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    count = int(block.max()) + 1
    member = np.zeros(count, dtype=np.int64)
    member[block] = np.arange(len(block))
    by_block = accepts[member]
    # The start comes first, accepting states last.
    order = sorted(range(count), key=lambda b: (by_block[b] != 0, b != block[0], b))
    place = np.empty(count, dtype=np.int64)
    place[order] = np.arange(count)
    member, by_block = member[order], by_block[order]
    table = place[block[rows[member]]] * width
    kind = np.uint16 if count * width < 1 << 16 else np.uint32
    accepting = int(np.count_nonzero(by_block == 0))
    if accepts[0] or place[block[0]]:
        raise ValueError("a rule matches the empty string")
    return Dfa(table.astype(kind).ravel(), classes, width, by_block, accepting)


def starts(dfa: Dfa, buffer: bytes, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Positions where matches start, ascending, and the rules' bits there.

    ``dfa`` is of reversed rules, in search form.  The backward pass runs in
    lanes side by side, each guessing that it begins in the start state; a
    lane whose guess was wrong is run again until it falls in with its trace.
    """
    symbols = np.frombuffer(buffer.translate(dfa.classes.tobytes()), dtype=np.uint8)[::-1]
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    padded = np.full(lanes * steps, dfa.classes[SEPARATOR], dtype=np.uint8)
    padded[:n] = symbols
    feed = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    trace = np.empty((steps, lanes), dtype=dfa.table.dtype)
    state = np.zeros(lanes, dtype=np.int64)
    for k in range(steps):
        state += feed[k]
        trace[k] = dfa.table.take(state)
        state[:] = trace[k]
    guess = np.zeros(lanes, dtype=np.int64)
    while True:
        true = np.concatenate([[0], trace[-1, :-1].astype(np.int64)])
        wrong = np.flatnonzero(true != guess)
        if not len(wrong):
            break
        guess = true
        now = true[wrong]
        for k in range(steps):
            now = dfa.table.take(now + feed[k, wrong])
            differs = now != trace[k, wrong]
            if not differs.all():
                wrong, now = wrong[differs], now[differs]
            if not len(wrong):
                break
            trace[k, wrong] = now
            now = now.astype(np.int64)
    hits = np.flatnonzero((trace >= dfa.first_accepting * dfa.width).T.ravel())
    hits = hits[hits < n]
    lane, step = np.divmod(hits, steps)
    bits = dfa.accepts[trace[step, lane].astype(np.int64) // dfa.width]
    return (n - 1 - hits)[::-1], bits[::-1]


def longest(dfa: Dfa, data: bytes, start: int) -> int:
    """End of the longest match that begins at ``start``, or -1."""
    table, classes = dfa.table, dfa.classes
    accepting, dead = dfa.first_accepting * dfa.width, dead_state(dfa)
    state, end = 0, -1
    for at in range(start, len(data)):
        state = int(table[state + int(classes[data[at]])])
        if state == dead:
            break
        if state >= accepting:
            end = at + 1
    return end


def dead_state(dfa: Dfa) -> int:
    """The non-accepting state that leads only to itself, or -1."""
    own = np.arange(dfa.first_accepting) * dfa.width
    rows = dfa.table.reshape(-1, dfa.width)[: dfa.first_accepting]
    dead = np.flatnonzero((rows == own[:, None]).all(axis=1))
    return int(own[dead[0]]) if len(dead) else -1
