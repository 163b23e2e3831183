"""A linear-chain conditional random field over word shapes, in numpy."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from itertools import pairwise

import numpy as np

#: Ends of a text count as neighbours of this class and as label 0.
EDGE = "<>"
#: What may stand around a word without being part of it.
EDGES = ".,;:!?\"'<>[]"

_RUNS = re.compile(r"(.)\1*")
_DIGITS = re.compile("9+")


def shape(word: str) -> str:
    """Letters to x, capitals to X, digits to 9, the rest kept; runs are collapsed.

    Runs of up to four digits keep their length; five nines stand for 5 to 11
    and six for more.
    """
    marks = "".join(
        "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word
    )
    return _RUNS.sub(_collapsed, marks)


def _collapsed(run: re.Match) -> str:
    size = len(run[0])
    if run[1] != "9":
        return run[1]
    return "9" * (size if size <= 4 else 5 if size < 12 else 6)


def shape_class(form: str) -> str:
    """A coarse class for what neighbours see."""
    bare = form.strip(EDGES)
    if not bare:
        return "punct"
    if "@" in bare:
        return "@"
    if bare in ("x", "X", "Xx"):
        return bare
    if set(bare) <= {"9"}:
        return bare
    return "digits" if "9" in bare else "mixed"


def features(form: str) -> tuple[str, ...]:
    digits = form.count("9")
    bare = form.strip(EDGES)
    skeleton = _DIGITS.sub("9", bare)
    return (
        f"b={bare}",
        f"c={shape_class(form)}",
        f"n={min(digits, 12)}",
        f"r={max(map(len, _DIGITS.findall(bare)), default=0)}",
        f"l={form[0]}",
        f"z={bare[-1:]}",
        f"k={''.join(sorted(set(bare)))}",
        f"t={skeleton}",
        *sorted({f"2={a}{b}" for a, b in pairwise(f"^{skeleton}$")}),
    )


@dataclass(frozen=True)
class Field:
    """Weights: own features, left and right neighbour class, label transitions."""

    labels: tuple[str, ...]
    own: dict[str, np.ndarray]
    left: dict[str, np.ndarray]
    right: dict[str, np.ndarray]
    moves: np.ndarray

    @property
    def safe_margins(self) -> np.ndarray:
        """Label 0 ahead of every other label by more than this in a word's score is best for it.

        It is what the moves to a label and from it can make up for at most,
        whatever the labels around.
        """
        to = (self.moves - self.moves[:, :1]).max(axis=0)
        off = (self.moves - self.moves[:1]).max(axis=1)
        return (to + off)[1:]


def varied(lines: list[tuple[list[str], list[str]]], times: int, seed: int) -> list:
    """Each labelled line with its digits and letters drawn anew, ``times`` over."""
    draw = random.Random(seed)
    swap = lambda c: (
        draw.choice("0123456789")
        if c.isdigit()
        else draw.choice("abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if c.isascii() and c.isalpha()
        else c
    )
    return [
        (["".join(map(swap, w)) for w in words], labels)
        for words, labels in lines
        for _ in range(times)
    ]


def train(examples: list[tuple[list[str], list[str]]], steps: int = 200) -> Field:
    """Penalised maximum likelihood by Adam; label 0 is ``O``."""
    labels = ("O", *sorted({x for _, own in examples for x in own} - {"O"}))
    number = {x: k for k, x in enumerate(labels)}
    size, longest = len(labels), max(len(w) for w, _ in examples)
    columns: dict[str, int] = {"": 0}  # column 0 fills up words with fewer features
    index = np.zeros((len(examples), longest, 0), dtype=np.int64)
    gold = np.zeros((len(examples), longest), dtype=np.int64)
    inside = np.zeros((len(examples), longest), dtype=bool)
    for k, (words, own) in enumerate(examples):
        forms = [shape(w) for w in words]
        classes = [EDGE, *map(shape_class, forms), EDGE]
        for t, form in enumerate(forms):
            names = (*features(form), f"<{classes[t]}", f">{classes[t + 2]}")
            at = [columns.setdefault(f, len(columns)) for f in names]
            if len(at) > index.shape[2]:
                index = np.pad(index, ((0, 0), (0, 0), (0, len(at) - index.shape[2])))
            index[k, t, : len(at)] = at
            gold[k, t], inside[k, t] = number[own[t]], True
    weights, moves = np.zeros((len(columns), size)), np.zeros((size, size))
    slow = [np.zeros_like(weights), np.zeros_like(moves)]
    fast = [np.zeros_like(weights), np.zeros_like(moves)]
    at = np.arange(len(examples))
    last = inside.sum(axis=1) - 1
    for step in range(1, steps + 1):
        scores = weights[index].sum(axis=2)
        ahead = np.zeros((longest, len(examples), size))
        ahead[0] = scores[:, 0] + moves[0]
        for t in range(1, longest):
            step_in = _fold(ahead[t - 1][:, :, None] + moves[None], 1) + scores[:, t]
            ahead[t] = np.where(inside[:, t, None], step_in, ahead[t - 1])
        total = _fold(ahead[-1] + moves[:, 0], 1)
        back = np.zeros((longest, len(examples), size))
        back[-1] = moves[:, 0]
        for t in range(longest - 2, -1, -1):
            step_out = _fold(moves[None] + (scores[:, t + 1] + back[t + 1])[:, None, :], 2)
            back[t] = np.where(inside[:, t + 1, None], step_out, moves[:, 0])
        g_weights, g_moves = np.zeros_like(weights), np.zeros_like(moves)
        for t in range(longest):
            here = inside[:, t]
            p = np.exp(ahead[t] + back[t] - total[:, None]) * here[:, None]
            p[at[here], gold[here, t]] -= 1
            for f in range(index.shape[2]):
                np.add.at(g_weights, index[here, t, f], p[here])
            before = gold[:, t - 1] if t else np.zeros(len(examples), dtype=np.int64)
            np.add.at(g_moves, (before[here], gold[here, t]), -1)
            if t:
                pair = ahead[t - 1][:, :, None] + moves[None] + (scores[:, t] + back[t])[:, None, :]
                g_moves += np.exp(pair - total[:, None, None])[here].sum(axis=0)
            else:
                g_moves[0] += np.exp(ahead[0] + back[0] - total[:, None]).sum(axis=0)
        g_weights[0] = 0
        ends = np.exp(ahead[-1] + moves[:, 0] - total[:, None]).sum(axis=0)
        g_moves[:, 0] += ends
        np.add.at(g_moves, (gold[at, last], 0), -1)
        for k, (value, gradient) in enumerate(((weights, g_weights), (moves, g_moves))):
            gradient = gradient / len(examples) + 1e-3 * value
            slow[k] = 0.9 * slow[k] + 0.1 * gradient
            fast[k] = 0.99 * fast[k] + 0.01 * gradient**2
            value -= (
                0.1 * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.99**step)) + 1e-8)
            )
    pick = lambda mark: {f[1:]: weights[c] for f, c in columns.items() if f.startswith(mark)}
    own = {f: weights[c] for f, c in columns.items() if f and f[0] not in "<>"}
    return Field(labels, own, pick("<"), pick(">"), moves)


def _fold(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


class Decoder:
    """Viterbi over many texts at once.

    Words whose score puts label 0 ahead by the safe margins are label 0 in
    every best path, so the chain falls apart there without loss; only the
    runs between are decoded, side by side, longest first.  Whether a word
    keeps that margin follows from its shape and the classes next to it, so
    that is looked up and only the other words are scored.
    """

    def __init__(self, field: Field, memo: int = 150_000):
        self._field = field
        self._none = np.zeros(len(field.labels))
        self._margins = field.safe_margins
        # Class 0 stands for the ends of a text, the last for classes never trained on.
        names = [EDGE, *sorted((field.left.keys() | field.right.keys()) - {EDGE}), ""]
        self._classes = {name: k for k, name in enumerate(names)}
        self._left = np.array([field.left.get(n, self._none) for n in names])
        self._right = np.array([field.right.get(n, self._none) for n in names])
        self._around = (self._left[:, None] + self._right[None]).reshape(-1, len(field.labels))
        self._forms: dict[str, int] = {}
        self._kinds: dict[tuple, int] = {}
        self._own: list[np.ndarray] = []
        self._class_of: list[int] = []
        self._opens: list[np.ndarray] = []
        self._words: dict[str, int] = {}
        self._most = memo

    def _form(self, word: str) -> int:
        form = shape(word)
        found = self._forms.get(form)
        if found is None:
            # Only features with weights count, so what is held does not grow with the texts.
            known = tuple(f for f in features(form) if f in self._field.own)
            kind = self._classes.get(shape_class(form), len(self._classes) - 1)
            found = self._kinds.get((known, kind))
            if found is None:
                own = sum((self._field.own[f] for f in known), self._none)
                found = self._kinds[known, kind] = len(self._own)
                self._own.append(own)
                self._class_of.append(kind)
                scores = own + self._around
                opens = (scores[:, :1] - scores[:, 1:] <= self._margins).any(axis=1)
                self._opens.append(opens.reshape(len(self._left), -1))
            if len(self._forms) < self._most and len(form) <= 40:
                self._forms[form] = found
        if len(self._words) < self._most and len(word) <= 40:
            self._words[word] = found
        return found

    def decode(self, texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
        """(first word, end word, label) of the runs of each label but 0, by text."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not sizes.sum():
            return found
        forms: list[int] = []
        for words in texts:
            own = list(map(self._words.get, words))
            for k, x in enumerate(own):
                if x is None:
                    own[k] = self._form(words[k])
            forms += own
        form = np.array(forms, dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        kinds = np.array(self._class_of, dtype=np.int64)[form]
        before, after = np.roll(kinds, 1), np.roll(kinds, -1)
        before[begins[:-1][sizes > 0]] = 0
        after[begins[1:][sizes > 0] - 1] = 0
        at = np.flatnonzero(np.array(self._opens)[form, before, after])
        if not len(at):
            return found
        owner = np.searchsorted(begins, at, side="right") - 1
        scores = np.array(self._own)[form[at]] + self._left[before[at]] + self._right[after[at]]
        starts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
        lengths = np.diff(starts, append=len(at))
        labels = np.zeros(len(at), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        low = 0
        while low < len(order):
            # Blocks of bounded area, so that one long run costs no padding.
            width = int(lengths[order[low]])
            high = low + max(1, (1 << 18) // width)
            rows = order[low:high]
            self._viterbi(scores, starts[rows], lengths[rows], labels)
            low = high
        marked = np.flatnonzero(labels)
        if len(marked):
            place, doc, label = at[marked], owner[marked], labels[marked]
            fresh = (np.diff(place, prepend=-2) != 1) | (np.diff(label, prepend=-1) != 0)
            heads = np.flatnonzero(fresh | (np.diff(doc, prepend=-1) != 0))
            tails = np.append(heads[1:], len(marked)) - 1
            for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
                base = int(begins[doc[h]])
                run = (int(place[h]) - base, int(place[t]) - base + 1, int(label[h]))
                found[int(doc[h])].append(run)
        return found

    def _viterbi(
        self, scores: np.ndarray, at: np.ndarray, lengths: np.ndarray, labels: np.ndarray
    ) -> None:
        moves = self._field.moves
        width = int(lengths[0])
        best = scores[at] + moves[0]
        came = np.zeros((width, len(at), moves.shape[0]), dtype=np.int8)
        final = np.zeros(len(at), dtype=np.int64)
        alive = len(at)
        for t in range(width):
            if t:
                step = best[:alive, :, None] + moves[None]
                came[t, :alive] = step.argmax(axis=1)
                best[:alive] = step.max(axis=1) + scores[at[:alive] + t]
            ending = int(np.count_nonzero(lengths > t + 1))
            final[ending:alive] = (best[ending:alive] + moves[:, 0]).argmax(axis=1)
            alive = ending
        here = final.copy()
        for t in range(width - 1, -1, -1):
            live = int(np.count_nonzero(lengths > t))
            labels[at[:live] + t] = here[:live]
            if t:
                here[:live] = came[t, np.arange(live), here[:live]]
