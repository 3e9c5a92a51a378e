"""Small weighted finite-state transducers: total, deterministic, composed once and run over label sequences."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from typing import NamedTuple

Step = Callable[[Hashable, str], tuple[str, float, Hashable]]


class Wfst(NamedTuple):
    """arcs[state][label] = (output label, weight, next state); weights add up along a path."""

    start: int
    arcs: tuple[dict[str, tuple[str, float, int]], ...]

    def run(self, labels: Iterable[str]) -> tuple[float, str]:
        """The weight of the path of a label sequence, and its output."""
        state, total, out = self.start, 0.0, []
        arcs = self.arcs
        for x in labels:
            y, w, state = arcs[state][x]
            total += w
            out.append(y)
        return total, "".join(out)


def build(alphabet: str, start: Hashable, step: Step) -> Wfst:
    """The machine of the states that step reaches from start over the alphabet."""
    number, todo, arcs = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        row = {}
        for x in alphabet:
            y, w, after = step(state, x)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row[x] = (y, w, number[after])
        arcs.append(row)
    return Wfst(0, tuple(arcs))


def compose(a: Wfst, b: Wfst) -> Wfst:
    """First a, then b over a's output."""
    def step(state: tuple[int, int], x: str) -> tuple[str, float, tuple[int, int]]:
        y, w, i = a.arcs[state[0]][x]
        z, v, j = b.arcs[state[1]][y]
        return z, w + v, (i, j)

    return build("".join(a.arcs[0]), (a.start, b.start), step)
