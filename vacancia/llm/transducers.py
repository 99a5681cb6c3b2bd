"""Small deterministic transducers over symbols, and the grammar of abusive clauses composed of five of them.

A tape holds one symbol for each word or mark: ``o`` (any word), ``I`` insult, ``T`` threat, ``Y`` target (who is addressed or
meant), ``N`` negation, ``R`` reporting verb, ``Q`` quotation mark, ``|`` the end of a clause, ``P`` the end of a paragraph.
Each transducer rewrites symbols by what it has met, and ends of clauses carry on what it knows of the clause:

* negation: I and T up to SCOPE words after N become ``i`` and ``t``;
* reported speech: I and T between quotation marks, or behind R in the clause, become ``r``;
* target: the end of a clause with Y gets ``Y``;
* insult and threat: the end of a clause gets the strongest form that the clause held.

Composed, they read a tape once and give for each end of a clause its pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: Words after a negation that it reaches.
SCOPE = 4
WORDS, MARKS, ENDS = "oITYNR", "Q", "|P"
PATTERNS = ("directed insult", "insult", "directed threat", "threat", "negated", "reported")


@dataclass
class Transducer:
    """arcs[state][symbol] is (next state, output); state 0 is the first."""

    arcs: list[dict[str, tuple[int, str]]]

    def __call__(self, tape: list[str]) -> list[str]:
        state, out = 0, []
        for symbol in tape:
            state, got = self.arcs[state][symbol]
            out.append(got)
        return out


def reachable(start: object, symbols: list[str], step: Callable[[object, str], tuple[object, str]]) -> Transducer:
    """The transducer of all states that ``step`` leads to from ``start``."""
    numbers, queue, arcs = {start: 0}, [start], []
    for state in queue:
        row = {}
        for symbol in symbols:
            following, out = step(state, symbol)
            if following not in numbers:
                numbers[following] = len(numbers)
                queue.append(following)
            row[symbol] = (numbers[following], out)
        arcs.append(row)
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """First a, then b, in one pass."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str]:
        p, middle = a.arcs[state[0]][symbol]
        q, out = b.arcs[state[1]][middle]
        return (p, q), out

    return reachable((0, 0), list(a.arcs[0]), step)


def _outputs(t: Transducer) -> list[str]:
    return sorted({out for row in t.arcs for _, out in row.values()})


def negation(symbols: list[str]) -> Transducer:
    def step(left: int, s: str) -> tuple[int, str]:
        if s[0] in ENDS:
            return 0, s
        if s == "N":
            return SCOPE, s
        if s in MARKS:
            return left, s
        return max(left - 1, 0), s.lower() if left and s in "IT" else s

    return reachable(0, symbols, step)


def reported(symbols: list[str]) -> Transducer:
    def step(state: tuple[bool, bool], s: str) -> tuple[tuple[bool, bool], str]:
        quoted, told = state
        if s == "Q":
            return (not quoted, told), s
        if s[0] in ENDS:
            return (quoted and s[0] != "P", False), s  # a quotation mark that is never closed ends with its paragraph
        return (quoted, told or s == "R"), "r" if s in "ITit" and (quoted or told) else s

    return reachable((False, False), symbols, step)


def target(symbols: list[str]) -> Transducer:
    return reachable(False, symbols, lambda met, s: (False, s + "Y" * met) if s[0] in ENDS else (met or s == "Y", s))


def strongest(symbols: list[str], full: str) -> Transducer:
    """Of the forms ``full``, reported and negated, in this order, the first that a clause holds is put to its end."""
    order = (full, "r", full.lower())

    def step(met: int, s: str) -> tuple[int, str]:
        if s[0] in ENDS:
            return len(order), s + (order[met] if met < len(order) else "")
        return min(met, order.index(s) if s in order else len(order)), s

    return reachable(len(order), symbols, step)


def pattern_of(end: str) -> str | None:
    """Of an end of a clause as the transducers leave it."""
    marks = end[1:]
    if "T" in marks:
        return "directed threat" if "Y" in marks else "threat"
    if "I" in marks:
        return "directed insult" if "Y" in marks else "insult"
    return "reported" if "r" in marks else "negated" if "i" in marks or "t" in marks else None


def grammar() -> Transducer:
    """All five, composed; the ends of clauses become patterns, everything else is itself."""
    whole = negation([*WORDS, *MARKS, *ENDS])
    for part in (reported, target, lambda s: strongest(s, "I"), lambda s: strongest(s, "T")):
        whole = compose(whole, part(_outputs(whole)))
    return Transducer([{s: (to, (pattern_of(out) or "") if s in ENDS else out) for s, (to, out) in row.items()} for row in whole.arcs])
