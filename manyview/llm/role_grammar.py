"""Error-correcting Earley parsing of a conversation's roles.

The grammar is weighted and left-linear, so that every item of the chart begins at the
first turn and a column has one item for each symbol completed so far. An item keeps its
least (cost, audit), the audit being the initials of the edits that led to it. Audits are
not kept as texts but by their order within the column: all have an edit for each turn and
end with one, so none is the beginning of another and their order does not change by what
follows. A column is then small, and how a turn changes it is remembered.

A stretch of a conversation can be parsed from each symbol at once; ``join_stretches``
puts the results of stretches together.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

# The language (s?(ua)+)?: each symbol follows a symbol (none at the beginning) by a role's initial.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
PRODUCTIONS = ((SYSTEM, NOTHING, "s"), (ASKED, NOTHING, "u"), (ASKED, SYSTEM, "u"), (ASKED, ANSWERED, "u"), (ANSWERED, ASKED, "a"))
COMPLETE = (NOTHING, ANSWERED)
#: Roles that can be given or put in.
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


class Kind(NamedTuple):
    """What matters of a turn: its role's initial, whether it must go, whether it is cut short."""

    initial: str
    must_go: bool
    truncated: bool


class Move(NamedTuple):
    """From the item of one column to that of the next: what is put in first, and the turn's new role (None: deleted)."""

    before: int
    after: int
    cost: int
    letters: str
    inserted: tuple[str, ...]
    role: str | None


def insertions(symbol: int) -> list[tuple[int, tuple[str, ...]]]:
    """Symbols that inserted turns lead to. Coming to one twice costs more for nothing."""
    out, todo = [(symbol, ())], [(symbol, (), {symbol})]
    while todo:
        at, names, seen = todo.pop()
        for after, before, initial in PRODUCTIONS:
            if before == at and initial in NAMES and after not in seen:
                step = (after, (*names, NAMES[initial]))
                out.append(step)
                todo.append((*step, seen | {after}))
    return out


@lru_cache(None)
def moves(kind: Kind) -> tuple[Move, ...]:
    """All ways over a turn. Nothing is put in before a turn that is deleted: after it costs
    the same, and its audit is the lesser."""
    out = [Move(s, s, DELETE, "D", (), None) for s in range(4)]
    if kind.must_go:
        return tuple(out)
    extra = TRUNCATED if kind.truncated else 0
    for symbol in range(4):
        for middle, names in insertions(symbol):
            for after, before, initial in PRODUCTIONS:
                if before != middle:
                    continue
                put = "I" * len(names)
                cost = INSERT * len(names) + extra
                if initial == kind.initial:
                    out.append(Move(symbol, after, cost, put + "K", names, ""))
                elif initial in NAMES:
                    out.append(Move(symbol, after, cost + REROLE, put + "R", names, NAMES[initial]))
    return tuple(out)


Column = tuple[tuple[int, int, int, int], ...]  # (stretch begins with, symbol, cost, order of the audit)


def ordered(best: dict) -> tuple[Column, int]:
    """A column of the best (cost, *audit) for each item, costs less the least, and the least."""
    order = {x: i for i, x in enumerate(sorted({c[1:3] for c in best.values()}))}
    least = min(c[0] for c in best.values())
    return tuple((*item, c[0] - least, order[c[1:3]]) for item, c in sorted(best.items())), least


@lru_cache(1 << 16)
def advance(column: Column, kind: Kind) -> tuple[Column, int, dict]:
    """The next column, what its costs are less by, and the move that led to each item."""
    best: dict = {}
    for begin, symbol, cost, rank in column:
        for i, move in enumerate(moves(kind)):
            if move.before == symbol:
                item, found = (begin, move.after), (cost + move.cost, rank, move.letters, i)
                if item not in best or found < best[item]:
                    best[item] = found
    new, least = ordered(best)
    return new, least, {item: c[3] for item, c in best.items()}


def closing(column: Column) -> tuple[int, int, tuple[str, ...]]:
    """(cost, symbol, names): the cheapest end, and what is put in to come to it."""
    ends = []
    for _, symbol, cost, rank in column:
        for end, names in insertions(symbol):
            if end in COMPLETE:
                ends.append((cost + INSERT * len(names), rank, "I" * len(names), symbol, names))
    cost, _, _, symbol, names = min(ends)
    return cost, symbol, names


def parse(kinds: list[Kind], begin: int = NOTHING, end: int | None = None) -> tuple[list[Move], tuple[str, ...]]:
    """The move over each turn, and what is put in after the last. A stretch that others
    follow comes to ``end``; the last comes to a complete conversation."""
    column: Column = ((begin, begin, 0, 0),)
    chart = []
    for kind in kinds:
        column, _, came = advance(column, kind)
        chart.append(came)
    names: tuple[str, ...] = ()
    if end is None:
        _, end, names = closing(column)
    out = []
    for kind, came in zip(reversed(kinds), reversed(chart), strict=True):
        move = moves(kind)[came[begin, end]]
        out.append(move)
        end = move.before
    return out[::-1], names


def stretch(kinds: list[Kind]) -> tuple[list[int | None], list[int | None]]:
    """Cost and order of audit from each symbol to each, 16 of both; None where there is no way."""
    column: Column = tuple((s, s, 0, 0) for s in range(4))
    total = 0
    for kind in kinds:
        column, less, _ = advance(column, kind)
        total += less
    costs: list[int | None] = [None] * 16
    ranks: list[int | None] = [None] * 16
    for begin, symbol, cost, rank in column:
        costs[4 * begin + symbol], ranks[4 * begin + symbol] = cost + total, rank
    return costs, ranks


def join_stretches(stretches: list[tuple[list[int | None], list[int | None]]]) -> list[tuple[int, int]]:
    """The symbols that each stretch begins and ends with on the cheapest way through all."""
    column: Column = ((NOTHING, NOTHING, 0, 0),)
    chart = []
    for costs, ranks in stretches:
        best: dict = {}
        for _, symbol, cost, rank in column:
            for after in range(4):
                if costs[4 * symbol + after] is not None:
                    found = (cost + costs[4 * symbol + after], rank, ranks[4 * symbol + after], symbol)
                    if (NOTHING, after) not in best or found < best[NOTHING, after]:
                        best[NOTHING, after] = found
        column, _ = ordered(best)
        chart.append({item[1]: c[3] for item, c in best.items()})
    end = closing(column)[1]
    out = []
    for came in reversed(chart):
        out.append((came[end], end))
        end = came[end]
    return out[::-1]
