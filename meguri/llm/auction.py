"""The cheapest edits of a row of messages, by the auction algorithm for shortest paths.

Nodes are (messages read, state): state 0 nothing said yet, 1 after a system
message, 2 after a user's, 3 after an assistant's. Arcs are edits with integer
costs; all but insertions lead to the next message. Every node has a price, at first 0.
A path grows from its origin: where the price of its last node is below the least of
(cost of an arc + price of its end), the price is raised to that and the path is
contracted by the node; else the path is extended along such an arc. So prices never
exceed any arc's cost plus the price at its end, and are equal to it along the path:
once the path reaches the end they are distances there.

Every node is an origin, the last ones first and with the prices kept; a path may stop
at a node whose own path has reached the end. Arcs whose price is cost plus price at the end
are tight; these and only these make up cheapest paths, and are traced from the start by least initial.
"""

from __future__ import annotations

from functools import lru_cache

NEVER = 1 << 60  # the price of a node from which the end cannot be reached
STATES = 4
_ACCEPTED = (0, 3)
_AFTER_USER = {0: 2, 1: 2, 3: 2}
_SAID = {"s": {0: 1}, "u": _AFTER_USER, "a": {2: 3}}
_NEXT = {**_AFTER_USER, 2: 3}  # a user's message, or an assistant's after it
_REACHED = ({0, 1, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3})
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5


@lru_cache(maxsize=None)
def _edits(initial: str, fault: str) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """For each state (initial of the edit, cost, messages read, next state), by
    initial; there are sixteen kinds of message."""
    out = []
    for q in range(STATES):
        arcs = [("D", DELETE, 1, q), ("I", INSERT, 0, _NEXT[q])]
        if fault not in "bd":
            more = CUT if fault == "t" else 0
            if q in _SAID.get(initial, ()):
                arcs.append(("K", KEEP + more, 1, _SAID[initial][q]))
            arcs.append(("R", REROLE + more, 1, _NEXT[q]))
        out.append(tuple(arcs))
    return tuple(out)


def arcs(initials: str, faults: str, leave: tuple[int, ...] | None) -> list[tuple[tuple[str, int, int], ...]]:
    """(initial, cost, node) from each node; node ``4 n + q`` is state q after n
    messages, and the last node is the end. ``leave`` has the cost of leaving in each
    state; without it, the row ends here: messages may be added at its end, and the
    state must be an accepted one."""
    n = len(initials)
    end = STATES * (n + 1)
    out = []
    for i in range(n):
        for q, found in enumerate(_edits(initials[i], faults[i])):
            out.append(tuple((mark, cost, STATES * (i + step) + to) for mark, cost, step, to in found))
    for q in range(STATES):
        if leave is not None:
            out.append((("", leave[q], end),) if leave[q] < NEVER else ())
        else:
            out.append((*((("", 0, end),) if q in _ACCEPTED else ()), ("I", INSERT, STATES * n + _NEXT[q])))
    out.append(())
    return out


def prices(graph: list[tuple[tuple[str, int, int], ...]], leave: tuple[int, ...] | None) -> list[int]:
    """Distances to the end from every node, as prices of the auction."""
    end = len(graph) - 1
    price = [0] * len(graph)
    if leave is not None:  # states that lead to no state in which one may leave
        for q in range(STATES):
            if all(leave[to] >= NEVER for to in _REACHED[q]):
                price[q:end:STATES] = [NEVER] * (end // STATES)
    done = [p >= NEVER for p in price]
    done[end] = True
    for origin in range(end - 1, -1, -1):
        path = [origin]
        while not done[path[-1]]:
            here = path[-1]
            least, follows = NEVER, -1
            for _, cost, to in graph[here]:
                if cost + price[to] < least:
                    least, follows = cost + price[to], to
            if price[here] < least:
                price[here] = least
                if least >= NEVER:
                    done[here] = True
                if len(path) > 1:
                    path.pop()
            else:
                path.append(follows)
        if price[origin] < NEVER:
            for node in path:
                done[node] = True
    return price


def traced(graph: list[tuple[tuple[str, int, int], ...]], price: list[int], node: int) -> tuple[str, int]:
    """(initials, last node before the end) of the cheapest path from ``node`` whose
    initials come first in order. Equal initials lead to equal nodes, so the first tight arc will do."""
    end, marks = len(graph) - 1, []
    while True:
        mark, _, to = next(arc for arc in graph[node] if arc[1] + price[arc[2]] == price[node])
        if to == end:
            return "".join(marks), node
        marks.append(mark)
        node = to


@lru_cache(maxsize=20_000)
def through(initials: str, faults: str) -> tuple[int, ...]:
    """Least cost from each state before the messages to each state after them, row by row."""
    found = []
    for to in range(STATES):
        leave = tuple(0 if q == to else NEVER for q in range(STATES))
        found.append(prices(arcs(initials, faults, leave), leave)[:STATES])
    return tuple(min(found[to][q], NEVER) for q in range(STATES) for to in range(STATES))


@lru_cache(maxsize=20_000)
def solved(initials: str, faults: str, leave: tuple[int, ...] | None) -> tuple[tuple[int, ...], tuple[tuple[str, int] | None, ...]]:
    """(cost from each state, (initials of the edits, state after them) from each state; None where there is no way)."""
    graph = arcs(initials, faults, leave)
    price = prices(graph, leave)
    ways = [traced(graph, price, q) if price[q] < NEVER else None for q in range(STATES)]
    return tuple(price[:STATES]), tuple(w and (w[0], w[1] % STATES) for w in ways)


def roles(marks: str, initials: str, state: int) -> list[tuple[list[str], str, str]]:
    """For each message (roles put in before it, initial of its edit, role it
    gets when that is R) and at last what is put in after all of them."""
    out, put, i = [], [], 0
    for mark in marks:
        role = "assistant" if state == 2 else "user"
        if mark == "I":
            put.append(role)
            state = _NEXT[state]
            continue
        out.append((put, mark, role if mark == "R" else ""))
        put = []
        if mark != "D":
            state = _NEXT[state] if mark == "R" else _SAID[initials[i]][state]
        i += 1
    return [*out, (put, "", "")]
