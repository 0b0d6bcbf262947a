"""Regular expressions over bytes, compiled by subset construction and minimised to one transition array."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Nfa:
    """Thompson automaton: `eps[s]` are free moves, `moves[s]` pairs of a byte set and a target."""

    eps: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1


# A parsed expression is ("set", bytes), ("cat", parts), ("alt", parts) or ("rep", part, least, most or None).


class Parser:
    """Literals, classes, groups, alternation and the quantifiers ? * + {m} {m,} {m,n}; ASCII only."""

    def __init__(self, pattern: str, fold: bool = False):
        self.p, self.at, self.fold = pattern, 0, fold

    def parse(self):
        out = self.alt()
        if self.at != len(self.p):
            raise ValueError(f"unexpected {self.p[self.at]!r} at {self.at} in {self.p!r}")
        return out

    def peek(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.p.index("}", self.at)
                low, _, high = self.p[self.at : end].partition(",")
                exact = "," not in self.p[self.at : end]
                self.at = end + 1
                node = ("rep", node, int(low), int(low) if exact else int(high) if high else None)
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            node = self.alt()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.at += 1
            return node
        if c == "[":
            return self.char_class()
        if c == "\\":
            c = self.escape()
        return ("set", self.folded({ord(c)}))

    def escape(self) -> str:
        c = self.p[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return chr(int(self.p[self.at - 2 : self.at], 16))
        return c

    def char_class(self):
        found: set[int] = set()
        while self.peek() != "]":
            c = self.p[self.at]
            self.at += 1
            if c == "\\":
                c = self.escape()
            if self.peek() == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                high = self.p[self.at]
                self.at += 1
                found |= set(range(ord(c), ord(high if high != "\\" else self.escape()) + 1))
            else:
                found.add(ord(c))
        self.at += 1
        return ("set", self.folded(found))

    def folded(self, found: set[int]) -> frozenset:
        if self.fold:
            found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return frozenset(found)


def backwards(node):
    """The expression that matches the reversed strings."""
    if node[0] == "cat":
        return ("cat", [backwards(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [backwards(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    return node


def build(nfa: Nfa, node, start: int) -> int:
    """Adds `node` after `start`; returns its last state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((node[1], end))
        return end
    if kind == "cat":
        for part in node[1]:
            start = build(nfa, part, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for part in node[1]:
            first = nfa.state()
            nfa.eps[start].append(first)
            nfa.eps[build(nfa, part, first)].append(end)
        return end
    _, part, least, most = node
    for _ in range(least):
        start = build(nfa, part, start)
    if most is None:
        loop, end = nfa.state(), nfa.state()
        nfa.eps[start] += [loop, end]
        nfa.eps[build(nfa, part, loop)] += [loop, end]
        return end
    end = nfa.state()
    for _ in range(most - least):
        nfa.eps[start].append(end)
        start = build(nfa, part, start)
    nfa.eps[start].append(end)
    return end


@dataclass
class Dfa:
    """`table[state * width + classes[byte]]` is the next state times width; `masks[state]` the rules accepted there.

    States are ordered so that those from `accept` on accept something. `start` is a state times width.
    """

    classes: bytes
    width: int
    table: list[int]
    masks: list[int]
    accept: int
    start: int


def compile_rules(nodes: list, anywhere: bool = True) -> Dfa:
    """One minimal automaton for all rules; bit i of a mask is rule i. `anywhere`: a match may begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    final = {}
    for i, node in enumerate(nodes):
        first = nfa.state()
        nfa.eps[root].append(first)
        final[build(nfa, node, first)] = 1 << i
    classes, width = byte_classes(nfa)
    sample = [classes.index(c) for c in range(width)]

    def closure(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.moves[x] or x in final)

    again = closure([root])
    step = [[[] for _ in range(width)] for _ in nfa.eps]
    for s, moves in enumerate(nfa.moves):
        for chars, to in moves:
            for c in range(width):
                if sample[c] in chars:
                    step[s][c].append(to)
    closed = {}
    ids, order, rows = {again: 0}, [again], []
    for now in order:
        row = []
        for c in range(width):
            key = frozenset(t for s in now for t in step[s][c])
            if key not in closed:
                closed[key] = closure(key) | again if anywhere else closure(key)
            to = closed[key]
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    masks = [sum(final[x] for x in now if x in final) for now in order]
    return minimised(rows, masks, classes, width)


def byte_classes(nfa: Nfa) -> tuple[bytes, int]:
    """Bytes that no rule tells apart share a class."""
    sets = list(dict.fromkeys(chars for moves in nfa.moves for chars, _ in moves))
    kinds: dict[tuple, int] = {}
    out = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    return out, len(kinds)


def minimised(rows: list[list[int]], masks: list[int], classes: bytes, width: int) -> Dfa:
    """Moore's partition refinement; blocks that accept come last."""
    block = {m: i for i, m in enumerate(sorted(set(masks)))}
    part = [block[m] for m in masks]
    count = len(block)
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((part[s], *[part[t] for t in row]), len(keys)) for s, row in enumerate(rows)]
        part = new
        if len(keys) == count:
            break
        count = len(keys)
    mask = {p: masks[s] for s, p in enumerate(part)}
    place = {p: i for i, p in enumerate(sorted(range(count), key=lambda p: (mask[p] != 0, p)))}
    table, by = [0] * (count * width), [0] * count
    for s, row in enumerate(rows):
        p = place[part[s]]
        by[p] = masks[s]
        table[p * width : (p + 1) * width] = [place[part[t]] * width for t in row]
    return Dfa(classes, width, table, by, sum(not m for m in by) * width, place[part[0]] * width)
