"""LALR(1) tables out of grammar text, and a parser that follows every action of a conflict.

A grammar is a list of rules ``name: alternatives ;`` with quoted terminals,
upper-case token classes, ``( | )``, ``?``, ``*``, ``+`` and ``{x 's'}`` for
one or more ``x`` separated by ``s``. An alternative ending in ``!`` gives way
where another token could still be shifted. Optional parts are expanded, so no
rule is empty, which keeps tables free of needless conflicts.

Conflicts that remain are kept in the table. The parser then follows all
actions at once: stacks share their lower parts, and equal stacks are one, so
ambiguous stretches cost little and end as soon as the text decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import product

END = "$end"
_PART = re.compile(r"\s*(?:#[^\n]*\n\s*)*('[^']+'|[A-Za-z_][\w]*|[(){}|?*+;:!])")


class _Reader:
    """Grammar text to plain productions."""

    def __init__(self, text: str):
        self.parts, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 60]!r}")
            self.parts.append(m.group(1))
            at = m.end()
        self.at, self.rules, self.made = 0, [], {}
        while self.at < len(self.parts):
            name = self.take()
            assert self.take() == ":", name
            for rhs, weak in self.alternatives():
                self.rules.append((f"~{name}", rhs, weak))
            assert self.take() == ";", name

    def take(self) -> str:
        self.at += 1
        return self.parts[self.at - 1]

    def peek(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def alternatives(self) -> list[tuple[tuple[str, ...], bool]]:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = out + self.sequence()
        return out

    def sequence(self) -> list[tuple[tuple[str, ...], bool]]:
        parts: list[list[tuple[str, ...]]] = []
        weak = False
        while self.peek() not in ("|", ")", ";", "}", ""):
            if self.peek() == "!":
                self.take()
                weak = True
                continue
            parts.append(self.item())
        return [(tuple(s for p in choice for s in p), weak) for choice in product(*parts)]

    def item(self) -> list[tuple[str, ...]]:
        p = self.take()
        if p == "(":
            got = [rhs for rhs, _ in self.alternatives()]
            assert self.take() == ")"
        elif p == "{":
            inner = self.item()
            sep = self.item()
            assert self.take() == "}"
            got = [(self.fresh("sep", inner, sep),)]
        else:
            got = [(p.strip("'") if p[0] == "'" else p if p.isupper() else f"~{p}",)]  # rules and terminals may share a name
        while self.peek() in ("?", "*", "+"):
            op = self.take()
            if op != "?":
                got = [(self.fresh("many", got, [()]),)]
            if op != "+":
                got = [(), *got]
        return got

    def fresh(self, what: str, inner: list, sep: list) -> str:
        key = (what, tuple(inner), tuple(sep))
        if key not in self.made:
            name = self.made[key] = f"@{len(self.made)}"
            for x in inner:
                self.rules.append((name, x, False))
                for s in sep:
                    self.rules.append((name, (name, *s, *x), False))
        return self.made[key]


def build(text: str, start: str) -> tuple[list[dict], list[dict], list[tuple[str, int]]]:
    """Actions and gotos by state, and what each production reduces to.

    An action is a state to shift to (0 or more), ``~p`` to reduce production
    ``p``, or a tuple of such.
    """
    rules = list(dict.fromkeys((n, r, w) for n, r, w in _Reader(text).rules if r != (n,)))
    heads = {n for n, _, _ in rules}
    rules.insert(0, ("$start", (f"~{start}", END), False))
    by: dict[str, list[int]] = defaultdict(list)
    for i, (n, rhs, _) in enumerate(rules):
        assert rhs, f"empty rule {n}"
        by[n].append(i)
    for n, rhs, _ in rules:
        for s in rhs:
            if s[0] == "~" and len(s) > 1 and s not in heads:
                raise ValueError(f"{n} refers to {s}")

    def is_head(s: str) -> bool:
        return s in heads

    first_of: dict[str, set[int]] = {}

    def opened(head: str) -> set[int]:
        """The productions that a closure adds for a nonterminal."""
        if head not in first_of:
            out, todo = set(), [head]
            seen = {head}
            while todo:
                for p in by[todo.pop()]:
                    out.add(p)
                    s = rules[p][1][0]
                    if is_head(s) and s not in seen:
                        seen.add(s)
                        todo.append(s)
            first_of[head] = out
        return first_of[head]

    kernels: dict[frozenset, int] = {}
    states: list[frozenset] = []
    moves: list[dict[str, int]] = []

    def state(kernel: frozenset) -> int:
        if kernel not in kernels:
            kernels[kernel] = len(states)
            states.append(kernel)
            moves.append({})
        return kernels[kernel]

    state(frozenset([(0, 0)]))
    done = 0
    while done < len(states):
        nexts: dict[str, set] = defaultdict(set)
        heads_in = set()
        for p, d in states[done]:
            rhs = rules[p][1]
            if d < len(rhs):
                nexts[rhs[d]].add((p, d + 1))
                if is_head(rhs[d]):
                    heads_in.add(rhs[d])
        added = set()
        for h in heads_in:
            added |= opened(h)
        for p in added:
            nexts[rules[p][1][0]].add((p, 1))
        for s, kernel in nexts.items():
            moves[done][s] = state(frozenset(kernel))
        done += 1

    # lookaheads: what follows each nonterminal transition (no rule is empty)
    follow: dict[tuple[int, str], set[str]] = {}
    includes: dict[tuple[int, str], list[tuple[int, str]]] = defaultdict(list)
    lookback: dict[tuple[int, int], list[tuple[int, str]]] = defaultdict(list)
    for q, move in enumerate(moves):
        for s, to in move.items():
            if is_head(s):
                follow[q, s] = {t for t in moves[to] if not is_head(t)}
    for q, s in list(follow):
        for p in by[s]:
            at = q
            rhs = rules[p][1]
            for x in rhs[:-1]:
                at = moves[at][x]
            if is_head(rhs[-1]):
                includes[at, rhs[-1]].append((q, s))
            lookback[moves[at][rhs[-1]], p].append((q, s))
    order: dict[tuple[int, str], int] = {}
    low: dict[tuple[int, str], float] = {}
    for root in follow:  # Tarjan's components, without recursion
        if root in order:
            continue
        work, stack = [(root, iter(includes[root]))], [root]
        order[root] = low[root] = len(order) + 1
        while work:
            x, it = work[-1]
            for y in it:
                if y not in order:
                    order[y] = low[y] = len(order) + 1
                    stack.append(y)
                    work.append((y, iter(includes[y])))
                    break
                follow[x] |= follow[y]
                low[x] = min(low[x], low[y])
            else:
                work.pop()
                if low[x] == order[x]:
                    while True:
                        y = stack.pop()
                        low[y] = float("inf")
                        if y == x:
                            break
                        follow[y] = follow[x]
                if work:
                    parent = work[-1][0]
                    follow[parent] |= follow[x]
                    low[parent] = min(low[parent], low[x])

    actions: list[dict] = []
    gotos: list[dict] = []
    for q, kernel in enumerate(states):
        act: dict[str, list[int]] = defaultdict(list)
        for s, to in moves[q].items():
            if not is_head(s):
                act[s].append(to)
        for p, d in kernel:
            if d == len(rules[p][1]) and p:
                for t in set().union(*(follow[x] for x in lookback[q, p])):
                    if rules[p][2] and t in moves[q]:
                        continue
                    act[t].append(~p)
        actions.append({t: a[0] if len(a) == 1 else tuple(sorted(a, reverse=True)) for t, a in act.items()})
        gotos.append({s: to for s, to in moves[q].items() if is_head(s)})
    return actions, gotos, [(n, len(rhs)) for n, rhs, _ in rules]


class Parser:
    """Tables, and the run over a list of tokens.

    A stack is a node ``(state, nodes below)``. All stacks with the same state
    on top are one node, so there are never more tops than states, however
    many readings a text has.
    """

    def __init__(self, tables, insert: str | None = None):
        self.actions, self.gotos, self.rules = tables
        #: A token that may be inserted before a token that does not fit, if that one stands on a new line, is a closing brace or the end.
        self.insert = insert
        #: Where chains of rules with one symbol end, by the states they begin with and the token; bounded by the tables.
        self.units: dict[tuple[int, int, str], int] = {}

    def step(self, tops: list[tuple], kinds) -> list[tuple]:
        """The stacks after reading a token of any of ``kinds``; none if it does not fit."""
        if len(tops) == 1 and type(kinds) is str:
            actions, gotos, rules = self.actions, self.gotos, self.rules
            node = tops[0]
            while True:
                a = actions[node[0]].get(kinds)
                if a is None:
                    return []
                if type(a) is tuple:
                    break
                if a >= 0:
                    return [(a, [node])]
                head, n = rules[~a]
                base = node
                for _ in range(n):
                    below = base[1]
                    if len(below) > 1:
                        break
                    base = below[0]
                else:
                    node = (gotos[base[0]][head], [base])
                    continue
                break
            tops = [node]
        return self.branch(tops, (kinds,) if type(kinds) is str else kinds)

    def branch(self, tops: list[tuple], kinds: tuple[str, ...]) -> list[tuple]:
        actions, gotos, rules = self.actions, self.gotos, self.rules
        level = {t[0]: t for t in tops}
        work, after = list(tops), {}
        while work:
            node = work.pop()
            act = actions[node[0]]
            for k in kinds:
                a = act.get(k)
                for x in () if a is None else a if type(a) is tuple else (a,):
                    if x >= 0:
                        below = after.setdefault(x, (x, []))[1]
                        if not any(b is node for b in below):
                            below.append(node)
                        continue
                    head, n = rules[~x]
                    bases = {id(node): node}
                    for _ in range(n):
                        bases = {id(b): b for t in bases.values() for b in t[1]}
                    for base in bases.values():
                        to = gotos[base[0]][head]
                        old = level.get(to)
                        if old is None:
                            level[to] = new = (to, [base])
                            work.append(new)
                        elif not any(b is base for b in old[1]):
                            old[1].append(base)  # a new way down: what was reduced above it may reach further
                            work.extend(t for t in level.values() if not any(t is w for w in work))
        return list(after.values())

    def run(self, tokens: list[tuple]) -> int:
        """The index of the first token that does not fit; -1 if all do. A token is ``(kinds, line, after a line break)``, the end included."""
        actions, gotos, rules, units = self.actions, self.gotos, self.rules, self.units
        tops: list[tuple] = [(0, [])]
        for i, (kinds, _, fresh) in enumerate(tokens):
            # one stack and one kind: reductions until the token can be shifted, as step does
            if len(tops) == 1 and type(kinds) is str:
                state, below = tops[0]
                while True:
                    a = actions[state].get(kinds)
                    if type(a) is not int:
                        break
                    if a >= 0:
                        tops = [(a, [(state, below)])]
                        break
                    head, n = rules[~a]
                    if n == 1:
                        if len(below) > 1:
                            break
                        # a chain of rules with one symbol each ends in the same state whenever it begins alike
                        key = (below[0][0], state, kinds)
                        to = units.get(key)
                        if to is None:
                            to = units[key] = self._chain(*key)
                        state = to
                        continue
                    base = (state, below)
                    for _ in range(n):
                        below = base[1]
                        if len(below) > 1:
                            break
                        base = below[0]
                    else:
                        state, below = gotos[base[0]][head], [base]
                        continue
                    break  # the way down forks: the stacks as they were are looked at together
                if type(a) is int and a >= 0:
                    continue
            after = self.step(tops, kinds)
            if not after and self.insert and (fresh or kinds == "}" or kinds == END):
                put = self.step(tops, self.insert)
                after = self.step(put, kinds) if put else []
            if not after:
                return i
            tops = after
        return -1

    def _chain(self, base: int, state: int, kind: str) -> int:
        """Where rules of one symbol lead from ``state`` above ``base`` before ``kind``."""
        while True:
            a = self.actions[state].get(kind)
            if type(a) is not int or a >= 0 or self.rules[~a][1] != 1:
                return state
            state = self.gotos[base][self.rules[~a][0]]
