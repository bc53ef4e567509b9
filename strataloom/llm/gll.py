"""Generalised LL recognition with a graph-structured stack.

Grammars are given in EBNF; every nonterminal becomes a small automaton over tokens and nonterminals (recursive
transition network). Where the next token leaves one way, the recogniser just takes it; where it leaves several, each
becomes a descriptor, and all of them share one graph-structured stack, so each nonterminal is tried once a position
however many alternatives (or dialects) ask for it. Nothing recurses: nesting may be as deep as the text.

Notation: ``Name = a 'b' (c | d)? e* f+ ;``; quoted words are tokens, ``%class C = ID 'of' ;`` names a set of tokens,
``<ASI>`` is an empty step that the token's flag must allow. ``sep(x, ',')`` is ``x (',' x)*``.
"""

from __future__ import annotations

import re

SHIFT, CALL, POP, EMPTY = range(4)
END = "<END>"

_NOTATION = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:('[^']+')|(<ASI>)|(%class)|(sep)(?=\()|([A-Za-z_]\w*)|([=|;()?*+,]))")


def _read(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _NOTATION.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        out.append(m[0].split("\n")[-1].strip() if "#" in m[0] and not m[1] else (m[1] or m[0].strip()))
        at = m.end()
    return out


class Grammar:
    """A compiled grammar with one or more start symbols (dialects)."""

    def __init__(self, text: str, starts: tuple[str, ...], inline_limit: int = 40):
        self.starts = starts
        self.classes: dict[str, frozenset[str]] = {}
        self.rules: dict[str, tuple] = {}
        self._tokens, self._at = _read(text), 0
        while self._at < len(self._tokens):
            self._rule()
        self._check()
        self._inline(inline_limit)
        self._automata()
        self._sets()
        self._tables()

    # -- notation to trees: ("t", kinds), ("n", name), ("asi",), ("seq", ...), ("alt", ...), ("opt", x), ("many", x)

    def _next(self) -> str:
        self._at += 1
        return self._tokens[self._at - 1]

    def _peek(self) -> str:
        return self._tokens[self._at]

    def _rule(self) -> None:
        name = self._next()
        if name == "%class":
            name = self._next()
            assert self._next() == "="
            kinds: set[str] = set()
            while (t := self._next()) != ";":
                kinds |= {t[1:-1]} if t[0] == "'" else self.classes.get(t, {t})
            self.classes[name] = frozenset(kinds)
            return
        assert self._next() == "=", name
        assert name not in self.rules, name
        self.rules[name] = self._alt()
        assert self._next() == ";", name

    def _alt(self) -> tuple:
        ways = [self._seq()]
        while self._peek() == "|":
            self._next()
            ways.append(self._seq())
        return ways[0] if len(ways) == 1 else ("alt", *ways)

    def _seq(self) -> tuple:
        parts: list[tuple] = []
        while self._peek() not in ("|", ";", ")", ","):
            x = self._atom()
            while self._peek() in ("?", "*", "+"):
                op = self._next()
                x = ("opt", x) if op == "?" else ("many", x) if op == "*" else ("seq", x, ("many", x))
            parts.append(x)
        return parts[0] if len(parts) == 1 else ("seq", *parts)

    def _atom(self) -> tuple:
        t = self._next()
        if t == "(":
            x = self._alt()
            assert self._next() == ")"
            return x
        if t == "sep":
            assert self._next() == "("
            x = self._alt()
            assert self._next() == ","
            y = self._alt()
            assert self._next() == ")"
            return ("seq", x, ("many", ("seq", y, x)))
        if t[0] == "'":
            return ("t", frozenset((t[1:-1],)))
        if t == "<ASI>":
            return ("asi",)
        if t in self.classes:
            return ("t", self.classes[t])
        if t.isupper():
            return ("t", frozenset((t,)))
        return ("n", t)

    def _check(self) -> None:
        def walk(x: tuple) -> None:
            if x[0] == "n":
                assert x[1] in self.rules, f"no rule {x[1]}"
            elif x[0] not in ("t", "asi"):
                for y in x[1:]:
                    walk(y)

        for x in self.rules.values():
            walk(x)

    def _inline(self, limit: int) -> None:
        """Small rules that do not call themselves are put where they are called: fewer stack nodes."""

        def names(x: tuple) -> set[str]:
            return {x[1]} if x[0] == "n" else set() if x[0] in ("t", "asi") else set().union(*map(names, x[1:]), set())

        def size(x: tuple) -> int:
            return 1 if x[0] in ("t", "n", "asi") else 1 + sum(map(size, x[1:]))

        reach = {n: names(x) for n, x in self.rules.items()}
        grown = True
        while grown:
            grown = False
            for n, r in reach.items():
                more = set().union(r, *(reach[m] for m in r))
                if more != r:
                    reach[n], grown = more, True

        def put(x: tuple) -> tuple:
            if x[0] == "n" and x[1] not in reach[x[1]]:
                y = put(self.rules[x[1]])
                return y if size(y) <= limit else x
            return x if x[0] in ("t", "n", "asi") else (x[0], *map(put, x[1:]))

        self.rules = {n: put(x) for n, x in self.rules.items()}
        keep, todo = set(), list(self.starts)
        while todo:
            n = todo.pop()
            if n not in keep:
                keep.add(n)
                todo += names(self.rules[n])
        self.rules = {n: x for n, x in self.rules.items() if n in keep}

    # -- trees to deterministic automata

    def _automata(self) -> None:
        nullable: set[str] = set()

        def empty(x: tuple) -> bool:
            if x[0] == "n":
                return x[1] in nullable
            if x[0] == "t":
                return False
            if x[0] in ("opt", "many"):
                return True
            if x[0] == "asi":
                return False
            return (all if x[0] == "seq" else any)(map(empty, x[1:]))

        while more := {n for n, x in self.rules.items() if n not in nullable and empty(x)}:
            nullable |= more
        self.nullable = nullable
        self.edges: list[dict] = []  # of each state: label to state
        self.final: list[bool] = []
        self.owner: list[str] = []
        self.first_state: dict[str, int] = {}
        for name, tree in self.rules.items():
            eps: list[list[int]] = []
            out: list[list[tuple]] = []

            def new() -> int:
                eps.append([])
                out.append([])
                return len(eps) - 1

            def build(x: tuple, a: int, b: int) -> None:
                kind = x[0]
                if kind == "seq":
                    for y in x[1:]:
                        c = new()
                        build(y, a, c)
                        a = c
                    eps[a].append(b)
                elif kind == "alt":
                    for y in x[1:]:
                        build(y, a, b)
                elif kind == "opt":
                    eps[a].append(b)
                    build(x[1], a, b)
                elif kind == "many":
                    c, d = new(), new()
                    eps[a].append(c)
                    build(x[1], c, d)
                    eps[d].append(c)
                    eps[c].append(b)
                else:
                    out[a].append((x, b))
                    if kind == "n" and x[1] in nullable:
                        eps[a].append(b)

            s, e = new(), new()
            build(tree, s, e)

            def close(states: frozenset) -> frozenset:
                seen, todo = set(states), list(states)
                while todo:
                    for y in eps[todo.pop()]:
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
                return frozenset(seen)

            ids: dict[frozenset, int] = {}
            todo = [close(frozenset((s,)))]

            def number(c: frozenset) -> int:
                if c not in ids:
                    ids[c] = len(self.edges)
                    self.edges.append({})
                    self.final.append(e in c)
                    self.owner.append(name)
                    todo.append(c)
                return ids[c]

            self.first_state[name] = number(todo.pop())
            while todo:
                c = todo.pop()
                by: dict[tuple, set] = {}
                for q in c:
                    for label, to in out[q]:
                        by.setdefault(label, set()).add(to)
                for label, to in by.items():
                    self.edges[ids[c]][label] = number(close(frozenset(to)))

    def _sets(self) -> None:
        first: dict[str, set] = {n: set() for n in self.rules}

        def of_state(q: int, seen: set) -> set:
            got: set = set()
            if q in seen:
                return got
            seen.add(q)
            for label, to in self.edges[q].items():
                if label[0] == "t":
                    got |= label[1]
                elif label[0] == "n":
                    got |= first[label[1]]
                else:
                    got |= of_state(to, seen)
            return got

        grown = True
        while grown:
            grown = False
            for n in self.rules:
                f = of_state(self.first_state[n], set())
                if f != first[n]:
                    first[n], grown = f, True
        self.first = first
        follow: dict[str, set] = {n: set() for n in self.rules}
        for s in self.starts:
            follow[s].add(END)
        reach_end = [False] * len(self.edges)  # final, or final after empty steps
        grown = True
        while grown:
            grown = False
            for q, e in enumerate(self.edges):
                r = self.final[q] or any(l[0] == "asi" and reach_end[to] for l, to in e.items())
                if r != reach_end[q]:
                    reach_end[q], grown = r, True
        grown = True
        while grown:
            grown = False
            for q, e in enumerate(self.edges):
                for label, to in e.items():
                    if label[0] == "n":
                        f = follow[label[1]]
                        more = of_state(to, set()) | (follow[self.owner[q]] if reach_end[to] else set())
                        if not more <= f:
                            f |= more
                            grown = True
        self.follow = follow

    def _tables(self) -> None:
        rows: list[dict] = [{} for _ in self.edges]

        def row(q: int, seen: tuple = ()) -> dict:
            acts: dict[str, list] = {}
            for label, to in self.edges[q].items():
                if label[0] == "t":
                    for k in label[1]:
                        acts.setdefault(k, []).append((SHIFT, to))
                elif label[0] == "n":
                    for k in self.first[label[1]]:
                        acts.setdefault(k, []).append((CALL, self.first_state[label[1]], to))
                elif to not in seen:
                    for k in row(to, (*seen, q)):
                        acts.setdefault(k, []).append((EMPTY, to))
            if self.final[q]:
                for k in self.follow[self.owner[q]]:
                    acts.setdefault(k, []).append((POP,))
            return acts

        # steps refer to the rows they lead to, so that running needs no lookup by state
        def link(a: tuple) -> tuple:
            if a[0] == CALL:
                return (CALL, a[1], rows[a[1]], rows[a[2]])
            return a if a[0] == POP else (a[0], rows[a[1]])

        for q in range(len(self.edges)):
            for k, a in row(q).items():
                rows[q][k] = link(a[0]) if len(a) == 1 else [link(x) for x in a]
        self.rows = rows

    # -- recognition

    def accepts(self, kinds: list[str], may_end: list[bool] | None = None, starts: tuple[str, ...] | None = None) -> list[str]:
        """The dialects that accept the tokens (``kinds``, without an end mark), run together on one stack.

        ``may_end[i]`` allows an empty step (``<ASI>``) before token i.
        """
        starts = starts or self.starts
        rows, size = self.rows, len(self.rows)
        kinds = [*kinds, END]
        last = len(kinds) - 1
        # a stack node: [returns (row, node), positions where it ended], a root also its dialect
        nodes: dict[int, list] = {}
        work: list[tuple] = []
        for s in starts:
            work.append((rows[self.first_state[s]].get(kinds[0]), [[], [], s], 0))
        accepted: list[str] = []
        while work:
            act, node, pos = work.pop()
            while act is not None:
                if act.__class__ is list:
                    for a in act[1:]:
                        work.append((a, node, pos))
                    act = act[0]
                op = act[0]
                if op == 0:
                    pos += 1
                    act = act[1].get(kinds[pos])
                elif op == 1:
                    _, callee, row, ret = act
                    key = pos * size + callee
                    child = nodes.get(key)
                    if child is None:
                        nodes[key] = child = [[(ret, node)], []]
                        node = child
                        act = row.get(kinds[pos])
                    else:
                        for r, p in child[0]:
                            if r is ret and p is node:
                                break
                        else:
                            child[0].append((ret, node))
                            for at in child[1]:
                                work.append((ret.get(kinds[at]), node, at))
                        break
                elif op == 2:
                    if pos in node[1]:
                        break
                    node[1].append(pos)
                    if len(node) == 3:
                        if pos == last:
                            accepted.append(node[2])
                        break
                    back = node[0]
                    kind = kinds[pos]
                    if len(back) > 1:
                        for r, p in back[1:]:
                            work.append((r.get(kind), p, pos))
                    row, node = back[0]
                    act = row.get(kind)
                elif may_end is not None and may_end[pos]:
                    act = act[1].get(kinds[pos])
                else:
                    break
        return accepted
