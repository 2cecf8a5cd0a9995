"""Regular expressions to one minimal deterministic automaton in transition arrays.

Supported syntax: literals, escapes (\\n, \\t, \\xHH, \\. and the like), classes with ranges and negation,
groups, |, ?, *, +, {m}, {m,}, {m,n}. Patterns are over bytes.
"""

from __future__ import annotations

import numpy as np


class _Parser:
    """Pattern to a syntax tree: ("set", frozenset), ("cat", ..), ("alt", ..), ("rep", x, low, high)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return tree

    def peek(self):
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self):
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("cat", *items)

    def repeated(self):
        x = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                bounds = (int(low), int(low) if "," not in self.p[self.i : end] else int(high) if high else None)
                self.i = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            x = ("rep", x, *bounds)
        return x

    def code(self):
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def members(self, codes):
        codes = set(codes)
        if self.fold:
            codes |= {ord(chr(c).swapcase()) for c in codes if c < 128 and chr(c).isalpha()}
        return ("set", frozenset(codes))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            if self.p.startswith("?:", self.i):
                self.i += 2
            x = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.take()
            return x
        if c == "[":
            self.take()
            negated = self.peek() == "^"
            if negated:
                self.take()
            codes: set[int] = set()
            while self.peek() != "]":
                a = self.code()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    codes |= set(range(a, self.code() + 1))
                else:
                    codes.add(a)
            self.take()
            kind, found = self.members(codes)
            return (kind, frozenset(range(256)) - found if negated else found)
        return self.members([self.code()])


def _backwards(tree):
    """The tree of the same strings read from their ends."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _backwards(tree[1]), *tree[2:])
    parts = [_backwards(x) for x in tree[1:]]
    return (kind, *(reversed(parts) if kind == "cat" else parts))


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def node(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def build(self, tree, a: int) -> int:
        """Adds the tree behind node a and returns where it ends."""
        kind = tree[0]
        if kind == "set":
            b = self.node()
            self.moves[a].append((tree[1], b))
            return b
        if kind == "cat":
            for x in tree[1:]:
                a = self.build(x, a)
            return a
        if kind == "alt":
            b = self.node()
            for x in tree[1:]:
                start = self.node()
                self.eps[a].append(start)
                self.eps[self.build(x, start)].append(b)
            return b
        _, x, low, high = tree
        for _ in range(low):
            a = self.build(x, a)
        if high is None:
            loop, out = self.node(), self.node()
            self.eps[a] += [loop, out]
            end = self.build(x, loop)
            self.eps[end] += [loop, out]
            return out
        out = self.node()
        self.eps[a].append(out)
        for _ in range(high - low):
            a = self.build(x, a)
            self.eps[a].append(out)
        return out


class Dfa:
    """trans[state * n_classes + classes[byte]]; state 0 is the start; accepting states are first_accept and above.

    mask[state] tells the patterns that end there, alive[state] those that still can, there or later. Without an anchor a
    match may begin at any byte; backwards, texts have to be read from their ends.
    """

    def __init__(self, patterns: list[tuple[str, bool]], anchored: bool, backwards: bool = False):
        nfa = _Nfa()
        root = nfa.node()
        final: dict[int, int] = {}
        for k, (pattern, fold) in enumerate(patterns):
            start = nfa.node()
            nfa.eps[root].append(start)
            tree = _Parser(pattern, fold).parse()
            end = nfa.build(_backwards(tree) if backwards else tree, start)
            final[end] = final.get(end, 0) | 1 << k
        self._subsets(nfa, root, final, anchored)
        self._minimise()

    def _subsets(self, nfa: _Nfa, root: int, final: dict[int, int], anchored: bool) -> None:
        sets = list({s for m in nfa.moves for s, _ in m})
        rows: dict[tuple, int] = {}
        self.classes = np.array([rows.setdefault(tuple(b in s for s in sets), len(rows)) for b in range(256)], np.uint8)
        n = len(rows)
        classes_of = {s: sorted({int(self.classes[b]) for b in s}) for s in sets}

        closures: dict[int, frozenset] = {}

        def closure(v: int) -> frozenset:
            if v not in closures:
                seen, todo = {v}, [v]
                while todo:
                    for w in nfa.eps[todo.pop()]:
                        if w not in seen:
                            seen.add(w)
                            todo.append(w)
                closures[v] = frozenset(x for x in seen if nfa.moves[x] or x in final)
            return closures[v]

        first = closure(root)
        ids, order, table = {first: 0}, [first], []
        for now in order:
            targets: list[set] = [set() if anchored else set(first) for _ in range(n)]
            for v in now:
                for s, w in nfa.moves[v]:
                    for c in classes_of[s]:
                        targets[c] |= closure(w)
            row = []
            for t in targets:
                key = frozenset(t)
                if key not in ids:
                    ids[key] = len(order)
                    order.append(key)
                row.append(ids[key])
            table.append(row)
        self.table = np.array(table, np.int64)
        self.mask = np.array([sum({final[v] for v in s if v in final}) for s in order], np.int64)
        self.dead = ids.get(frozenset(), -1)

    def _minimise(self) -> None:
        """Moore's refinement: states stay together while their marks and the groups they lead to agree."""
        group = np.unique(self.mask, return_inverse=True)[1]
        while True:
            fresh = np.unique(np.column_stack([group, group[self.table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if fresh.max() == group.max():
                break
            group = fresh
        count = group.max() + 1
        chosen = np.full(count, -1)
        chosen[group[::-1]] = np.arange(len(group))[::-1]
        accepting = self.mask[chosen] > 0
        order = np.lexsort((np.arange(count), accepting, np.arange(count) != group[0]))
        number = np.empty(count, np.int64)
        number[order] = np.arange(count)
        self.table = number[group[self.table[chosen[order]]]].astype(np.int32)
        self.mask = self.mask[chosen[order]]
        self.first_accept = int(np.argmax(self.mask > 0)) if (self.mask > 0).any() else count
        self.dead = int(number[group[self.dead]]) if self.dead >= 0 else -1
        self.n_states, self.n_classes = self.table.shape
        self.trans = np.ascontiguousarray(self.table.reshape(-1))
        self.alive = self.mask.copy()
        while True:
            more = self.alive | np.bitwise_or.reduce(self.alive[self.table], axis=1)
            if (more == self.alive).all():
                break
            self.alive = more
        self.reset = (self.table == 0).all(axis=0)[self.classes]
        del self.table

    def events(self, buf: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """One pass over the bytes: (positions just behind which a rule may end, mask of those rules).

        The bytes are cut behind reset bytes, which lead every state to the start, into lanes of about
        the given length; all lanes step together, and the last few long ones byte by byte.
        """
        n = len(buf)
        cuts = np.flatnonzero(self.reset[buf]) + 1
        if len(cuts):
            cuts = cuts[np.unique(np.minimum(np.searchsorted(cuts, np.arange(lane, n, lane)), len(cuts) - 1))]
        start = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([start, [n]]))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        codes = self.classes[buf].astype(np.int32)
        state = np.zeros(len(start), np.int32)
        at, what = [], []
        for t, k in enumerate(active):
            if k <= 4 and len(active) - t > 64:
                for lane_start, lane_size, s in zip(start[:k].tolist(), size[:k].tolist(), state[:k].tolist(), strict=True):
                    found = self._step(codes[lane_start + t : lane_start + lane_size].tolist(), s)
                    at.append(np.array([lane_start + t + j for j, _ in found], np.int64))
                    what.append(np.array([m for _, m in found], np.int64))
                break
            s = self.trans[state[:k] * self.n_classes + codes[start[:k] + t]]
            state[:k] = s
            hit = np.flatnonzero(s >= self.first_accept)
            if len(hit):
                at.append(start[hit] + t + 1)
                what.append(self.mask[s[hit]])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(what)

    def _step(self, codes: list[int], s: int) -> list[tuple[int, int]]:
        trans, n, mask = self._lists()[:3]
        first, out = self.first_accept, []
        for j, c in enumerate(codes, 1):
            s = trans[s * n + c]
            if s >= first:
                out.append((j, mask[s]))
        return out

    def longest(self, data: bytes, begin: int, wanted: int) -> dict[int, tuple[int, int]]:
        """From begin on, for every wanted pattern that matches there: (end of its longest match, mask of the state there)."""
        trans, n, mask, alive, classes = self._lists()
        s, out, patterns = 0, {}, [k for k in range(wanted.bit_length()) if wanted >> k & 1]
        for j in range(begin, len(data)):
            s = trans[s * n + classes[data[j]]]
            if not alive[s] & wanted:
                break
            if s >= self.first_accept:
                m = mask[s]
                for k in patterns:
                    if m >> k & 1:
                        out[k] = (j + 1, m)
        return out

    def _lists(self):
        if "_l" not in self.__dict__:
            self._l = (self.trans.tolist(), self.n_classes, self.mask.tolist(), self.alive.tolist(), self.classes.tolist())
        return self._l
