"""Distances and scripts of many pairs together: what one pair needs cell by cell is done for a group of pairs in numpy.

A group's pairs are of like sizes; arrays have the pairs last, so that each step is one pass over contiguous memory.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from ..plans.trees import parents

say = json.JSONEncoder(ensure_ascii=False).encode

#: Cells of a group's tables, and pairs in a group, at most (one pair may have more cells).
CELLS, PAIRS = 1 << 20, 512


class Side:
    """The trees of a column: first node, nodes, and the nodes' labels, values and depths one after the other."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        flat = column.flatten()
        self.labels, self.values = flat.field("label"), flat.field("value")
        depth = flat.field("depth")
        sound = np.asarray(flat.is_valid()) & np.asarray(depth.is_valid())
        self.depths = depth.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # Rows that only the plain functions can judge: no array, or a node that is no node or has no depth.
        gap = np.concatenate([[0], np.cumsum((~sound).astype(np.int64))])
        self.odd = (gap[self.first + self.size] > gap[self.first]) | ~np.asarray(column.is_valid())

    def padded(self, flat: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
        """(width, pairs): the values of the group's trees from the top; what is below a tree's end means nothing."""
        if not len(flat):
            return np.zeros((width, len(group)), flat.dtype)
        at = self.first[group] + np.arange(width)[:, None]
        return flat[np.minimum(at, len(flat) - 1)]


def coded(a: Side, b: Side, root: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each node of both sides, equal for equal labels and values. root: the label that all first nodes take."""
    labels, values = (pa.chunked_array([x, y]).combine_chunks() for x, y in ((a.labels, b.labels), (a.values, b.values)))
    labels, values = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (labels, values))
    names, texts = labels.dictionary_encode(), values.dictionary_encode()
    number = lambda x: x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    label, value = number(names), number(texts)
    if root is not None:
        place = names.dictionary.index(root).as_py()
        place = len(names.dictionary) if place < 0 else place
        for side, shift in ((a, 0), (b, len(a.depths))):
            label[side.first[side.size > 0] + shift] = place
    key = (label + 1) * (len(texts.dictionary) + 2) + value + 1
    return key[: len(a.depths)], key[len(a.depths) :]


def groups(m: np.ndarray, n: np.ndarray, cells: int = CELLS, most: int = PAIRS):
    """Places of pairs of like sizes."""
    order = np.lexsort((n, m // 12))
    sizes = list(zip(m[order].tolist(), n[order].tolist()))
    at = 0
    while at < len(order):
        rows, cols, end = 0, 0, at
        while end < len(order) and end - at < most:
            more = max(rows, sizes[end][0] + 1), max(cols, sizes[end][1] + 1)
            if end > at and more[0] * more[1] * (end - at + 1) > cells:
                break
            (rows, cols), end = more, end + 1
        yield order[at:end]
        at = end


def alignment(ka, da, m, kb, db, n, moves: bool = False):
    """Alignment distances of a group: a row of all its tables at a time. With moves also (rows, columns, pairs): how each cell
    is reached: 0 from up-left, 1 from above, 2 from the left.

    A row's steps to the right cost 1 where they are allowed, so a row is the running minimum of what comes from above,
    less the place, between places where no step is allowed. Each stretch begins anew: its values are lowered by a step of their own.
    """
    rows, cols = len(ka), len(kb)
    kind, inf = (np.int32, 1 << 20) if cols < 400 and rows < 1 << 18 else (np.int64, 1 << 40)
    place = np.arange(cols + 1, dtype=kind)[:, None]
    row = np.broadcast_to(place, (cols + 1, len(m))).copy()
    end = np.arange(1, cols + 1)[:, None] == n
    found = n.copy()
    ways = np.full((rows + 1, cols + 1, len(m)), 2, np.int8) if moves else None
    best = np.empty((cols + 1, len(m)), kind)
    step = np.zeros((cols + 1, len(m)), kind)
    for i in range(1, rows + 1):
        d = da[i - 1]
        up = db <= d
        down = np.where(up | end, row[1:] + 1, inf)
        side = np.where(db == d, row[:-1] + (kb != ka[i - 1]), inf)
        best[0] = i
        np.minimum(down, side, out=best[1:])
        np.cumsum((db < d) & (m != i), axis=0, out=step[1:])
        lift = step * kind(2 * inf) - place
        row = np.minimum.accumulate(best + (-place - step * kind(2 * inf)), axis=0)
        row += lift + 2 * place
        done = m == i
        if done.any():
            found[done] = row[n[done], done.nonzero()[0]]
        if moves:
            w = ways[i]
            w[0] = 1
            w[1:][down == row[1:]] = 1
            w[1:][side == row[1:]] = 0
    return found, ways


def alignment_distances(a: Side, b: Side, root: str | None = None) -> np.ndarray:
    ka, kb = coded(a, b, root)
    out = np.zeros(len(a.size), np.int64)
    for g in groups(a.size, b.size):
        m, n = a.size[g], b.size[g]
        rows, cols = int(m.max()), int(n.max())
        out[g] = alignment(a.padded(ka, g, rows), a.padded(a.depths, g, rows), m, b.padded(kb, g, cols), b.padded(b.depths, g, cols), n)[0]
    return out


def alignment_scripts(a: Side, b: Side) -> list[tuple[int, str]]:
    """Length and JSON of each pair's positional script, as ted.chawathe_script() gives it."""
    ka, kb = coded(a, b)
    texts = []
    for s in (a, b):
        known: dict[tuple, str] = {}
        text = []
        for key in zip(s.labels.to_pylist(), s.values.to_pylist(), s.depths.tolist()):
            if key not in known:
                known[key] = '{"label": %s, "value": %s, "depth": %d}' % (say(key[0]), say(key[1]), key[2])
            text.append(known[key])
        texts.append(text)
    old, new = texts
    out: list = [None] * len(a.size)
    for g in groups(a.size, b.size):
        m, n = a.size[g], b.size[g]
        rows, cols = int(m.max()), int(n.max())
        pa_, pb = a.padded(ka, g, rows), b.padded(kb, g, cols)
        _, ways = alignment(pa_, a.padded(a.depths, g, rows), m, pb, b.padded(b.depths, g, cols), n, moves=True)
        ways[0, 0] = 3
        i, j, k = m.copy(), n.copy(), np.arange(len(g))
        steps = []
        while True:
            way = ways[i, j, k]
            if (way == 3).all():
                break
            steps.append((way, i - 1, j - 1))
            i, j = i - (way < 2), j - ((way == 0) | (way == 2))
        if not steps:
            for p in g:
                out[p] = (0, "[]")
            continue
        way, i, j = (np.array(x[::-1]) for x in zip(*steps))
        kept = ((way == 0) | (way == 2)).astype(np.int64)
        cursor = np.cumsum(kept, axis=0) - kept
        changed = (way == 1) | (way == 2)
        if rows and cols:
            changed |= (way == 0) & (pa_[np.maximum(i, 0), k] != pb[np.maximum(j, 0), k])
        said = changed.T
        pair, at = said.nonzero()
        flat_a, flat_b = (a.first[g][pair] + i[at, pair]).tolist(), (b.first[g][pair] + j[at, pair]).tolist()
        parts = []
        for w, c, x, y in zip(way[at, pair].tolist(), cursor[at, pair].tolist(), flat_a, flat_b):
            if w == 0:
                parts.append('{"op": "update", "position": %d, "old": %s, "new": %s}' % (c, old[x], new[y]))
            elif w == 1:
                parts.append('{"op": "delete", "position": %d, "old": %s, "new": null}' % (c, old[x]))
            else:
                parts.append('{"op": "insert", "position": %d, "old": null, "new": %s}' % (c, new[y]))
        end = np.cumsum(said.sum(axis=1)).tolist()
        for p, x, y in zip(g.tolist(), [0, *end], end):
            out[p] = (y - x, "[" + ", ".join(parts[x:y]) + "]")
    return out


class Shapes:
    """Numbers of subtree shapes: equal subtrees have equal numbers; null and empty values are equal."""

    def __init__(self):
        self.names: dict[tuple, int] = {}
        self.numbers: dict[tuple, int] = {}
        # of each shape: name, shapes of the children, nodes, whether no child has children
        self.name: list[int] = []
        self.kids: list[tuple] = []
        self.size: list[int] = []
        self.flat: list[bool] = []

    def __len__(self):
        return len(self.numbers)

    def of(self, labels, values, up) -> tuple[list[int], list[list[int]]]:
        """The shape and the children of each node."""
        n, numbers = len(labels), self.numbers
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            kids[up[i]].append(i)
        own = [0] * n
        for i in range(n - 1, -1, -1):
            below = tuple([own[c] for c in kids[i]])
            key = (labels[i], values[i] or "", below)
            k = numbers.get(key)
            if k is None:
                k = numbers[key] = len(self.name)
                self.name.append(self.names.setdefault(key[:2], len(self.names)))
                self.kids.append(below)
                self.size.append(1 + sum([self.size[c] for c in below]))
                self.flat.append(not any([self.kids[c] for c in below]))
            own[i] = k
        return own, kids


class SubtreeEdits:
    """Distance and script with whole-subtree operations, as ted.nj() gives them, with what shapes have in common worked out once.

    A leaf costs 1 whether it is contained or not, so pairs of shapes without grandchildren are the same in every pair of trees.
    """

    def __init__(self, most: int = 50_000):
        self.most = most
        self._anew()

    def _anew(self):
        self.shapes, self.fits, self.known = Shapes(), {}, {}

    def _inside(self, x: int, y: int) -> bool:
        """Whether shape x fits into shape y from their roots: matched children are a subsequence, at every level."""
        if x == y:
            return True
        found = self.fits.get((x, y))
        if found is None:
            s = self.shapes
            found = s.name[x] == s.name[y] and s.size[x] <= s.size[y]
            if found and s.kids[x]:
                left = iter(s.kids[y])
                found = all(any(self._inside(k, r) for r in left) for k in s.kids[x])
            self.fits[x, y] = found
        return found

    def _costs(self, own: list[int], other: list[int]) -> dict[int, int]:
        s, by_name, out = self.shapes, {}, {}
        for k in set(other):
            if s.kids[k]:
                by_name.setdefault(s.name[k], []).append(k)
        for k in set(own):
            out[k] = 1 if not s.kids[k] or any([self._inside(k, y) for y in by_name.get(s.name[k], ())]) else s.size[k]
        return out

    def __call__(self, a, b, script: bool = True) -> tuple[int, str | None]:
        if len(self.shapes) > self.most or len(self.known) + len(self.fits) > 4 * self.most:
            self._anew()
        if not a[0] or not b[0]:
            raise ValueError("empty tree")
        s, known, solved = self.shapes, self.known, {}
        (own_a, kids_a), (own_b, kids_b) = (s.of(x[0], x[1], parents(x[2])) for x in (a, b))
        gone, come = self._costs(own_a, own_b), self._costs(own_b, own_a)

        def solve(x: int, y: int) -> list[list[int]]:
            """The table of the children of two different shapes; its last cell is the distance."""
            left, right = s.kids[x], s.kids[y]
            row = [int(s.name[x] != s.name[y])]
            for e in right:
                row.append(row[-1] + come[e])
            table = [row]
            for c in left:
                cost, above, row = gone[c], row, [row[0] + gone[c]]
                last = row[0]
                for j, e in enumerate(right):
                    best = above[j] + (0 if c == e else distance(c, e))
                    if (way := above[j + 1] + cost) < best:
                        best = way
                    if (way := last + come[e]) < best:
                        best = way
                    row.append(best)
                    last = best
                table.append(row)
            return table

        def distance(x: int, y: int) -> int:
            return table_of(x, y)[-1][-1]

        def table_of(x: int, y: int) -> list[list[int]]:
            held = known if s.flat[x] and s.flat[y] else solved
            table = held.get((x, y))
            if table is None:
                table = held[x, y] = solve(x, y)
            return table

        total = 0 if own_a[0] == own_b[0] else distance(own_a[0], own_b[0])
        if not script:
            return total, None
        ops: list[str] = []

        def subtree(x, k: int, kids, size: int) -> str:
            out, todo = [], [(k, 0)]
            while todo:
                i, d = todo.pop()
                out.append('{"label": %s, "value": %s, "depth": %d}' % (say(x[0][i]), say(x[1][i]), d))
                todo.extend([(c, d + 1) for c in reversed(kids[i])])
            return "[" + ", ".join(out) + "]"

        def explain(p: int, q: int):
            x, y = own_a[p], own_b[q]
            if x == y:
                return
            d = table_of(x, y)
            if d[0][0]:
                ops.append('{"op": "update", "ref": "s%d", "position": null, "old": [%s, %s], "new": [%s, %s], "subtree": null, "count": 1, "note": "Upd(R(s%d), t%d)"}' % (p, say(a[0][p]), say(a[1][p]), say(b[0][q]), say(b[1][q]), p, q))
            left, right = s.kids[x], s.kids[y]
            i, j, steps = len(left), len(right), []
            while i or j:
                if i and j and d[i][j] == d[i - 1][j - 1] + (0 if left[i - 1] == right[j - 1] else distance(left[i - 1], right[j - 1])):
                    i, j = i - 1, j - 1
                    if left[i] != right[j]:
                        steps.append((0, i, j))
                elif i and d[i][j] == d[i - 1][j] + gone[left[i - 1]]:
                    i -= 1
                    steps.append((1, i, j))
                else:
                    j -= 1
                    steps.append((2, i, j))
            for kind, i, j in reversed(steps):
                if kind == 0:
                    explain(kids_a[p][i], kids_b[q][j])
                elif kind == 1:
                    c = kids_a[p][i]
                    ops.append('{"op": "delete_tree", "ref": "s%d", "position": %d, "old": null, "new": null, "subtree": %s, "count": %d, "note": "DelTree(s%d)"}' % (c, i + 1, subtree(a, c, kids_a, s.size[own_a[c]]), s.size[own_a[c]], c))
                else:
                    c = kids_b[q][j]
                    ops.append('{"op": "insert_tree", "ref": "s%d", "position": %d, "old": null, "new": null, "subtree": %s, "count": %d, "note": "InsTree(t%d, s%d, %d)"}' % (p, j + 1, subtree(b, c, kids_b, s.size[own_b[c]]), s.size[own_b[c]], c, p, j + 1))

        explain(0, 0)
        return total, "[" + ", ".join(ops) + "]"


class Postorders:
    """The label-sorted trees of one side in postorder, one after the other, with what keyroots need."""

    def __init__(self, trees, names: dict, shapes: dict):
        self.size, names_, low, up_to, whole, self.keyroots, self.errors = [], [], [], [], [], [], []
        for labels, values, depths in trees:
            try:
                if not labels:
                    raise ValueError("empty tree")
                found = self._one(labels, values, parents(depths), names, shapes)
                self.errors.append(None)
            except (ValueError, IndexError, TypeError) as e:
                found = ([], [], [], [], [])
                self.errors.append(e)
            for x, y in zip((names_, low, up_to, whole), found):
                x += y
            self.size.append(len(found[0]))
            self.keyroots.append(found[4])
        self.size = np.array(self.size, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.names, self.low, self.nodes, self.whole = (np.array(x, np.int64) for x in (names_, low, up_to, whole))

    @staticmethod
    def _one(labels, values, up, names, shapes):
        n = len(labels)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            kids[up[i]].append(i)
        order, todo = [], [0]
        while todo:
            i = todo.pop()
            order.append(i)
            if kids[i]:
                kids[i].sort(key=labels.__getitem__)
                todo.extend(kids[i])
        order.reverse()
        own, low, height, name, whole, size = [0] * n, [0] * n, [0] * n, [], [], []
        keyroot: dict[int, int] = {}
        for k, i in enumerate(order):
            c = names.setdefault((labels[i], values[i]), len(names))
            name.append(c)
            below = kids[i]
            low[i] = low[below[0]] if below else k
            height[i] = 1 + max([height[x] for x in below]) if below else 0
            own[i] = shapes.setdefault((c, *[own[x] for x in below]), len(shapes))
            whole.append(own[i])
            size.append(k - low[i] + 1)
            keyroot[low[i]] = k
        lows = [low[i] for i in order]
        return name, lows, size, whole, [(k, height[order[k]]) for k in sorted(keyroot.values()) if size[k] > 1]

    padded = Side.padded


class Mappings:
    """Unit-cost distances of the label-sorted trees, and the mappings that ted.zhang_shasha() gives.

    A tree against a leaf costs its nodes, less one if a node of it is like the leaf. Forests of keyroots are solved for all pairs
    of a group together, from the lowest keyroots up; pairs of subtrees of the same shapes are solved once.
    """

    def __init__(self, most: int = 50_000):
        self.most, self.names, self.shapes = most, {}, {}

    def __call__(self, a, b, scripts: bool = False) -> list[tuple]:
        """(distance, JSON of the mapped postorder numbers or None), or what failed."""
        if len(self.shapes) > self.most:
            self.names, self.shapes = {}, {}
        x, y = (Postorders(t, self.names, self.shapes) for t in (a, b))
        out: list = [e or f for e, f in zip(x.errors, y.errors)]
        good = np.array([k for k, e in enumerate(out) if e is None], np.int64)
        for g in groups(x.size[good], y.size[good], 1 << 19, 256) if len(good) else ():
            for k, found in zip(good[g].tolist(), self._group(x, y, good[g], scripts)):
                out[k] = found
        return out

    def _group(self, x: Postorders, y: Postorders, g: np.ndarray, scripts: bool) -> list[tuple]:
        m, n, pairs = x.size[g], y.size[g], len(g)
        rows, cols = int(m.max()), int(n.max())
        (na, la, sa, wa), (nb, lb, sb, wb) = ([s.padded(f, g, w).T.copy() for f in (s.names, s.low, s.nodes, s.whole)] for s, w in ((x, rows), (y, cols)))
        # trees[pair, u, v]: what is known from the start are leaves.
        like = (na[:, :, None] == nb[:, None, :]).astype(np.int32)
        each = np.arange(pairs)[:, None]
        upto = np.zeros((pairs, rows + 1, cols), np.int32)
        np.cumsum(like, axis=1, out=upto[:, 1:])
        trees = sa[:, :, None] - (upto[:, 1:] > upto[each, np.minimum(la, rows)])
        upto = np.zeros((pairs, rows, cols + 1), np.int32)
        np.cumsum(like, axis=2, out=upto[:, :, 1:])
        seen = upto[:, :, 1:] > np.take_along_axis(upto, np.broadcast_to(np.minimum(lb, cols)[:, None, :], (pairs, rows, cols)), axis=2)
        trees = np.where((sa == 1)[:, :, None], sb[:, None, :] - seen, trees).astype(np.int32)
        del upto, seen, like
        waves: dict[int, list] = {}
        for k, p in enumerate(g.tolist()):
            for i, hi in x.keyroots[p]:
                for j, hj in y.keyroots[p]:
                    waves.setdefault(hi + hj, []).append((k, i, j))
        flat, held = trees.reshape(-1), {}
        for _, tasks in sorted(waves.items()):
            pair, i, j = np.array(tasks, np.int64).T
            kind = wa[pair, i] * (len(self.shapes) + 1) + wb[pair, j]
            _, first, same = np.unique(kind, return_index=True, return_inverse=True)
            members = np.argsort(same, kind="stable")
            count = np.bincount(same)
            start = np.concatenate([[0], np.cumsum(count)])[:-1]
            ra, rb = sa[pair[first], i[first]], sb[pair[first], j[first]]
            for t in groups(ra, rb, 1 << 18, 4096):
                f = first[t]
                table, at, value = self._forests(flat, rows, cols, pair[f], i[f] - ra[t] + 1, j[f] - rb[t] + 1, ra[t], rb[t], na, la, nb, lb)
                s, v, k = at
                more = count[t][k]
                own = np.repeat(np.arange(len(k)), more)
                within = np.arange(len(own)) - np.repeat(np.cumsum(more) - more, more)
                who = members[start[t][k][own] + within]
                flat[(pair[who] * rows + i[who] - ra[t][k][own] + 1 + s[own]) * cols + j[who] - rb[t][k][own] + 1 + v[own]] = value[own]
                if scripts:
                    for c, (p, u, w) in enumerate(zip(pair[f].tolist(), i[f].tolist(), j[f].tolist())):
                        held[int(wa[p, u]), int(wb[p, w])] = (table, c)
        distance = trees[np.arange(pairs), m - 1, n - 1].tolist()
        if not scripts:
            return [(d, None) for d in distance]
        out = []
        lists: dict[tuple, list] = {}
        for k, d in enumerate(distance):
            out.append((d, self._mapping(*(z[k].tolist() for z in (na, la, wa, nb, lb, wb)), trees[k], int(m[k]), int(n[k]), held, lists)))
        return out

    @staticmethod
    def _forests(flat, rows, cols, pair, p, q, ra, rb, na, la, nb, lb):
        """Tables of forest distances (rows, columns, tasks), and where and what the distances of whole trees are."""
        tasks, height, width = len(pair), int(ra.max()), int(rb.max())
        f = np.zeros((height + 1, width + 1, tasks), np.int32)
        place = np.arange(width + 1, dtype=np.int32)[:, None]
        f[0] = place
        f[:, 0] = np.arange(height + 1)[:, None]
        v = np.minimum(q + np.arange(width)[:, None], cols - 1)
        names = nb[pair, v]
        low = np.clip(lb[pair, v] - q, 0, width)
        first = low == 0
        left = low * tasks + np.arange(tasks)
        spot = pair * rows * cols + v
        inside_a, inside_b = np.arange(height)[:, None] < ra, np.arange(width)[:, None] < rb
        whole_a = np.zeros((height, tasks), bool)
        forests = f.reshape(-1)
        for s in range(1, height + 1):
            u = np.minimum(p + s - 1, rows - 1)
            up = np.clip(la[pair, u] - p, 0, height)
            way = forests[left + up * ((width + 1) * tasks)] + flat[spot + u * cols]
            both = first & (up == 0)
            whole_a[s - 1] = up == 0
            if both.any():
                way = np.where(both, f[s - 1, :-1] + (names != na[pair, u]), way)
            row = f[s]
            np.minimum(way, f[s - 1, 1:] + 1, out=row[1:], casting="unsafe")
            row -= place
            np.minimum.accumulate(row, axis=0, out=row)
            row += place
        at = ((whole_a & inside_a)[:, None] & (first & inside_b)[None]).nonzero()
        return f, at, f[at[0] + 1, at[1] + 1, at[2]]

    @staticmethod
    def _mapping(na, la, wa, nb, lb, wb, trees, m, n, held, lists) -> str:
        pairs, todo = [], [(m - 1, n - 1)]
        while todo:
            i, j = todo.pop()
            p, q = la[i], lb[j]
            x, y = i - p + 1, j - q + 1
            shapes = wa[i], wb[j]
            f = lists.get(shapes)
            if f is None:
                if shapes in held:
                    table, c = held[shapes]
                    f = table[: x + 1, : y + 1, c].tolist()
                else:  # a leaf, or a node that is no keyroot: its forest is not among the tables
                    f = _forest(na, la, nb, lb, trees, i, j)
                if x * y < 100:
                    lists[shapes] = f
            while x and y:
                u, v = p + x - 1, q + y - 1
                whole = la[u] == p and lb[v] == q
                if f[x][y] == (f[x - 1][y - 1] + (na[u] != nb[v]) if whole else f[la[u] - p][lb[v] - q] + trees[u, v]):
                    if whole:
                        pairs.append("[%d, %d]" % (u, v))
                        x, y = x - 1, y - 1
                    else:
                        todo.append((u, v))
                        x, y = la[u] - p, lb[v] - q
                elif f[x][y] == f[x - 1][y] + 1:
                    x -= 1
                else:
                    y -= 1
        return "[" + ", ".join(pairs) + "]"


def _forest(na, la, nb, lb, trees, i: int, j: int) -> list[list[int]]:
    """The table of one pair of subtrees, with the distances of the trees in them known."""
    p, q = la[i], lb[j]
    f = [list(range(j - q + 2))]
    for x in range(1, i - p + 2):
        u, row, up = p + x - 1, [x], f[-1]
        for y in range(1, j - q + 2):
            v = q + y - 1
            way = up[y - 1] + (na[u] != nb[v]) if la[u] == p and lb[v] == q else f[la[u] - p][lb[v] - q] + int(trees[u, v])
            row.append(min(up[y] + 1, row[y - 1] + 1, way))
        f.append(row)
    return f
