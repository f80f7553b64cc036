"""Tree edit distances of pairs of trees.

A pair row has source_id, target_id, a, b (the two preorder arrays). Three algorithms: `chawathe` (alignment of the preorder
arrays), `nj` (whole-subtree operations) and `zhang_shasha` (keyroots). Distances and scripts run over Arrow batches; a batch
numbers its labels, values and subtree shapes, so that what many of its pairs have in common is worked out once. A distance
never computes a script. `chawathe_native` is the same distance as a column expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import arrow_map, sliced
from ..plans.trees import unpacked
from .batches import Mappings, Side, SubtreeEdits, alignment_distances, alignment_scripts, say

ALGORITHMS = {"chawathe": "chawathe_ld_pair_ted", "nj": "Nierman & Jagadish (2002)", "zhang_shasha": "zhang_shasha"}

# What whole-subtree operations say of themselves; s and t number the nodes of source and target.
UPDATED, DELETED, INSERTED = "Upd(R(s{}), t{})", "DelTree(s{})", "InsTree(t{}, s{}, {})"

#: Row by row dynamic programme over the two arrays. A cell looks left, up and up-left.
_CHAWATHE = """
element_at(aggregate(sequence(1, size(a)), sequence(0, size(b)),
  (up, i) -> aggregate(sequence(1, size(b)), array(i), (row, j) -> array_append(row, least(
    if(j = size(b) or a[i - 1].depth >= b[j - 1].depth, up[j] + 1, 1000000000),
    if(i = size(a) or b[j - 1].depth >= a[i - 1].depth, row[j - 1] + 1, 1000000000),
    if(a[i - 1].depth = b[j - 1].depth, up[j - 1] + if(a[i - 1].label = b[j - 1].label and a[i - 1].value <=> b[j - 1].value, 0, 1), 1000000000))))), -1)
"""


def canonical(algorithm: str) -> str:
    """Names in any case; what is unknown means chawathe."""
    name = (algorithm or "").strip().lower()
    return name if name in ("nj", "zhang_shasha") else "chawathe"


def similarity(distance: Column, a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - distance / total))


def coerce_root(seq: str, label: str | None) -> Column:
    if label is None:
        return F.col(seq)
    return F.transform(seq, lambda x, i: F.struct(F.when(i == 0, F.lit(label)).otherwise(x["label"]).alias("label"), x["value"].alias("value"), x["depth"].alias("depth")))


# ---- trees in Python: a node is (label, value, [children]) ----


class Node:
    __slots__ = ("children", "label", "pre", "size", "value")

    def __init__(self, label, value, pre):
        self.label, self.value, self.pre, self.size, self.children = label, value, pre, 1, []


def tree_of(labels: list, values: list, depths: list) -> Node:
    line: list[Node] = []
    for i, (label, value, d) in enumerate(zip(labels, values, depths)):
        n = Node(label, value, i)
        while line and depths[line[-1].pre] >= d:
            line.pop()
        for up in line:
            up.size += 1
        if line:
            line[-1].children.append(n)
        elif i:
            raise ValueError("more than one root")
        line.append(n)
    if not labels:
        raise ValueError("empty tree")
    return line[0]


def to_tree(seq: list[dict]) -> Node:
    return tree_of(*([x[k] for x in seq] for k in ("label", "value", "depth")))


def preorder(n: Node) -> list[Node]:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x.children))
    return out


def arrays_of(n: Node) -> tuple[list, list, list]:
    labels, values, depths, todo = [], [], [], [(n, 0)]
    while todo:
        x, d = todo.pop()
        labels.append(x.label)
        values.append(x.value)
        depths.append(d)
        todo.extend((c, d + 1) for c in reversed(x.children))
    return labels, values, depths


def to_seq(n: Node) -> list[dict]:
    return [{"label": x, "value": v, "depth": d} for x, v, d in zip(*arrays_of(n))]


def chawathe_script(a: list[dict], b: list[dict]) -> list[dict]:
    """Operations in order, positions counted in the sequence as it stands then. Ties: keep or update, delete, insert."""
    m, n, inf = len(a), len(b), 10**9
    d = [[0] * (n + 1) for _ in range(m + 1)]
    d[0] = list(range(n + 1))
    same = lambda x, y: x["label"] == y["label"] and x["value"] == y["value"]

    def moves(i: int, j: int):
        x, y = a[i - 1], b[j - 1]
        return (
            (d[i - 1][j - 1] + (not same(x, y)) if x["depth"] == y["depth"] else inf),
            (d[i - 1][j] + 1 if j == n or x["depth"] >= y["depth"] else inf),
            (d[i][j - 1] + 1 if i == m or y["depth"] >= x["depth"] else inf),
        )

    for i in range(1, m + 1):
        d[i][0] = i
        for j in range(1, n + 1):
            d[i][j] = min(moves(i, j))
    steps, i, j = [], m, n
    while i or j:
        way = 1 if j == 0 else 2 if i == 0 else moves(i, j).index(d[i][j])
        steps.append((way, i - 1, j - 1))
        i, j = i - (way != 2), j - (way != 1)
    ops, cursor = [], 0
    for way, i, j in reversed(steps):
        if way == 0:
            if not same(a[i], b[j]):
                ops.append({"op": "update", "position": cursor, "old": a[i], "new": b[j]})
            cursor += 1
        elif way == 1:
            ops.append({"op": "delete", "position": cursor, "old": a[i], "new": None})
        else:
            ops.append({"op": "insert", "position": cursor, "old": None, "new": b[j]})
            cursor += 1
    return ops


def _shapes(roots: list[Node]) -> dict[int, int]:
    """A number for each node (by identity), equal for equal subtrees; null and empty values are equal."""
    names: dict[tuple, int] = {}
    out: dict[int, int] = {}
    for root in roots:
        for n in reversed(preorder(root)):
            key = (n.label, n.value or "", tuple(out[id(c)] for c in n.children))
            out[id(n)] = names.setdefault(key, len(names))
    return out


def _contained(root: Node, inside: list[Node]) -> set[int]:
    """Nodes of root (by identity) whose subtrees are contained in a tree: matched children are a subsequence, at every level."""
    by_label: dict[tuple, list[Node]] = {}
    for c in inside:
        by_label.setdefault((c.label, c.value or ""), []).append(c)
    fits: dict[int, set[int]] = {}
    for n in reversed(preorder(root)):
        own = set()
        for c in by_label.get((n.label, n.value or ""), ()):
            rest = iter(c.children)
            if all(any(id(x) in fits[id(child)] for x in rest) for child in n.children):
                own.add(id(c))
        fits[id(n)] = own
    return {k for k, v in fits.items() if v}


def nj(a: list[dict], b: list[dict]) -> tuple[int, list[dict]]:
    """Distance with whole-subtree operations, and the operations: the root's update first, then children from left to right."""
    ta, tb = to_tree(a), to_tree(b)
    na, nb = preorder(ta), preorder(tb)
    in_b, in_a = _contained(ta, nb), _contained(tb, na)
    gone = {id(x): 1 if id(x) in in_b else x.size for x in na}
    come = {id(x): 1 if id(x) in in_a else x.size for x in nb}
    shapes = _shapes([ta, tb])
    known: dict[tuple[int, int], tuple] = {}

    def solve(x: Node, y: Node):
        todo = [(x, y, False)]
        while todo:
            p, q, ready = todo.pop()
            if (id(p), id(q)) in known:
                continue
            if not ready:
                todo.append((p, q, True))
                todo.extend((c, e, False) for c in p.children for e in q.children)
                continue
            rows, cols = len(p.children), len(q.children)
            start = int(p.label != q.label or (p.value or "") != (q.value or ""))
            d = [[start] + [0] * cols for _ in range(rows + 1)]
            for j, e in enumerate(q.children, 1):
                d[0][j] = d[0][j - 1] + come[id(e)]
            for i, c in enumerate(p.children, 1):
                d[i][0] = d[i - 1][0] + gone[id(c)]
                for j, e in enumerate(q.children, 1):
                    d[i][j] = min(d[i - 1][j - 1] + known[id(c), id(e)][0], d[i - 1][j] + gone[id(c)], d[i][j - 1] + come[id(e)])
            known[id(p), id(q)] = (d[rows][cols], d, start)
        return known[id(x), id(y)]

    total = solve(ta, tb)[0]
    ops: list[dict] = []

    def explain(p: Node, q: Node):
        if shapes[id(p)] == shapes[id(q)]:
            return
        _, d, start = known[id(p), id(q)]
        if start:
            ops.append({"op": "update", "ref": f"s{p.pre}", "position": None, "old": [p.label, p.value], "new": [q.label, q.value], "subtree": None, "count": 1, "note": UPDATED.format(p.pre, q.pre)})
        i, j, steps = len(p.children), len(q.children), []
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + known[id(p.children[i - 1]), id(q.children[j - 1])][0]:
                i, j = i - 1, j - 1
                steps.append(("match", i, j))
            elif i and d[i][j] == d[i - 1][j] + gone[id(p.children[i - 1])]:
                i -= 1
                steps.append(("delete_tree", i, j))
            else:
                j -= 1
                steps.append(("insert_tree", i, j))
        for kind, i, j in reversed(steps):
            if kind == "match":
                explain(p.children[i], q.children[j])
            elif kind == "delete_tree":
                ops.append({"op": kind, "ref": f"s{p.children[i].pre}", "position": i + 1, "old": None, "new": None, "subtree": to_seq(p.children[i]), "count": p.children[i].size, "note": DELETED.format(p.children[i].pre)})
            else:
                ops.append({"op": kind, "ref": f"s{p.pre}", "position": j + 1, "old": None, "new": None, "subtree": to_seq(q.children[j]), "count": q.children[j].size, "note": INSERTED.format(q.children[j].pre, p.pre, j + 1)})

    explain(ta, tb)
    return total, ops


def sort_children(n: Node) -> Node:
    for x in preorder(n):
        x.children.sort(key=lambda c: c.label)
    return n


def zhang_shasha(a: list[dict], b: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """Unit-cost distance of the label-sorted trees, and the mapped postorder numbers, root first."""

    def postorder(seq):
        order, first, todo = [], {}, [(sort_children(to_tree(seq)), False)]
        while todo:
            x, ready = todo.pop()
            if ready:
                first[id(x)] = first[id(x.children[0])] if x.children else len(order)
                order.append(x)
            else:
                todo.append((x, True))
                todo.extend((c, False) for c in reversed(x.children))
        lows = [first[id(x)] for x in order]
        roots = sorted({low: i for i, low in enumerate(lows)}.values())
        return order, lows, roots

    (xa, la, ka), (xb, lb, kb) = postorder(a), postorder(b)
    trees: dict[tuple[int, int], int] = {}
    change = lambda i, j: int(xa[i].label != xb[j].label or xa[i].value != xb[j].value)

    def forest(i: int, j: int) -> list[list[int]]:
        p, q = la[i], lb[j]
        f = [[0] * (j - q + 2) for _ in range(i - p + 2)]
        for x in range(1, i - p + 2):
            f[x][0] = x
        f[0] = list(range(j - q + 2))
        for x in range(1, i - p + 2):
            u = p + x - 1
            row, up = f[x], f[x - 1]
            for y in range(1, j - q + 2):
                v = q + y - 1
                if la[u] == p and lb[v] == q:
                    row[y] = trees[u, v] = min(up[y] + 1, row[y - 1] + 1, up[y - 1] + change(u, v))
                else:
                    row[y] = min(up[y] + 1, row[y - 1] + 1, f[la[u] - p][lb[v] - q] + trees[u, v])
        return f

    for i in ka:
        for j in kb:
            forest(i, j)
    pairs, todo = [], [(len(xa) - 1, len(xb) - 1)]
    while todo:
        i, j = todo.pop()
        f, p, q = forest(i, j), la[i], lb[j]
        x, y = i - p + 1, j - q + 1
        while x and y:
            u, v = p + x - 1, q + y - 1
            whole = la[u] == p and lb[v] == q
            if f[x][y] == (f[x - 1][y - 1] + change(u, v) if whole else f[la[u] - p][lb[v] - q] + trees[u, v]):
                if whole:
                    pairs.append((u, v))
                    x, y = x - 1, y - 1
                else:
                    todo.append((u, v))
                    x, y = la[u] - p, lb[v] - q
            elif f[x][y] == f[x - 1][y] + 1:
                x -= 1
            else:
                y -= 1
    return trees[len(xa) - 1, len(xb) - 1], pairs


SCRIPT = "source_id string, target_id string, distance int, ops string, error string"


_FAILURES = (ValueError, IndexError, TypeError, RecursionError)


def _failed(e: Exception) -> tuple:
    return None, None, f"{type(e).__name__}: {e}"


def _one_by_one(one: Callable, a: pa.Array, b: pa.Array, places) -> dict[int, tuple]:
    """Distance, JSON and error of the pairs at these places, by a function of two lists of nodes."""
    out = {}
    for k in places:
        try:
            distance, ops = one(a[k].as_py(), b[k].as_py())
            out[k] = (distance, say(ops), None)
        except _FAILURES as e:
            out[k] = _failed(e)
    return out


def _with_script(a, b):
    ops = chawathe_script(a, b)
    return len(ops), ops


def _chawathe_scripts():
    def many(a: pa.Array, b: pa.Array) -> list[tuple]:
        x, y = Side(a), Side(b)
        found = [(*f, None) for f in alignment_scripts(x, y)]
        for k, f in _one_by_one(_with_script, a, b, (x.odd | y.odd).nonzero()[0].tolist()).items():
            found[k] = f
        return found

    return many


def _nj_scripts():
    edits = SubtreeEdits()

    def many(a: pa.Array, b: pa.Array) -> list[tuple]:
        odd = (Side(a).odd | Side(b).odd).tolist()
        found = []
        for k, (x, y) in enumerate(zip(unpacked(a), unpacked(b))):
            try:
                found.append(_one_by_one(nj, a, b, [k])[k] if odd[k] else (*edits(x, y), None))
            except _FAILURES as e:
                found.append(_failed(e))
        return found

    return many


def _zhang_shasha_scripts():
    mappings = Mappings()

    def many(a: pa.Array, b: pa.Array) -> list[tuple]:
        odd = (Side(a).odd | Side(b).odd).nonzero()[0].tolist()
        found = [_failed(f) if isinstance(f, Exception) else (*f, None) for f in mappings(unpacked(a), unpacked(b), scripts=True)]
        for k, f in _one_by_one(zhang_shasha, a, b, odd).items():
            found[k] = f
        return found

    return many


def scripts(pairs: DataFrame, algorithm: str = "chawathe", keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, target_id, distance, ops (JSON), error, and columns of the pairs to keep. A pair that fails has an error and no distance."""
    make = {"chawathe": _chawathe_scripts, "nj": _nj_scripts, "zhang_shasha": _zhang_shasha_scripts}[canonical(algorithm)]
    names = [x.split()[0] for x in SCRIPT.split(", ")]

    def run(batches):
        many = make()
        for batch in sliced(batches):
            found = list(zip(*many(batch.column("a"), batch.column("b"))))
            made = [pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("target_id"), *made, *(batch.column(n) for n in keep)], [*names, *keep])

    schema = ", ".join([SCRIPT, *(f"`{n}` {pairs.schema[n].dataType.simpleString()}" for n in keep)])
    return arrow_map(pairs.select(*_text_ids(), *dict.fromkeys(["a", "b", *keep])), run, schema)


class Names:
    """Numbers for what is compared, kept for a batch."""

    def __init__(self):
        self.of: dict = {}

    def __call__(self, key) -> int:
        return self.of.setdefault(key, len(self.of))


def chawathe_distances(names: Names):
    """Distance of two trees given as (labels, values, depths): a row of the table at a time, each in one numpy pass.

    A row's steps to the right cost 1 where they are allowed, so a row is the running minimum of what comes from above,
    less the place, between places where no step is allowed.
    """
    inf = 1 << 40

    def one(a, b) -> int:
        m, n = len(a[0]), len(b[0])
        ka, kb = (np.fromiter(map(names, zip(*x)), np.int64, len(x[0])) for x in (a, b))
        da, db = np.array(a[2], np.int64), np.array(b[2], np.int64)
        place = np.arange(n + 1)
        row = place.copy()
        for i in range(1, m + 1):
            d = da[i - 1]
            down = row[1:] + 1
            shut = d < db
            shut[n - 1 :] = False
            down[shut] = inf
            side = row[:-1] + (ka[i - 1] != kb)
            side[db != d] = inf
            best = np.concatenate([[i], np.minimum(down, side)])
            if i == m:  # every step to the right is allowed
                row = np.minimum.accumulate(best - place) + place
                continue
            # Stretches of allowed steps: each begins anew, so its values are lowered by a step of their own.
            stretch = np.concatenate([[0], np.cumsum(db < d)])
            keyed = best - place - stretch * (2 * inf)
            row = np.minimum.accumulate(keyed) + place + stretch * (2 * inf)
        return int(row[n])

    return one


def nj_distances(names: Names):
    """Whole-subtree distance without a script. Pairs of subtree shapes that a batch has met are looked up."""
    known: dict[tuple[int, int], int] = {}
    # shape -> label and value, the shapes of the children, nodes
    shapes: dict[int, tuple] = {}
    fits: dict[tuple[int, int], bool] = {}

    def shape_of(root: Node) -> tuple[int, set[int]]:
        own: dict[int, int] = {}
        for n in reversed(preorder(root)):
            key = (names((n.label, n.value or "")), tuple(own[id(c)] for c in n.children))
            own[id(n)] = k = names(key)
            shapes.setdefault(k, (*key, n.size))
        return own[id(root)], set(own.values())

    def inside(x: int, y: int) -> bool:
        """Whether shape x fits into shape y from their roots: matched children are a subsequence, at every level."""
        if x == y:
            return True
        if (x, y) not in fits:
            (name, kids, size), (other, rest, most) = shapes[x], shapes[y]
            ok = name == other and size <= most
            if ok and kids:
                left = iter(rest)
                ok = all(any(inside(k, r) for r in left) for k in kids)
            fits[x, y] = ok
        return fits[x, y]

    def one(a, b) -> int:
        (ra, in_a), (rb, in_b) = shape_of(tree_of(*a)), shape_of(tree_of(*b))
        by_name: list[dict[int, list[int]]] = [{}, {}]
        for own, found in zip((in_a, in_b), by_name):
            for k in own:
                found.setdefault(shapes[k][0], []).append(k)
        cost = [{k: 1 if any(inside(k, y) for y in other.get(shapes[k][0], ())) else shapes[k][2] for k in own} for own, other in ((in_a, by_name[1]), (in_b, by_name[0]))]
        gone, come = cost
        solved: dict[tuple[int, int], int] = {}

        def solve(x: int, y: int) -> int:
            if x == y:
                return 0
            if (x, y) in solved:
                return solved[x, y]
            (p, left, _), (q, right, _) = shapes[x], shapes[y]
            row = [int(p != q)]
            for e in right:
                row.append(row[-1] + come[e])
            for c in left:
                diagonal, row[0] = row[0], row[0] + gone[c]
                for j, e in enumerate(right, 1):
                    diagonal, row[j] = row[j], min(diagonal + solve(c, e), row[j] + gone[c], row[j - 1] + come[e])
            solved[x, y] = row[-1]
            return row[-1]

        if (ra, rb) not in known:
            known[ra, rb] = solve(ra, rb)
        return known[ra, rb]

    return one


def zhang_shasha_distances(names: Names):
    """Unit-cost distance of the label-sorted trees without a mapping. Pairs of subtree shapes that a batch has met are looked up."""
    # shape -> names in postorder, leftmost leaves, keyroots, shape of each node, for each keyroot the nodes with its leftmost leaf
    shapes: dict[int, tuple] = {}
    known: dict[tuple[int, int], list[int]] = {}

    def shape_of(root: Node) -> int:
        own: dict[int, int] = {}
        for n in reversed(preorder(sort_children(root))):
            own[id(n)] = names((names((n.label, n.value)), tuple(own[id(c)] for c in n.children)))
        k = own[id(root)]
        if k not in shapes:
            order, low, whole = [], [], []

            def walk(n: Node) -> int:
                first = None
                for c in n.children:
                    at = walk(c)
                    first = at if first is None else first
                first = len(order) if first is None else first
                order.append(names((n.label, n.value)))
                low.append(first)
                whole.append(own[id(n)])
                return first

            walk(root)
            left: dict[int, list[int]] = {}
            for i, v in enumerate(low):
                left.setdefault(v, []).append(i)
            shapes[k] = (order, low, sorted(v[-1] for v in left.values()), whole, left)
        return k

    def one(a, b) -> int:
        x, y = shape_of(tree_of(*a)), shape_of(tree_of(*b))
        if x == y:
            return 0
        (xa, la, ka, wa, fa), (xb, lb, kb, wb, fb) = shapes[x], shapes[y]
        trees: dict[tuple[int, int], int] = {}
        for i in ka:
            for j in kb:
                p, q = la[i], lb[j]
                own = [(u, v) for u in fa[p] for v in fb[q]]
                if (wa[i], wb[j]) in known:
                    trees.update(zip(own, known[wa[i], wb[j]]))
                    continue
                width = j - q + 2
                rows = [list(range(width))]
                for s in range(1, i - p + 2):
                    u = p + s - 1
                    name, lu, up = xa[u], la[u], rows[s - 1]
                    row, left = [s], s
                    for t in range(1, width):
                        v = q + t - 1
                        best = up[t] if up[t] < left else left
                        best += 1
                        if lu == p and lb[v] == q:
                            way = up[t - 1] + (name != xb[v])
                            if way < best:
                                best = way
                            trees[u, v] = best
                        else:
                            way = rows[lu - p][lb[v] - q] + trees[u, v]
                            if way < best:
                                best = way
                        row.append(best)
                        left = best
                    rows.append(row)
                known[wa[i], wb[j]] = [trees[o] for o in own]
        return trees[len(xa) - 1, len(xb) - 1]

    return one


SCORE = "source_id string, target_id string, n_source int, n_target int, distance int, similarity double"
_DISTANCES = {"chawathe": chawathe_distances, "nj": nj_distances, "zhang_shasha": zhang_shasha_distances}


def _text_ids() -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in ("source_id", "target_id")]


def _chawathe_many(root_label: str | None):
    one = chawathe_distances(Names())

    def many(a: pa.Array, b: pa.Array) -> list[int | None]:
        x, y = Side(a), Side(b)
        found = alignment_distances(x, y, root_label).tolist()
        for k in ((x.size == 0) | (y.size == 0) | x.odd | y.odd).nonzero()[0].tolist():
            found[k] = _of_one(one, *(next(unpacked(c.slice(k, 1))) for c in (a, b)), root_label)
        return found

    return many


def _of_one(one: Callable, a, b, root_label: str | None) -> int | None:
    if root_label is not None:
        a, b = (([root_label, *x[0][1:]], x[1], x[2]) for x in (a, b))
    try:
        return one(a, b) if a[1] and b[1] else None
    except _FAILURES:
        return None


def _nj_many(root_label: str | None):
    edits = SubtreeEdits()
    one = lambda a, b: edits(a, b, script=False)[0]
    return lambda a, b: [_of_one(one, x, y, root_label) for x, y in zip(unpacked(a), unpacked(b))]


def _zhang_shasha_many(root_label: str | None):
    mappings = Mappings()
    named = lambda trees: trees if root_label is None else (([root_label, *x[0][1:]], x[1], x[2]) if x[0] else x for x in trees)
    return lambda a, b: [None if isinstance(f, Exception) else f[0] for f in mappings(named(unpacked(a)), named(unpacked(b)))]


def distances(pairs: DataFrame, algorithm: str = "chawathe", root_label: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, target_id, n_source, n_target, distance, similarity, and columns of the pairs to keep. A pair that can't be compared has no distance."""
    make = {"chawathe": _chawathe_many, "nj": _nj_many, "zhang_shasha": _zhang_shasha_many}[canonical(algorithm)]
    names = [x.split()[0] for x in SCORE.split(", ")]

    def run(batches):
        many = make(root_label)
        for batch in sliced(batches):
            a, b = batch.column("a"), batch.column("b")
            found = many(a, b)
            sizes = [x.value_lengths().fill_null(0).to_pylist() for x in (a, b)]
            like = [None if d is None else max(0.0, 1.0 - d / (m + n)) for d, m, n in zip(found, *sizes)]
            columns = [batch.column("source_id"), batch.column("target_id"), *(pa.array(x, pa.int32()) for x in (*sizes, found)), pa.array(like, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(n) for n in keep)], [*names, *keep])

    schema = ", ".join([SCORE, *(f"`{n}` {pairs.schema[n].dataType.simpleString()}" for n in keep)])
    return arrow_map(pairs.select(*_text_ids(), *dict.fromkeys(["a", "b", *keep])), run, schema)


def chawathe_native(pairs: DataFrame) -> DataFrame:
    """source_id, target_id, distance as a column expression, for short arrays in a plan that must stay in the JVM."""
    return pairs.select("source_id", "target_id", F.expr(_CHAWATHE).alias("distance"))


def lower_bound(keep_depth: bool = True) -> Column:
    """No chawathe (or, without depth, zhang_shasha) distance of a and b is less: the larger size less the common nodes."""
    bag = lambda s: F.transform(s, lambda x: F.concat_ws("\x1f", x["label"], F.when(x["value"].isNull(), "0").otherwise("1"), F.coalesce(x["value"], F.lit("")), *([x["depth"].cast("string")] if keep_depth else [])))
    numbered = lambda s: F.transform(F.array_sort(bag(s)), lambda v, i: F.concat_ws("\x1e", v, (i - F.array_position(F.array_sort(bag(s)), v)).cast("string")))
    common = F.size(F.array_intersect(numbered("a"), numbered("b")))
    return F.greatest(F.size("a"), F.size("b")) - common
