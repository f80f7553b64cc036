"""Structure scores and semantic (path) diffs of pairs. A pair's row holds both trees, so each pair is one pass and nothing is shuffled.

Values of a semantic diff are JSON text: a leaf is a string, a number if it reads as one, or null; a group is an object,
its repeated children lists.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import arrow_map, sliced
from ..functions.text import segment_base
from ..plans.trees import parents, per_tree, unpacked
from .batches import say
from .features import base
from .ted import Node, tree_of

# Path segments that no diff reports, the categories of a path's second segment, and the sign of an empty value.
IGNORED = ("retrieved_at", "slug", "wikipedia_url", "source")
CATEGORIES = {"economy": "Economy", "government": "Government", "population": "Population", "area": "Geography", "coordinates": "Geography"}
EMPTY = "∅"
MARKS = {"update": "🔄 UPDATE", "insert": "➕ INSERT", "delete": "❌ DELETE"}

PAIR = ("source_id", "target_id")


def _loose(n: Node, out: list[int]) -> bool:
    """Adds what a subtree without a counterpart costs; whether no leaf of it has text."""
    blank = all([_loose(c, out) for c in n.children]) if n.children else not (n.value or "").strip()
    out[0] += 0 if blank else 2
    return blank


def similar(a: Node, b: Node) -> tuple[int, int, float]:
    """Matches, total and score of two trees. Children pair up by label, k-th with k-th; null and empty values are equal."""
    matches, missed, todo = 0, [0], [(a, b)]
    while todo:
        x, y = todo.pop()
        matches += (x.label == y.label) + ((x.value or "") == (y.value or ""))
        missed[0] += 2
        waiting: dict[str, list[Node]] = {}
        for c in reversed(y.children):
            waiting.setdefault(c.label, []).append(c)
        for c in x.children:
            if same := waiting.get(c.label):
                todo.append((c, same.pop()))
            else:
                _loose(c, missed)
        for left in waiting.values():
            for c in left:
                _loose(c, missed)
    return matches, missed[0], matches / missed[0]


def tree_similarity(pairs: DataFrame) -> DataFrame:
    """source_id, target_id, matches, total, score: see similar()."""
    return per_tree(pairs, lambda a, b: similar(tree_of(*a), tree_of(*b)), {"matches": "long", "total": "long", "score": "double"}, ids=PAIR, given=("a", "b"))


@lru_cache(1 << 14)
def _named_ignored(label: str) -> bool:
    return base(label) in IGNORED


def is_ignored(path: list[str]) -> bool:
    return any([_named_ignored(s) for s in path])


def scalar(value: str | None):
    """A leaf's value: a number if it reads as one, else its text without spaces at the ends."""
    text = value if value is None else value.strip()
    try:
        return text and (float(text) if "." in text else int(text))
    except ValueError:
        return text


def semantic_value(n: Node):
    labels = {c.label for c in n.children}
    if not labels:
        return scalar(n.value)
    if labels == {"token"}:
        return " ".join(t for c in n.children if c.value is not None and (t := c.value.strip()))
    if labels == {"value"}:
        found = [scalar(c.value) for c in n.children]
        return found if len(found) > 1 else found[0]
    groups: dict[str, list] = {}
    for c in n.children:
        groups.setdefault(c.label, []).append(semantic_value(c))
    out: dict = {}
    for label, found in groups.items():
        if label.endswith("_item"):
            name = label.removesuffix("_item")
            held = out.get(name, [])
            out[name] = [*(held if isinstance(held, list) else [held]), *found]
        else:
            out[label] = found if len(found) > 1 else found[0]
    return out


def atomic(n: Node) -> bool:
    return all(c.label in ("token", "value") for c in n.children)


def _keyed(n: Node) -> dict[str, Node]:
    count: dict[str, int] = {}
    for c in n.children:
        count[c.label] = count.get(c.label, 0) + 1
    out, k = {}, {}
    for c in n.children:
        k[c.label] = k.get(c.label, -1) + 1
        out[f"{c.label}[{k[c.label]}]" if count[c.label] > 1 else c.label] = c
    return out


_NONE = object()


def _changes(old, new, path: list[str]):
    """Operations between two values of which at least one may be missing; both objects are gone through by key."""
    if isinstance(old, dict) and isinstance(new, dict):
        for key in sorted(old.keys() | new.keys()):
            yield from _changes(old.get(key, _NONE), new.get(key, _NONE), [*path, key])
    elif not is_ignored(path):
        if old is _NONE:
            yield {"op": "insert", "path": path, "value": new}
        elif new is _NONE:
            yield {"op": "delete", "path": path, "old_value": old}
        elif old != new:
            yield {"op": "update", "path": path, "old_value": old, "new_value": new}


def differences(a: Node, b: Node) -> list[dict]:
    """Operations in order of their paths. Of two sections with one label the last counts; meta's copy of the name is left out.

    A subtree that is on one side only is one operation.
    """

    def below(x: Node | None, y: Node | None, path: list[str]):
        if _named_ignored(path[-1]):  # those above have been looked at
            return
        if x is None or y is None or atomic(x) or atomic(y):
            yield from _changes(*(_NONE if n is None else semantic_value(n) for n in (x, y)), path)
            return
        left, right = _keyed(x), _keyed(y)
        for key in sorted(left.keys() | right.keys()):
            yield from below(left.get(key), right.get(key), [*path, key])

    left, right = ({c.label: c for c in n.children} for n in (a, b))
    found = [o for key in sorted(left.keys() | right.keys()) for o in below(left.get(key), right.get(key), [key])]
    return without_meta_name(distinct_ops(split_renamed(found)))


# ---- operations as dicts: op, path, old_value, new_value, value ----


def split_renamed(ops: list[dict]) -> list[dict]:
    """An update between two labels (old_label and new_label, or those of old_node and new_node) becomes delete and insert, with the new label in the path."""
    out = []
    for o in ops:
        if o["op"] != "update":
            out.append(dict(o))
            continue
        nodes = [o.get(k) if isinstance(o.get(k), dict) else {} for k in ("old_node", "new_node")]
        old, new = (o.get(k) if o.get(k) is not None else n.get("label") for k, n in zip(("old_label", "new_label"), nodes))
        if isinstance(old, str) and isinstance(new, str) and old and new and old != new:
            path = list(o.get("path") or [])
            suffix = path[-1][path[-1].index("[") :] if path and "[" in path[-1] else ""
            values = [n["value"] if n.get("value") is not None else o.get(k) for k, n in zip(("old_value", "new_value"), nodes)]
            out.append({"op": "delete", "path": path, "old_value": values[0]})
            out.append({"op": "insert", "path": [*path[:-1], (base(new) if suffix else new) + suffix], "value": values[1]})
        else:
            out.append({k: v for k, v in o.items() if k not in ("old_node", "new_node", "old_label", "new_label")})
    return out


_SORTED = json.JSONEncoder(sort_keys=True, default=str).encode


def _said(v) -> str:
    return "null" if v is None else _SORTED(v)


def distinct_ops(ops: list[dict]) -> list[dict]:
    if len(ops) < 2:
        return list(ops)
    said = lambda o, k: _said(o.get(k))
    return list({(o["op"], *(o.get("path") or ()), said(o, "old_value"), said(o, "new_value"), said(o, "value")): o for o in reversed(ops)}.values())[::-1]


def without_meta_name(ops: list[dict]) -> list[dict]:
    return [o for o in ops if not (len(o.get("path") or ()) > 1 and o["path"][0] == "meta" and base(o["path"][1]) == "country_name")]


def is_empty(v) -> bool:
    """Whether a value, or all that is in it, is null or blank."""
    if isinstance(v, (dict, list)):
        return all(map(is_empty, v.values() if isinstance(v, dict) else v))
    return v is None or (isinstance(v, str) and not v.strip())


def is_blank_op(o: dict) -> bool:
    """A delete or insert of nothing, or an update of nothing to nothing."""
    return all(is_empty(o.get(k)) for k in {"insert": ("value",), "delete": ("old_value",), "update": ("old_value", "new_value")}[o["op"]])


def shown(v, key=lambda k: k.replace("_", " ").title()) -> str:
    if isinstance(v, dict):
        return ", ".join(f"{key(str(k))}: {shown(x, key)}" for k, x in v.items())
    if isinstance(v, list):
        return ", ".join(shown(x, key) for x in v)
    return EMPTY if v is None or (isinstance(v, str) and v.strip() in ("", "None")) else str(v)


def label_of(path: list[str]) -> str:
    return base(path[-1].replace("_", " ")).title() if path else "Root"


def human(ops: list[dict]) -> str:
    """A line `- Label: old` or `+ Label: new` for each side of each operation."""
    sides = {"update": (("-", "old_value"), ("+", "new_value")), "insert": (("+", "value"),), "delete": (("-", "old_value"),)}
    return "\n".join(f"{sign} {label_of(o['path'])}: {shown(o.get(k))}" for o in ops for sign, k in sides[o["op"]])


def structured(ops: list[dict]) -> str:
    """A block for each operation: its kind and label, then its values."""
    plain = lambda v: shown(v, lambda k: k)
    sides = {"update": (("- Old", "old_value"), ("+ New", "new_value")), "insert": (("+ Value", "value"),), "delete": (("- Value", "old_value"),)}
    blocks = ["\n".join([f"{MARKS[o['op']]} — {label_of(o['path'])}", *(f"   {sign}: {plain(o.get(k))}" for sign, k in sides[o["op"]])]) for o in ops]
    return "\n\n".join(blocks).rstrip()


OPS = "op string, path array<string>, old_value string, new_value string, value string"


def semantic_diff(pairs: DataFrame) -> DataFrame:
    """source_id, target_id and OPS, a row for each difference; values are JSON, and is null what an operation doesn't have."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
        for batch in sliced(batches):
            rows = []
            for s, t, a, b in zip(batch.column("source_id").to_pylist(), batch.column("target_id").to_pylist(), unpacked(batch.column("a")), unpacked(batch.column("b"))):
                for o in differences(tree_of(*a), tree_of(*b)):
                    rows.append((s, t, o["op"], o["path"], *(say(o[k]) if k in o else None for k in ("old_value", "new_value", "value"))))
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["source_id", "target_id", "op", "path", "old_value", "new_value", "value"])

    return arrow_map(pairs.select(*PAIR, "a", "b"), run, f"source_id string, target_id string, {OPS}")


def diff_texts(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, target_id, columns to keep, n_ops, inserts, deletes, updates, blank_ops, ops (JSON list), human, structured, error: the semantic diff of each pair."""

    def one(a, b):
        ops = differences(tree_of(*a), tree_of(*b))
        count = [sum(o["op"] == k for o in ops) for k in ("insert", "delete", "update")]
        return len(ops), *count, sum(map(is_blank_op, ops)), say(ops), human(ops), structured(ops)

    kinds = {"n_ops": "long", "inserts": "long", "deletes": "long", "updates": "long", "blank_ops": "long", "ops": "string", "human": "string", "structured": "string"}
    return per_tree(pairs, one, kinds, ids=(*PAIR, *keep), given=("a", "b"), errors=True)


def cleaned_ops(rows: DataFrame, ids: tuple[str, ...], column: str = "ops") -> DataFrame:
    """ids, ops (JSON), error: operations given as a JSON list, with renamed labels split, repeats and meta's copy of the name left out."""
    return per_tree(rows, lambda text: (json.dumps(without_meta_name(distinct_ops(split_renamed(json.loads(text)))), ensure_ascii=False),), {"ops": "string"}, ids=ids, given=(column,), errors=True)


def without_empty(ops: DataFrame) -> DataFrame:
    """Leaves out operations between nothing and nothing: deletes and inserts of blank values, updates of blank to blank."""
    blank = per_tree(ops, lambda o, p, x, y, v: (is_blank_op({"op": o} | {k: json.loads(w) for k, w in (("old_value", x), ("new_value", y), ("value", v)) if w is not None}),), {"blank": "boolean"}, ids=tuple(ops.columns), given=("op", "path", "old_value", "new_value", "value"))
    return blank.where("not blank").drop("blank")


def summarize(ops: DataFrame) -> DataFrame:
    count = lambda *names: F.count_if(F.col("op").isin(*names)).cast("long")
    return ops.groupBy("source_id", "target_id").agg(count("insert").alias("inserts"), count("delete").alias("deletes"), count("update").alias("updates"), F.count("*").cast("long").alias("total"))


def categorize(ops: DataFrame) -> DataFrame:
    """category, n: operations by the second segment of their path."""
    names = F.create_map(*[F.lit(v) for kv in CATEGORIES.items() for v in kv])
    category = F.coalesce(F.try_element_at(names, F.lower(segment_base(F.get("path", F.lit(1))))), F.lit("Others"))
    return ops.groupBy(category.alias("category")).agg(F.count("*").cast("long").alias("n"))


def equal(a, b, algorithm: str = "nj") -> bool:
    """Whether two trees have the same labels, values and depths in order. Without the alignment algorithm depths must name the same parents only."""
    if algorithm.lower() in ("nj", "zhang_shasha"):
        if not a[0] or not b[0]:
            raise ValueError("empty tree")
        a, b = ((x[0], x[1], parents(x[2])) for x in (a, b))
    return tuple(map(list, a)) == tuple(map(list, b))


def trees_equal(pairs: DataFrame, algorithm: str = "nj") -> DataFrame:
    """source_id, target_id, equal: see equal()."""
    return per_tree(pairs, lambda a, b: (equal(a, b, algorithm),), {"equal": "boolean"}, ids=PAIR, given=("a", "b"))
