"""Feature paths: discovery, pruning by include and exclude lists, and look-ups. Each tree is one pass over its array."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.code import arrow_map
from ..plans.trees import SEQ, parents, per_tree, sizes, unpacked
from .ted import Node, tree_of


def leaf_paths(trees: DataFrame) -> DataFrame:
    """tree_id, path: dotted label paths of leaves without the root's label (a root alone keeps it), distinct in a tree."""

    def run(batches):
        for batch in batches:
            ids, paths = [], []
            for tree_id, (labels, _, depths) in zip(batch.column("tree_id").to_pylist(), unpacked(batch.column("seq"))):
                up, dotted = parents(depths), []
                for i, u in enumerate(up):
                    dotted.append(labels[i] if u <= 0 else f"{dotted[u]}.{labels[i]}")
                own = dict.fromkeys(p for p, n in zip(dotted, sizes(up)) if n == 1)
                ids += [tree_id] * len(own)
                paths += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string())], ["tree_id", "path"])

    return arrow_map(trees.select("tree_id", "seq"), run, "tree_id string, path string")


def feature_union(trees: DataFrame, first: int | None = None) -> DataFrame:
    """path: all leaf paths in ascending order, of the `first` trees by id (all if None)."""
    if first is not None:
        trees = trees.orderBy("tree_id").limit(first)
    return leaf_paths(trees).select("path").distinct().orderBy("path")


def steps_of(path: str) -> list[str]:
    return [s for s in path.split(".") if s]


def _keep(trees: DataFrame, features: list[str], wanted: bool) -> DataFrame:
    """Trees of the leaves whose path begins with a feature (or of those with none), and their ancestors.

    With `wanted` a group named itself stays without its children if none of its leaves does. A tree without any
    becomes its root without a value.
    """
    lists = {tuple(w) for f in features if (w := steps_of(f))}

    def one(seq):
        labels, values, depths = seq
        up = parents(depths)
        size, line, held = sizes(up), [()], [False] * len(labels)
        inside = [False] * len(labels)  # below or at a feature
        for i in range(1, len(labels)):
            line.append((*line[up[i]], labels[i]))
            inside[i] = inside[up[i]] or line[i] in lists
        for i in range(len(labels) - 1, 0, -1):
            if size[i] == 1:
                held[i] = inside[i] == wanted
            elif wanted and not held[i] and line[i] in lists:
                held[i] = True
            held[up[i]] = held[up[i]] or held[i]
        if len(labels) < 2 or not held[0]:
            return ((labels[:1], [None], [0]),)
        own = [0, *(i for i in range(1, len(labels)) if held[i])]
        return (([labels[i] for i in own], [values[i] for i in own], [depths[i] for i in own]),)

    return per_tree(trees, one, {"seq": SEQ})


def prune_include(trees: DataFrame, features: list[str]) -> DataFrame:
    return _keep(trees, features, True) if features else trees


def prune_exclude(trees: DataFrame, features: list[str]) -> DataFrame:
    return _keep(trees, features, False) if features else trees


def base(label: str) -> str:
    return label.split("[", 1)[0]


def child(node: Node | None, name: str) -> Node | None:
    """The child of that label, else the first whose label is the same up to `[`."""
    if node is None:
        return None
    return next((c for c in node.children if c.label == name), None) or next((c for c in node.children if base(c.label) == base(name)), None)


def at_path(root: Node, steps: list[str]) -> Node | None:
    for s in steps:
        root = child(root, s)
    return root


def leaf_text(node: Node | None) -> str | None:
    """A node's value, else that of its token children, joined, or of its only value child."""
    if node is None or node.value is not None:
        return node and node.value
    labels = {c.label for c in node.children}
    if labels == {"token"}:
        return " ".join(c.value.strip() for c in node.children if c.value) or None
    return node.children[0].value if labels == {"value"} and len(node.children) == 1 else None


def value_at(root: Node, steps: list[str]) -> str | None:
    return leaf_text(at_path(root, steps)) if steps else None


def values_at(root: Node, steps: list[str]) -> list[str]:
    """The values that are not null of all nodes that match the last step up to `[`."""
    above = at_path(root, steps[:-1]) if steps else None
    found = (leaf_text(c) for c in above.children if base(c.label) == base(steps[-1])) if above is not None else ()
    return [v for v in found if v is not None]


def lookup(trees: DataFrame, path: str) -> DataFrame:
    """tree_id, value, found: what the path leads to from the root, and whether it is there."""
    steps = steps_of(path)

    def one(seq):
        root = tree_of(*seq)
        return value_at(root, steps), bool(steps) and at_path(root, steps) is not None

    return per_tree(trees, one, {"value": "string", "found": "boolean"})


def lookup_all(trees: DataFrame, path: str) -> DataFrame:
    """tree_id, values."""
    steps = steps_of(path)
    return per_tree(trees, lambda seq: (values_at(tree_of(*seq), steps),), {"values": "array<string>"})

