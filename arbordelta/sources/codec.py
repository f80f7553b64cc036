"""Trees as nested JSON, and trees of any JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import leaf_value
from ..operators.ted import Node, arrays_of, preorder, tree_of
from ..plans.trees import SEQ, per_tree

# Lists whose entries keep their text as it is.
LIST_FIELDS = ("languages",)


def to_json(trees: DataFrame) -> DataFrame:
    """tree_id, json: nested objects of label, value and children."""

    def one(seq):
        root = tree_of(*seq)
        made = {}
        for n in reversed(preorder(root)):
            made[id(n)] = {"label": n.label, "value": n.value, "children": [made[id(c)] for c in n.children]}
        return (json.dumps(made[id(root)], ensure_ascii=False),)

    return per_tree(trees, one, {"json": "string"})


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """tree_id, seq, error of rows with a tree_id and a nested tree. Without value a node has none, without children it is a leaf."""

    def one(text):
        labels, values, depths, todo = [], [], [], [(json.loads(text), 0)]
        while todo:
            n, d = todo.pop()
            value = n.get("value")
            labels.append(str(n["label"]))
            values.append(None if value is None else str(value))
            depths.append(d)
            todo += [(c, d + 1) for c in reversed(n.get("children") or [])]
        return ((labels, values, depths),)

    return per_tree(rows, one, {"seq": SEQ}, given=(column,), errors=True)


#: Marks values that are not yet leaf texts.
_RAW = "\x00"


def _below(label: str, value) -> Node:
    """A tree of any JSON value: scalars before groups, each by name; list entries are `label_item`."""
    n = Node(label, None, -1)
    if isinstance(value, dict):
        nested = {k for k, v in value.items() if isinstance(v, (dict, list))}
        n.children = [_below(k, value[k]) for k in sorted(value, key=lambda k: (k in nested, k))]
    elif isinstance(value, list):
        plain = label in LIST_FIELDS
        for x in value:
            if isinstance(x, (dict, list)) or not plain:
                n.children.append(_below(f"{label}_item", x))
            elif x is not None and not (isinstance(x, str) and not x.strip()):
                n.children.append(Node(f"{label}_item", None, -1))
                n.children[-1].value = str(x)
    else:
        n.value = _RAW + ("" if value is None else str(value))
    return n


def trees_of_documents(rows: DataFrame, column: str = "document") -> DataFrame:
    """tree_id, seq, error of rows with a tree_id and a JSON document {meta, normalized: {comparison_fields, fields}}.

    The root is named by meta's slug, else its country_name. Without comparison fields the plain fields stand for them.
    """

    def one(text):
        document = json.loads(text)
        meta, normalized = document.get("meta") or {}, document.get("normalized") or {}
        fields = normalized.get("comparison_fields") or normalized.get("fields") or {}
        root = Node(str(meta.get("slug") or meta.get("country_name") or "country"), None, -1)
        if meta:
            root.children.append(_below("meta", meta))
        if fields:
            root.children.append(Node("fields", None, -1))
            root.children[-1].children = [_below(k, fields[k]) for k in sorted(fields)]
        return (arrays_of(root),)

    made = per_tree(rows, one, {"seq": SEQ}, given=(column,), errors=True)
    raw = lambda x: x["value"].startswith(_RAW)
    value = lambda x: F.when(raw(x), leaf_value(x["label"], F.substring(x["value"], 2, 1 << 30))).otherwise(x["value"])
    return made.withColumn("seq", F.transform("seq", lambda x: F.struct(x["label"].alias("label"), value(x).alias("value"), x["depth"].alias("depth"))))
