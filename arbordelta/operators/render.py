"""Trees as text: infobox text, indented and drawn lines, JSON and XML. Each tree is one pass over its array."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.trees import parents, per_tree, sizes
from .ted import Node, tree_of

# Marks in drawn and reported text.
LAST, BRANCH, GAP, BAR, CUT = "└── ", "├── ", "    ", "│   ", "..."


def _text_of(trees: DataFrame, one) -> DataFrame:
    return per_tree(trees, lambda seq: (one(*seq),), {"text": "string"})


def infobox_lines(labels: list, values: list, depths: list) -> str:
    """A heading, a line for each leaf of the fields (without fields, of the tree) that has text, and an end."""
    up = parents(depths)
    size = sizes(up)
    dotted: list[str] = []
    for i, u in enumerate(up):
        dotted.append(labels[i] if u <= 0 else f"{dotted[u]}.{labels[i]}")
    first = lambda name: next((i for i, u in enumerate(up) if u == 0 and labels[i] == name), None)
    leaves = lambda i: [k for k in range(i, i + size[i]) if size[k] == 1]
    meta, fields = first("meta"), first("fields")
    facts = {dotted[k]: values[k] or "" for k in leaves(meta)} if meta is not None else {}
    title = facts.get("meta.country_name") or facts.get("meta.slug") or labels[0]
    if fields is not None:
        rows = [(dotted[k].removeprefix("fields."), values[k]) for k in leaves(fields)]
    else:  # then the root's label is part of each name
        rows = [(dotted[k] if k == 0 else f"{labels[0]}.{dotted[k]}", values[k]) for k in leaves(0)]
        rows = [(name.removeprefix("fields."), v) for name, v in rows]
    return "\n".join(["{{Infobox country", f"| name = {title}", *(f"| {name} = {v}" for name, v in rows if v and v.strip()), "}}"])


def infobox_text(trees: DataFrame) -> DataFrame:
    """tree_id, text."""
    return _text_of(trees, infobox_lines)


def indented(trees: DataFrame, max_depth: int | None = None) -> DataFrame:
    """tree_id, text: two spaces a level, `label = value` of a leaf, `label: value` of a group; what is deeper than max_depth is one line of dots."""

    def one(labels, values, depths):
        size, out = sizes(parents(depths)), []
        for label, value, d, n in zip(labels, values, depths, size):
            if max_depth is None or d <= max_depth:
                out.append("  " * d + (label if value is None else f"{label} = {value}" if n == 1 else f"{label}: {value}"))
                if d == max_depth and n > 1:
                    out.append("  " * (d + 1) + CUT)
        return "\n".join(out)

    return _text_of(trees, one)


def drawn(trees: DataFrame, max_depth: int | None = None, show_root: bool = True) -> DataFrame:
    """tree_id, text: branches drawn with box characters, `label = value`; dots where max_depth cuts children off."""

    def one(labels, values, depths):
        up = parents(depths)
        size, out, lead = sizes(up), [], [""] * len(labels)
        for i, (label, value, d) in enumerate(zip(labels, values, depths)):
            said = label if value is None else f"{label} = {value}"
            if i == 0:
                if show_root:
                    out.append(said)
                    if max_depth == 0 and size[0] > 1:
                        return "\n".join([*out, CUT])
                continue
            last = i + size[i] == up[i] + size[up[i]]  # it ends where its parent does
            lead[i] = lead[up[i]] + (GAP if last else BAR)
            if max_depth is None or d <= max_depth:
                out.append(lead[up[i]] + (LAST if last else BRANCH) + said)
                if d == max_depth and size[i] > 1:
                    out.append(lead[i] + CUT)
        return "\n".join(out)

    return _text_of(trees, one)


def native_object(n: Node):
    """Leaves are their text, groups are objects; repeated labels become lists, a group's own value is `_value` at the end."""
    if not n.children:
        return n.value if n.value is not None else ""
    found: dict[str, list] = {}
    for c in n.children:
        found.setdefault(c.label, []).append(native_object(c))
    out = {k: v if len(v) > 1 else v[0] for k, v in found.items()}
    return out if n.value is None else out | {"_value": n.value}


@lru_cache(4096)
def xml_name(label: str) -> str:
    safe = re.sub(r"[^a-zA-Z0-9_.-]+", "_", label.strip()) or "node"
    return safe if re.match("[A-Za-z_]", safe) else f"n_{safe}"


def _xml(n: Node) -> ElementTree.Element:
    e = ElementTree.Element(xml_name(n.label))
    e.text = n.value
    e.extend(map(_xml, n.children))
    return e


_SHOW = json.JSONEncoder(ensure_ascii=False, indent=2).encode


def json_of(root: Node) -> str:
    return _SHOW({root.label: native_object(root)})


def xml_of(root: Node) -> str:
    return ElementTree.tostring(_xml(root), encoding="unicode")


def json_text(seq) -> str:
    return json_of(tree_of(*seq))


def xml_text(seq) -> str:
    return xml_of(tree_of(*seq))


def documents(trees: DataFrame) -> DataFrame:
    """tree_id, json, xml, error."""
    return per_tree(trees, lambda seq: (json_of(root := tree_of(*seq)), xml_of(root)), {"json": "string", "xml": "string"}, errors=True)


def plain_xml(rows: DataFrame, column: str, root: str = "root") -> DataFrame:
    """rows and `xml`: any JSON as elements named by its keys; list entries are `item`. A text that can't be read has an error."""

    def below(e: ElementTree.Element, v) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                below(ElementTree.SubElement(e, str(k)), x)
        elif isinstance(v, list):
            for x in v:
                below(ElementTree.SubElement(e, "item"), x)
        else:
            e.text = "" if v is None else str(v)

    def one(text):
        top = ElementTree.Element(root)
        below(top, json.loads(text))
        return (ElementTree.tostring(top, encoding="unicode"),)

    return per_tree(rows, one, {"xml": "string"}, ids=tuple(rows.columns), given=(column,), errors=True)


NOTES = {
    "nj": "NJ uses insert_tree/delete_tree for whole subtrees; subtree_node_count on each such op is how many nodes that step moves. Chawathe lists one insert/delete/update per preorder node, so operation counts are not comparable across algorithms even when the patched tree matches."
}


def report(compared: DataFrame) -> DataFrame:
    """source_id, target_id, text: see report_text()."""
    return compared.select("source_id", "target_id", report_text().alias("text"))


def report_text() -> Column:
    """Sizes of the script by kind, the operations (nj), and the patched tree's infobox, as text.

    Of columns source_id, target_id, algorithm, kind (canonical name), distance, similarity, inserts, deletes, updates, total,
    deleted_nodes, inserted_nodes, steps (array<string>, nj only), infobox.
    """
    nj = F.col("kind") == "nj"
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), F.col(c).cast("string"))
    plain = F.array(F.lit("- model: chawathe_ld_pair_sequence"), line("insert", "inserts"), line("delete", "deletes"), line("update", "updates"), line("total_operations", "total"), F.lit("- each_operation_is_one_preorder_node: True"))
    moved = (F.col("deleted_nodes") + F.col("inserted_nodes")).cast("string")
    whole = F.array(
        F.lit("- model: nierman_jagadish_subtree"), line("update", "updates"), line("insert_tree", "inserts"), line("delete_tree", "deletes"), line("total_operations", "total"),
        line("nodes_in_deleted_subtrees", "deleted_nodes"), line("nodes_in_inserted_subtrees", "inserted_nodes"), F.concat(F.lit("- subtree_node_volume: "), moved), F.lit(""), F.lit(NOTES["nj"]),
    )
    head = F.array(
        F.format_string("Comparison: %s -> %s", "source_id", "target_id"), F.concat(F.lit("Algorithm: "), F.col("algorithm")), F.concat(F.lit("Distance: "), F.col("distance").cast("string")),
        F.format_string("Similarity: %.4f", "similarity"), F.lit(""), F.lit("Edit script summary:"),
    )
    steps = F.when(nj, F.concat(F.array(F.lit(""), F.lit("Operations:")), F.transform("steps", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)))).otherwise(F.expr("cast(array() as array<string>)"))
    said = F.concat(head, F.when(nj, whole).otherwise(plain), F.array(line("total", "total")), steps, F.array(F.lit(""), F.lit("Patched infobox:"), F.col("infobox")))
    return F.array_join(said, "\n")
