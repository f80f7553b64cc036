"""Trees as rows: one row holds a tree as an array of (label, value, depth) in preorder.

Spark has no recursive types. The array keeps everything (a node's parent is the nearest earlier one that is less deep).
What needs a tree's shape is one ordered pass over its array, in Arrow batches, so it is linear in the nodes and needs no shuffle;
nodes() gives one row for each node where an operator needs joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import arrow_map, sliced

SEQ = "array<struct<label:string,value:string,depth:int>>"
MAX_NODES, MAX_DEPTH = 100_000, 256


def node(label, value, depth: int) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    value = F.lit(None).cast("string") if value is None else value.cast("string")
    return F.struct(label.cast("string").alias("label"), value.alias("value"), F.lit(depth).alias("depth"))


def fields_seq(root: str, meta: dict[str, Column], fields: dict[str, Column], items: Column | None = None) -> Column:
    """root -> meta{...}, fields{...}: names in ascending order, then `items`, an array of nodes at depth 2 and below."""
    seq = [F.array(node(root, None, 0))]
    if meta:
        seq.append(F.array(node("meta", None, 1), *[node(k, meta[k], 2) for k in sorted(meta)]))
    seq.append(F.array(node("fields", None, 1), *[node(k, fields[k], 2) for k in sorted(fields)]))
    if items is not None:
        seq.append(items)
    return F.concat(*[s.cast(SEQ) for s in seq])


KIND = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string()), ("depth", pa.int32())]))
Seq = tuple[list, list, list]


def unpacked(column: pa.Array) -> Iterator[Seq]:
    """The labels, values and depths of each tree of a column of arrays; a null array has none."""
    flat, at = column.flatten(), 0
    parts = [flat.field(n).to_pylist() for n in ("label", "value", "depth")]
    for size in column.value_lengths().fill_null(0).to_pylist():
        yield tuple(x[at : at + size] for x in parts)
        at += size


def packed(trees: list[Seq | None]) -> pa.Array:
    """A column of arrays of the trees' labels, values and depths."""
    offsets, parts = [0], ([], [], [])
    for t in trees:
        for x, y in zip(parts, t or ((), (), ())):
            x.extend(y)
        offsets.append(len(parts[0]))
    flat = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(parts, (pa.string(), pa.string(), pa.int32()))], ["label", "value", "depth"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([t is None for t in trees]))


def parents(depths: list[int]) -> list[int]:
    """The place of each node's parent, -1 for the first node; an error where a second root stands."""
    out, line = [], []
    for i, d in enumerate(depths):
        while line and depths[line[-1]] >= d:
            line.pop()
        if i and not line:
            raise ValueError("more than one root")
        out.append(line[-1] if line else -1)
        line.append(i)
    return out


def sizes(parent: list[int]) -> list[int]:
    """The number of nodes of each subtree."""
    out = [1] * len(parent)
    for i in range(len(parent) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


FAILURES = (ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError)


def per_tree(df: DataFrame, one: Callable, kinds: dict[str, str], ids: tuple[str, ...] = ("tree_id",), given: tuple[str, ...] = ("seq",), errors: bool = False) -> DataFrame:
    """Columns of `ids` and those that one(*given) returns as a tuple; given trees come unpacked, trees returned so are packed.

    errors: a row that fails has nulls and a text in `error`; else it fails the job.
    """
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    names = [*ids, *kinds, *(["error"] if errors else [])]
    trees = {f.name for f in df.schema if f.dataType.simpleString() == SEQ}

    def run(batches):
        for batch in sliced(batches, 500):
            out: list[list] = [[] for _ in kinds]
            failed: list[str | None] = []
            for args in zip(*(unpacked(batch.column(n)) if n in trees else batch.column(n).to_pylist() for n in given)):
                try:
                    found, error = one(*args), None
                except FAILURES as e:
                    if not errors:
                        raise
                    found, error = (None,) * len(kinds), f"{type(e).__name__}: {e}"
                for x, y in zip(out, found):
                    x.append(y)
                failed.append(error)
            made = [packed(x) if k == SEQ else pa.array(x, types[k]) for x, k in zip(out, kinds.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ids), *made, *([pa.array(failed, pa.string())] if errors else [])], names)

    schema = [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in ids] + [f"{n} {k}" for n, k in kinds.items()] + (["error string"] if errors else [])
    return arrow_map(df.select(*dict.fromkeys([*ids, *given])), run, ", ".join(schema))


NODES = "n int, pre int, post int, parent_pre int, depth int, ordinal int, size int, lmd int, label string, value string, path array<string>, occ_path array<string>, keyed_path array<string>"


def named(labels: list[str], parent: list[int]) -> tuple[list[int], list[str], list[str]]:
    """Each node's place among its siblings, its name label#k by the k-th sibling of that label, and label or label[k] if there are more."""
    ordinal, k, count = [], [], {}
    seen: dict[int, int] = {}
    for label, up in zip(labels, parent):
        ordinal.append(seen.setdefault(up, 0))
        seen[up] += 1
        k.append(count.get((up, label), 0))
        count[up, label] = k[-1] + 1
    return ordinal, [f"{x}#{i}" for x, i in zip(labels, k)], [f"{x}[{i}]" if count[up, x] > 1 else x for x, i, up in zip(labels, k, parent)]


def nodes(trees: DataFrame) -> DataFrame:
    """tree_id and NODES, a row for each node.

    ordinal: place among the siblings. occ_path names a node by label#k, the k-th sibling of that label; keyed_path by
    label, or label[k] if a sibling has the same. Both leave the root out.
    """

    def run(batches):
        kinds = [pa.int32()] * 8 + [pa.string()] * 2 + [pa.list_(pa.string())] * 3
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, out = [], [[] for _ in kinds]
                for tree_id, (labels, values, depths) in zip(batch.column("tree_id").slice(at, 500).to_pylist(), unpacked(batch.column("seq").slice(at, 500))):
                    n, up = len(labels), parents(depths)
                    size = sizes(up)
                    ordinal, occ, keyed = named(labels, up)
                    lines: list[tuple] = []
                    for i, u in enumerate(up):
                        lines.append((lines[u][0] + [labels[i]], lines[u][1] + [occ[i]], lines[u][2] + [keyed[i]]) if i else ([labels[0]], [], []))
                    ids += [tree_id] * n
                    rows = ([n] * n, range(n), [i - d + s - 1 for i, d, s in zip(range(n), depths, size)], up, depths, ordinal, size, [i - d for i, d in enumerate(depths)], labels, values, *([x[k] for x in lines] for k in range(3)))
                    for x, y in zip(out, rows):
                        x.extend(y)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array(x, k) for x, k in zip(out, kinds))], ["tree_id", *(x.split()[0] for x in NODES.split(", "))])

    return arrow_map(trees.select(F.col("tree_id").cast("string").alias("tree_id"), "seq"), run, f"tree_id string, {NODES}")


def validate(trees: DataFrame, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """tree_id, n, depth, error (null if the tree is sound)."""
    ds = F.transform("seq", lambda x: x["depth"])
    shallow = F.forall(F.sequence(F.lit(1), F.size("seq") - 1), lambda k: F.get("seq", k)["depth"] >= 1)
    error = (
        F.when(F.col("seq").isNull() | (F.size("seq") == 0), "empty tree")
        .when(F.size("seq") > max_nodes, "too many nodes").when(F.array_max(ds) > max_depth, "too deep")
        .when(F.get("seq", F.lit(0))["depth"] != 0, "the first node is not a root").when((F.size("seq") > 1) & ~shallow, "more than one root")
        .when(F.exists("seq", lambda x: x["label"].isNull() | ~x["label"].rlike(r"\S")), "blank label")
    )
    return trees.select("tree_id", F.size("seq").alias("n"), F.array_max(ds).alias("depth"), error.alias("error"))
