"""Patches: positional scripts, whole-subtree scripts, and dotted-path patches.

apply_positional() replays a positional script natively on the preorder array. Script columns hold the JSON that ted.scripts() gives. A row
that can't be worked out has an error and no result.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import arrow_map, sliced
from ..functions.text import normalize_path
from ..plans.trees import SEQ, packed, per_tree, unpacked
from .batches import say
from .diff import IGNORED, PAIR, is_ignored
from .features import at_path, child, steps_of, value_at, values_at
from .ted import Node, canonical, preorder, sort_children, to_seq, to_tree, tree_of

_NODE = "struct<label:string,value:string,depth:int>"
OPS = f"array<struct<op:string,position:int,old:{_NODE},new:{_NODE}>>"


def apply_positional(rows: DataFrame, check: bool = True) -> DataFrame:
    """Adds `patched` to rows with a (the source's array) and ops (JSON). An operation whose old node isn't there is an error."""
    parsed = rows.withColumn("_ops", F.from_json("ops", OPS))
    bad = "raise_error(concat('node mismatch at ', cast(o.position as string)))"
    guard = f"if(o.old is not null and not (s[o.position] <=> o.old), {bad}, s)" if check else "s"
    step = f"""aggregate(_ops, cast(a as {SEQ}), (s, o) -> case
      when o.op = 'insert' then concat(slice(s, 1, o.position), array(o.new), slice(s, o.position + 1, size(s)))
      when o.op = 'delete' then concat(slice({guard}, 1, o.position), slice(s, o.position + 2, size(s)))
      else concat(slice({guard}, 1, o.position), array(o.new), slice(s, o.position + 2, size(s))) end)"""
    return parsed.withColumn("patched", F.expr(step)).drop("_ops")


def levels(depths: list[int]) -> list[int]:
    """Depths made steps of one again: a node's depth is the number of earlier nodes that are its ancestors."""
    out, line = [], []
    for d in depths:
        while line and line[-1] >= d:
            line.pop()
        out.append(len(line))
        line.append(d)
    return out


def _positional_apply(a: list[dict], ops: list[dict]) -> list[dict]:
    """As apply_positional(), with depths made steps of one again."""
    seq = list(a)
    for o in ops:
        at, kind = o["position"], o["op"]
        if kind != "insert" and o["old"] is not None and (at >= len(seq) or seq[at] != o["old"]):
            raise ValueError(f"node mismatch at {at}")
        seq[at : at + (kind != "insert")] = [] if kind == "delete" else [o["new"]]
    return [{**x, "depth": d} for x, d in zip(seq, levels([x["depth"] for x in seq]))]


def _nj_apply(a: list[dict], ops: list[dict]) -> list[dict]:
    root = to_tree(a)
    ref = {f"s{n.pre}": n for n in preorder(root)}
    parent = {id(c): n for n in preorder(root) for c in n.children}
    for o in ops:
        target = ref[o["ref"]]
        if o["op"] == "update":
            label, value = o["new"]
            target.label, target.value = label if label is not None else target.label, value
        elif o["op"] == "delete_tree":
            if target is root:
                raise ValueError("the root can't be deleted")
            parent[id(target)].children.remove(target)
        else:
            at = min(max(o["position"] - 1, 0), len(target.children))
            target.children.insert(at, to_tree(o["subtree"]))
    return to_seq(root)


FAILURES = (KeyError, ValueError, IndexError)


def _run(rows: DataFrame, one, keep: tuple[str, ...]) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, 500):
            out, errors = [], []
            for a, b, ops in zip(*(unpacked(batch.column(n)) for n in ("a", "b")), batch.column("ops").to_pylist()):
                try:
                    out.append(one(a, b, json.loads(ops)))
                    errors.append(None)
                except FAILURES as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*PAIR, *keep)), packed(out), pa.array(errors, pa.string())], [*PAIR, *keep, "patched", "error"])

    schema = ", ".join([f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in (*PAIR, *keep)] + [f"patched {SEQ}", "error string"])
    return arrow_map(rows.select(*dict.fromkeys([*PAIR, "a", "b", "ops", *keep])), run, schema)


def _zs_apply(b: list[dict], pairs: list) -> list[dict]:
    """The label-sorted target; its root must be mapped."""
    target = sort_children(to_tree(b))
    if all(v != len(b) - 1 for _, v in pairs):
        raise ValueError("the target's root is not mapped")
    return to_seq(target)


def replayed(kind: str, a, b, ops: list):
    """The labels, values and depths of a source after its script; FAILURES if it can't be replayed."""
    listed = lambda seq: [{"label": x, "value": v, "depth": d} for x, v, d in zip(*seq)]
    out = _positional_apply(listed(a), ops) if kind == "chawathe" else _nj_apply(listed(a), ops) if kind == "nj" else _zs_apply(listed(b), ops)
    return tuple([x[k] for x in out] for k in ("label", "value", "depth"))


def _beside(pairs: DataFrame, scripted: DataFrame, *trees: str) -> DataFrame:
    """Scripts that did not fail beside their pairs' trees: those that ted.scripts() kept, else found by a join that copies neither side."""
    good = scripted.where("error is null")
    return good if {*trees} <= {*scripted.columns} else pairs.select(*PAIR, *trees).join(good.hint("merge"), [*PAIR])


def apply_script(pairs: DataFrame, scripted: DataFrame, algorithm: str = "chawathe", keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, target_id, patched, error: the scripts of ted.scripts() replayed on their sources; columns to keep stand before `patched`.

    With ted.scripts(keep=("a", "b")) the pairs are not read again.
    """
    kind = canonical(algorithm)
    return _run(_beside(pairs, scripted, "a", "b"), lambda a, b, ops: replayed(kind, a, b, ops), keep)


COUNTS = ("inserts", "deletes", "updates", "maps", "length", "deleted_nodes", "inserted_nodes")


def counts_of(ops: list) -> tuple[int, ...]:
    """COUNTS of a script, as summarize_script() gives them."""
    own = [o for o in ops if isinstance(o, dict)]
    n = lambda *names: sum(o["op"] in names for o in own)
    moved = lambda name: sum(o.get("count") or 0 for o in own if o["op"] == name)
    return n("insert", "insert_tree"), n("delete", "delete_tree"), n("update"), len(ops) - len(own), len(own), moved("delete_tree"), moved("insert_tree")


def summarize_script(scripted: DataFrame) -> DataFrame:
    """source_id, target_id, inserts, deletes, updates, maps, length (without maps), deleted_nodes, inserted_nodes (of whole-subtree operations)."""
    ops = F.from_json("ops", "array<struct<op:string,count:int>>")
    n = lambda *names: F.size(F.filter("_o", lambda o: o["op"].isin(*names))).cast("long")
    maps = F.when(F.col("ops").rlike(r"^\[\["), F.size(F.from_json("ops", "array<array<int>>"))).otherwise(0).cast("long")
    rows = scripted.where("error is null").withColumn("_o", F.coalesce(F.filter(ops, lambda o: o["op"].isNotNull()), F.expr("cast(array() as array<struct<op:string,count:int>>)"))).withColumn("maps", maps)
    moved = lambda name: F.aggregate(F.filter("_o", lambda o: o["op"] == name), F.lit(0), lambda s, o: s + F.coalesce(o["count"], F.lit(0))).cast("long")
    return rows.select("source_id", "target_id", n("insert", "insert_tree").alias("inserts"), n("delete", "delete_tree").alias("deletes"), n("update").alias("updates"), "maps", F.size("_o").cast("long").alias("length"), moved("delete_tree").alias("deleted_nodes"), moved("insert_tree").alias("inserted_nodes"))


def normalize_script(a: list[dict], ops: list[dict]) -> list[dict]:
    """Operations of a positional script without those on ignored paths; a label change becomes delete and insert.

    What is left out is not replayed, so later paths are those of the sequence without it. Of a split change both go or stay.
    """
    seq, out = [dict(x) for x in a], []

    def path(at: int) -> list[str]:
        """Labels from the root to the node at a place; a node's ancestors are the nearest earlier ones of ever smaller depth."""
        if not 0 <= at < len(seq):
            return []
        found = [seq[at]["label"]]
        depth = seq[at]["depth"]
        for k in range(at - 1, -1, -1):
            if seq[k]["depth"] < depth:
                found.append(seq[k]["label"])
                depth = seq[k]["depth"]
        return found

    for o in ops:
        at, kind = o["position"], o["op"]
        if kind == "insert":
            seq.insert(at, o["new"])
            if is_ignored(path(at)):
                del seq[at]
                continue
        elif is_ignored(path(at)):
            continue
        elif kind == "delete":
            del seq[at]
        elif o["old"]["label"] == o["new"]["label"]:
            seq[at] = o["new"]
        else:
            before = seq[at]
            seq[at] = o["new"]
            if is_ignored(path(at)):
                seq[at] = before
                continue
            out += [{**o, "op": "delete", "new": None}, {**o, "op": "insert", "old": None}]
            continue
        out.append(o)
    return out


def normalize_nj_script(ops: list[dict]) -> list[dict]:
    """Whole-subtree operations without those whose own label is ignored."""
    labels = {"update": lambda o: {o["old"][0], o["new"][0]}, "delete_tree": lambda o: {o["subtree"][0]["label"]}, "insert_tree": lambda o: {o["subtree"][0]["label"]}}
    return [o for o in ops if not labels[o["op"]](o) & {*IGNORED}]


def normalized_scripts(pairs: DataFrame, scripted: DataFrame, algorithm: str = "chawathe") -> DataFrame:
    """source_id, target_id, ops (JSON), error: scripts for display. Mappings stay as they are."""
    kind = canonical(algorithm)
    one = {
        "chawathe": lambda a, ops: normalize_script([{"label": x, "value": v, "depth": d} for x, v, d in zip(*a)], ops),
        "nj": lambda a, ops: normalize_nj_script(ops),
        "zhang_shasha": lambda a, ops: ops,
    }[kind]
    return per_tree(_beside(pairs, scripted, "a"), lambda a, ops: (say(one(a, json.loads(ops))),), {"ops": "string"}, ids=PAIR, given=("a", "ops"), errors=True)


# ---- dotted-path patches: map<path, struct<vals array<string>, is_list boolean>> ----

PATCH = "map<string,struct<vals:array<string>,is_list:boolean>>"


def patch_tree(seq: list[dict], patch: list[tuple[str, list | None, bool]]) -> list[dict]:
    """Set leaf values by path, in ascending order of path; missing nodes are made, None clears a value, a list replaces all items."""
    return to_seq(patch_root(to_tree(seq), patch))


def patch_root(root: Node, patch: list[tuple[str, list | None, bool]]) -> Node:
    """As patch_tree(), on a tree's root."""
    new = Node
    for path, vals, is_list in sorted(patch, key=lambda p: p[0]):
        steps = [s for s in path.split(".") if s]
        if not steps:
            continue
        if is_list and steps[-1].endswith("_item"):
            at = root
            for s in steps[:-1]:
                at = child(at, s)
            if at is not None and len(steps) > 1:
                base = steps[-1].split("[", 1)[0]
                at.children = [c for c in at.children if c.label.split("[", 1)[0] != base] + [new(base, v, -1) for v in vals or []]
            continue
        at = root
        for s in steps:
            below = child(at, s)
            if below is None:
                below = new(s, None, -1)
                at.children.append(below)
            at = below
        at.value = str(vals) if is_list else (vals[0] if vals else None)
    return root


def apply_paths(rows: DataFrame) -> DataFrame:
    """tree_id, seq, error of rows with tree_id, seq and patch (PATCH, paths as given)."""
    clean = rows.select("tree_id", "seq", F.transform(F.map_entries("patch"), lambda e: F.struct(normalize_path(e["key"]).alias("path"), e["value"]["vals"].alias("vals"), e["value"]["is_list"].alias("is_list"))).alias("patch"))

    def one(seq, patch):
        found = patch_tree([{"label": x, "value": v, "depth": d} for x, v, d in zip(*seq)], [(p["path"], p["vals"], bool(p["is_list"])) for p in patch or []])
        return (tuple([x[k] for x in found] for k in ("label", "value", "depth")),)

    return per_tree(clean, one, {"seq": SEQ}, given=("seq", "patch"), errors=True)


NAME_PATHS = ("meta.country_name", "fields.country_name")


def _full(path: str) -> str:
    """The path from the root: without `fields.` or `meta.` it is one of the fields."""
    path = path.strip()
    return path if not path or path.startswith(("fields.", "meta.")) else f"fields.{path}"


#: What (?U)\\s of functions.text.strip() means.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def full_path(path: str) -> str:
    """As functions.text.normalize_path()."""
    path = path.strip(_SPACES)
    return path if not path or path.startswith(("fields.", "meta.")) else f"fields.{path}"


def feature_values(source, target, wanted: list[str]) -> list[tuple[str, dict]]:
    """Path and values of the target's nodes at the wanted paths; a null where only the source has the path.

    A name's path, given in full, stands for both copies of the name.
    """
    patch = {}
    if set(wanted) & {*NAME_PATHS}:
        name = next((v for p in reversed(NAME_PATHS) if (v := value_at(target, steps_of(p))) is not None), None)
        for p in NAME_PATHS:
            if name is not None or at_path(source, steps_of(p)) is not None:
                patch[p] = {"vals": None if name is None else [name], "is_list": False}
    for path in sorted(set(wanted) - {*NAME_PATHS}):
        steps = steps_of(_full(path))
        if not steps:
            continue
        if found := [v for v in values_at(target, steps) if v != ""]:
            patch[_full(path)] = {"vals": found, "is_list": len(found) > 1}
        elif at_path(source, steps) is not None:
            patch[_full(path)] = {"vals": None, "is_list": False}
    return list(patch.items())


def without_excluded(paths: list[str], excluded: list[str]) -> list[str]:
    gone = {_full(p) for p in excluded}
    return [p for p in paths if not any(_full(p) == g or _full(p).startswith(g + ".") for g in gone)]


def values_of_features(wanted: list[str] | None, excluded: list[str]):
    """A function of two trees: feature_values of the wanted paths (all leaf paths of both if None) that are not excluded."""
    chosen = None if wanted is None else without_excluded([p for p in wanted if p.strip()], excluded)

    def paths_of(root) -> set[str]:
        out, todo = set(), [(c, c.label) for c in root.children]
        while todo:
            n, p = todo.pop()
            if not n.children:
                out.add(p)
            todo += [(c, f"{p}.{c.label}") for c in n.children]
        return out

    return lambda a, b: feature_values(a, b, chosen if chosen is not None else without_excluded(sorted(paths_of(a) | paths_of(b)), excluded))


def patch_from_features(pairs: DataFrame, wanted: list[str] | None, excluded: list[str] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, target_id, patch (PATCH): the target's values at the wanted paths that are not excluded; None where only the source has the path.

    Without `wanted` it is all leaf paths of both trees. Columns of the pairs to keep stand before `patch`.
    """
    values = values_of_features(wanted, list(excluded))

    def run(batches):
        kind = pa.map_(pa.string(), pa.struct([("vals", pa.list_(pa.string())), ("is_list", pa.bool_())]))
        for batch in sliced(batches):
            out = [values(tree_of(*a), tree_of(*b)) for a, b in zip(unpacked(batch.column("a")), unpacked(batch.column("b")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*PAIR, *keep)), pa.array(out, kind)], [*PAIR, *keep, "patch"])

    schema = ", ".join([f"`{n}` {pairs.schema[n].dataType.simpleString()}" for n in (*PAIR, *keep)] + [f"patch {PATCH}"])
    return arrow_map(pairs.select(*dict.fromkeys([*PAIR, "a", "b", *keep])), run, schema)


def paths_of_diff(ops: list[dict]) -> list[tuple[str, list | None, bool]]:
    """The patch of a pair's differences, as diff_to_patch() gives it."""
    found: dict[str, tuple] = {}
    for o in ops:
        v = {"update": o.get("new_value"), "insert": o.get("value")}.get(o["op"])
        v = v if v is None or isinstance(v, str) else say(v)
        if path := ".".join(o["path"]):
            found[path] = max(found.get(path, ("", "")), (o["op"], v or "", v is not None), key=lambda x: x[:2])
    return [(p, [v] if has else None, False) for p, (_, v, has) in sorted(found.items())]


def diff_to_patch(ops: DataFrame) -> DataFrame:
    """source_id, target_id, patch: a semantic diff as a path patch (update: new value, insert: value, delete: clears); of equal paths the last in order counts."""
    plain = lambda c: F.when(F.col(c) == "null", F.lit(None)).when(F.col(c).startswith('"'), F.from_json(F.concat(F.lit("["), F.col(c), F.lit("]")), "array<string>")[0]).otherwise(F.col(c))
    value = F.when(F.col("op") == "update", plain("new_value")).when(F.col("op") == "insert", plain("value"))
    cell = F.struct(F.when(value.isNotNull(), F.array(value)).alias("vals"), F.lit(False).alias("is_list"))
    named = ops.withColumn("k", F.array_join("path", ".")).where("k <> ''").groupBy("source_id", "target_id", "k").agg(F.max_by(cell, F.struct(F.col("op"), F.coalesce(value, F.lit("")))).alias("v"))
    return named.groupBy("source_id", "target_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("patch"))
