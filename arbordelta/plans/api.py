"""Composite queries: comparison, patch, post-processing and ingest, each over whole tables of pairs or pages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, features, normalize, patch, render, ted
from ..sources import html
from .datasets import spread
from .trees import SEQ, per_tree

KEY = ["source_id", "target_id"]


def pair_up(trees: DataFrame, wanted: DataFrame) -> DataFrame:
    """source_id, target_id, a, b for the ids in wanted (source_id, target_id). Ids without a tree are left out. Trees are never broadcast."""
    a = trees.select(F.col("tree_id").alias("source_id"), F.col("seq").alias("a"))
    b = trees.select(F.col("tree_id").alias("target_id"), F.col("seq").alias("b"))
    sources = spread(wanted, "source_id").join(spread(a, "source_id").hint("merge"), "source_id")
    return spread(sources, "target_id").join(spread(b, "target_id").hint("merge"), "target_id").select("source_id", "target_id", "a", "b")


def missing(trees: DataFrame, wanted: DataFrame) -> DataFrame:
    """source_id, target_id, error: the wanted pairs of which a tree is absent."""
    ids = trees.select("tree_id").distinct()
    out = wanted
    for side in KEY:
        out = out.join(ids.select(F.col("tree_id").alias(side), F.lit(True).alias(f"has_{side}")), side, "left")
    absent = F.when(F.col("has_source_id").isNull(), F.col("source_id")).when(F.col("has_target_id").isNull(), F.col("target_id"))
    return out.select(*KEY, absent.alias("_absent")).where("_absent is not null").select(*KEY, F.format_string("no tree for '%s'", "_absent").alias("error"))


def _coerced(pairs: DataFrame, root_label: str | None) -> DataFrame:
    return pairs.select(*KEY, ted.coerce_root("a", root_label).alias("a"), ted.coerce_root("b", root_label).alias("b"))


def compare(trees: DataFrame, wanted: DataFrame, chosen: list[str] = (), exclude: bool = False, algorithm: str = "chawathe", root_label: str | None = None) -> DataFrame:
    """Distance, similarity, script, semantic diff counts and text of each wanted pair, after pruning to (or without) the chosen features."""
    pruned = (features.prune_exclude if exclude else features.prune_include)(trees, list(chosen))
    pairs = _coerced(pair_up(pruned, wanted), root_label)  # a semantic diff doesn't name the root
    scored = ted.distances(pairs, algorithm, keep=("a", "b")).withColumnRenamed("distance", "_distance")
    measured = ["n_source", "n_target", "_distance", "similarity"]
    scripted = ted.scripts(scored, algorithm, keep=("a", "b", *measured)).withColumnsRenamed({"ops": "script", "error": "script_error"})
    texts = diff.diff_texts(scripted, keep=(*measured, "script", "script_error"))
    counts = {n: F.coalesce(n, F.lit(0)) for n in ("inserts", "deletes", "updates")} | {"total": F.coalesce("n_ops", F.lit(0))}
    return texts.select(
        *KEY, "n_source", "n_target", F.col("_distance").alias("distance"), "similarity", F.col("script").alias("ops"), F.col("script_error").alias("error"), *(c.alias(n) for n, c in counts.items()),
        F.col("human").alias("text"), "structured", F.col("ops").alias("clean_ops"), F.lit(ted.ALGORITHMS[ted.canonical(algorithm)]).alias("algorithm"),
    )


def full_diff(pairs: DataFrame, algorithm: str = "chawathe", root_label: str | None = None) -> DataFrame:
    """source_id, target_id, algorithm, kind, distance, similarity, script counts, matches_target, patched, json, xml, infobox, report, error.

    Each pair's script, the script replayed on its source, whether that gives the target, and the report. A pair that
    fails has an error. Given trees may come from codec.from_json(). A pair's row goes through both passes whole: nothing is joined.
    """
    kind = ted.canonical(algorithm)
    scripted = ted.scripts(_coerced(pairs, root_label), algorithm, keep=("a", "b")).withColumnRenamed("error", "script_error")
    blank = (lambda v: [x or "" for x in v]) if kind == "nj" else list

    def judged(a, b, text):
        sizes = len(a[0]), len(b[0])
        if text is None:
            return *sizes, *[None] * 14
        ops = json.loads(text)
        steps = [o["op"] if o["note"] is None else o["note"] for o in ops] if kind == "nj" else []
        said = (*sizes, *patch.counts_of(ops), steps)
        try:
            patched = patch.replayed(kind, a, b, ops)
        except patch.FAILURES as e:
            return *said, *[None] * 5, f"{type(e).__name__}: {e}"
        if kind == "zhang_shasha":
            b = ted.arrays_of(ted.sort_children(ted.tree_of(*b)))
        root = ted.tree_of(*patched)
        matches = (list(patched[0]), blank(patched[1]), list(patched[2])) == (list(b[0]), blank(b[1]), list(b[2]))
        return *said, patched, render.json_of(root), render.xml_of(root), render.infobox_lines(*patched), matches, None

    kinds = {"n_source": "int", "n_target": "int", **dict.fromkeys(patch.COUNTS, "long"), "steps": "array<string>", "patched": SEQ, "json": "string", "xml": "string", "infobox": "string", "matches_target": "boolean", "patch_error": "string"}
    out = per_tree(scripted, judged, kinds, ids=(*KEY, "distance", "script_error"), given=("a", "b", "ops"))
    out = out.withColumns({"algorithm": F.lit(ted.ALGORITHMS[kind]), "kind": F.lit(kind), "similarity": F.greatest(F.lit(0.0), 1.0 - F.col("distance") / (F.col("n_source") + F.col("n_target"))), "total": F.col("length")})
    text = render.report_text()
    report = F.concat(text, F.lit("\n\n(Patched via Zhang–Shasha postorder alignment.)\n")) if kind == "zhang_shasha" else text
    names = ["algorithm", "kind", "distance", "similarity", "inserts", "deletes", "updates", "maps", "total", "matches_target", "patched", "json", "xml", "infobox"]
    return out.select(*KEY, *names, F.when(F.col("infobox").isNotNull(), report).alias("report"), F.coalesce("script_error", "patch_error").alias("error"))


JUDGED = {"json": "string", "xml": "string", "text": "string", "score": "double", "differences": "long"}


def _judge(seq, b) -> tuple:
    """JUDGED of a patched tree beside its target; without a target there is no score. Nothing left to differ means full similarity."""
    root = ted.tree_of(*seq)
    texts = render.json_of(root), render.xml_of(root), render.infobox_lines(*seq)
    if not b[0]:
        return *texts, None, None
    target = ted.tree_of(*b)
    left = sum(not diff.is_blank_op(o) for o in diff.differences(root, target))
    return *texts, diff.similar(root, target)[2] if left else 1.0, left


def judged_patch(patched: DataFrame) -> DataFrame:
    """source_id, target_id, seq, json, xml, text, score, differences, error: patched sources beside their targets.

    patched: source_id, target_id, seq, b (null where there is no target: then there is no score), error.
    """
    rows = patched.withColumnRenamed("error", "_failed")
    shown = per_tree(rows, lambda seq, b, failed: _judge(seq, b) if failed is None else (None,) * len(JUDGED), JUDGED, ids=(*KEY, "seq", "_failed"), given=("seq", "b", "_failed"), errors=True)
    return shown.select(*KEY, "seq", *JUDGED, F.coalesce("_failed", "error").alias("error"))


def _patched(pairs: DataFrame, patch_of) -> DataFrame:
    """judged_patch of sources patched by the paths that patch_of(source, target) gives: (path, values, is_list); None leaves the pair out."""

    def one(a, b):
        found = patch_of(ted.tree_of(*a), ted.tree_of(*b))
        if found is None:
            return False, *[None] * (1 + len(JUDGED))
        seq = ted.arrays_of(patch.patch_root(ted.tree_of(*a), [(patch.full_path(p), *x) for p, *x in found]))
        return True, seq, *_judge(seq, b)

    made = per_tree(pairs, one, {"_has": "boolean", "seq": SEQ, **JUDGED}, ids=tuple(KEY), given=("a", "b"), errors=True)
    return made.where("_has or error is not null").drop("_has")


def patch_features(trees: DataFrame, wanted: DataFrame, chosen: list[str] | None, excluded: list[str] = ()) -> DataFrame:
    """judged_patch of sources patched by their targets' features: the chosen ones (all leaf paths of both if None) but the excluded."""
    values = patch.values_of_features(chosen, list(excluded))
    return _patched(pair_up(trees, wanted), lambda a, b: [(p, x["vals"], x["is_list"]) for p, x in values(a, b)])


def patch_clean(pairs: DataFrame) -> DataFrame:
    """judged_patch of sources patched by the paths of their semantic diffs. Pairs without one are left out."""
    return _patched(pairs, lambda a, b: patch.paths_of_diff(diff.differences(a, b)) or None)


def patch_script(pairs: DataFrame, scripted: DataFrame, algorithm: str = "chawathe") -> DataFrame:
    """judged_patch of sources with scripts replayed on them: positional, of whole subtrees, or by mapping. See patch.apply_script()."""
    return judged_patch(patch.apply_script(pairs, scripted, algorithm, keep=("b",)).withColumnRenamed("patched", "seq"))


def postprocess(trees: DataFrame) -> DataFrame:
    """tree_id, json, xml, text, error."""
    return per_tree(trees, lambda seq: (render.json_text(seq), render.xml_text(seq), render.infobox_lines(*seq)), {"json": "string", "xml": "string", "text": "string"}, errors=True)


def ingest(pages: DataFrame, retrieved_at: str, source: str = "wikipedia") -> DataFrame:
    """tree_id, seq from pages (slug, name, url, html): parse, normalise, select, build. Pages without an infobox are left out."""
    boxes = html.infoboxes(pages).where("rows is not null")
    rows = boxes.select(F.col("slug").alias("entity"), F.posexplode("rows").alias("pos", "r")).select("entity", "pos", "r.label", "r.value_text")
    values = normalize.comparison(normalize.fields(rows), boxes.select(F.col("slug").alias("entity"), F.col("name").alias("country_name")))
    facts = {"country_name": F.col("name"), "slug": F.col("slug"), "wikipedia_url": F.col("url"), "retrieved_at": F.lit(retrieved_at), "source": F.lit(source)}
    meta = boxes.select(F.col("slug").alias("entity"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in facts.items()])).alias("x")).select("entity", "x.*")
    return normalize.trees(values, meta)
