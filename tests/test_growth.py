"""What the tree queries' plans and passes must keep to so that they grow no faster than their tables."""

import json
import random
import re
import time

import pytest

import __spark_entry__
from arbordelta.functions import text
from arbordelta.operators import diff, patch, ted
from arbordelta.plans.trees import SEQ

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ted_nj_parts", "ted_zhang_shasha_parts", "scripts_parts", "scripts_nj_parts", "mappings_parts", "ted_chawathe_pairs"])
def test_trees_are_never_broadcast(spark, name):
    """A small file makes many trees: Spark would copy them to the driver and every executor."""
    assert "BroadcastExchange" not in plan_of(__spark_entry__.queries()[name](spark, SF))


def test_pages_of_suppliers_beyond_a_thousand(spark, tmp_path):
    """Their figures have commas between all thousands, so they are read whole."""
    keys = [0, 7, 999, 1000, 1234, 5999, 1234567]
    supplier = spark.createDataFrame([(k, f"Supplier#{k:09d}", 1, 0.0) for k in keys], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    rows = __spark_entry__.queries()["ingest_pages"](spark, str(tmp_path)).where("path in ('fields.area.total_km2', 'fields.population.total')").collect()
    want = {(f"s{k:09d}", p): str(k * 1000 + n) for k in keys for p, n in (("fields.area.total_km2", 452), ("fields.population.total", 1000482))}
    assert {(r.tree_id, r.path): r.value for r in rows} == want


def odd_trees():
    """Random trees, with depths that leave levels out, and trees that are missing, empty or have no root."""
    rng = random.Random(11)

    def one(n):
        out = [{"label": "r", "value": None, "depth": 0}]
        for _ in range(n - 1):
            out.append({"label": rng.choice(["a", "b", "é\""]), "value": rng.choice(["x", "y", "", None]), "depth": rng.randint(1, out[-1]["depth"] + rng.choice([1, 1, 2]))})
        return out

    trees = [one(rng.randint(1, rng.choice([3, 12, 40]))) for _ in range(300)]
    trees[17], trees[40], trees[60] = [], [{"label": "r", "value": None, "depth": 0}] * 2, [{"label": "r", "value": None, "depth": 0}, {"label": "a", "value": None, "depth": None}]
    return trees


@pytest.mark.parametrize("algorithm", ["chawathe", "nj", "zhang_shasha"])
def test_scripts_of_many_pairs_are_those_of_one(spark, algorithm):
    """Distances and scripts of batches equal the plain functions on two lists of nodes, bad pairs among them."""
    trees = odd_trees()
    rows = [(f"s{i}", f"t{i}", a, b) for i, (a, b) in enumerate(zip(trees, trees[1:]))] + [("none", "t", None, trees[0])]
    plain = {"chawathe": ted._with_script, "nj": ted.nj, "zhang_shasha": ted.zhang_shasha}[algorithm]
    pairs = spark.createDataFrame(rows, f"source_id string, target_id string, a {SEQ}, b {SEQ}")
    got = {r.source_id: r for r in ted.scripts(pairs, algorithm, keep=("a",)).collect()}
    scores = {r.source_id: r.distance for r in ted.distances(pairs, algorithm).collect()}
    for s, _, a, b in rows:
        try:
            distance, ops = plain(a, b)
            assert (got[s].distance, got[s].ops, got[s].error) == (distance, json.dumps(ops, ensure_ascii=False), None)
            assert scores[s] == (distance if a and b else None)
        except (ValueError, IndexError, TypeError) as e:
            assert (got[s].distance, got[s].ops, got[s].error) == (None, None, f"{type(e).__name__}: {e}") and scores[s] is None


def test_depths_of_a_long_tree_are_one_pass(spark):
    """Replaying a script on a tree of 3,000 nodes: depths were once compared with all nodes between, for each pair of nodes."""
    tree = lambda n: [("r", None, 0)] + [("x", str(k), 1 + k % 2) for k in range(n)]
    pairs = spark.createDataFrame([("s", "t", tree(2000), tree(1999))], f"source_id string, target_id string, a {SEQ}, b {SEQ}")
    scripted = spark.createDataFrame([("s", "t", json.dumps([{"op": "delete", "position": 2000, "old": {"label": "x", "value": "1999", "depth": 2}, "new": None}]), None)], "source_id string, target_id string, ops string, error string")
    began = time.time()
    (r,) = patch.apply_script(pairs, scripted).collect()
    assert [tuple(x) for x in r.patched] == tree(1999) and r.error is None and time.time() - began < 30


def test_keys_and_tokens_of_all_characters(spark):
    """Letters and digits are ASCII's; what separates them is not told by a negated class, for which Java takes 25 times as long."""
    said = ["".join(chr(k) + "a" for k in range(1, 0x250)), "Ab-\u00e9_9\u0660 \U0001f504x__y", "\u212a\u0130", "", "_"]
    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.normalize_key("s").alias("key"), text.tokenize("s").alias("tokens"))
    for r in df.collect():
        assert r.tokens == re.findall("[0-9A-Za-z]+", r.s)
        assert r.key == ("_".join(re.findall("[0-9a-z]+", r.s.lower())) or "field")
    assert "[^0-9" not in plan_of(df)


@pytest.mark.parametrize("name", ["full_diff", "patch_script", "feature_patch", "patch_clean_diff", "script_normalized", "script_normalized_nj", "script_summary_parts", "equal_trees", "patch_round_trip_nj"])
def test_a_pair_is_joined_once(spark, name):
    """A pair's row goes through all passes: only the neighbours are joined (once for each algorithm), and no tree is broadcast."""
    plan = plan_of(__spark_entry__.queries()[name](spark, SF))
    algorithms = 3 if name in ("full_diff", "patch_script", "script_summary_parts") else 1
    orders = name == "patch_round_trip_nj"  # each side's customers are joined with their orders
    assert len(re.findall(r"\w+Join \[", plan)) == algorithms + 2 * orders and "BroadcastExchange" not in plan


@pytest.mark.parametrize("name", ["compare_parts", "patch_all_features", "semantic_diff", "semantic_summary"])
def test_wanted_pairs_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan_of(__spark_entry__.queries()[name](spark, SF))


def test_patches_and_counts_of_rows_are_those_of_tables(spark):
    """What the passes work out of a pair's operations equals what the tables of operations give."""
    trees = [t for t in odd_trees() if len(t) > 1 and all(n["depth"] is not None for n in t) and t[1]["depth"]]
    rows = [(f"s{i}", f"t{i}", a, b) for i, (a, b) in enumerate(zip(trees[:80], trees[1:]))]
    pairs = spark.createDataFrame(rows, f"source_id string, target_id string, a {SEQ}, b {SEQ}")
    made = {r.source_id: [(k, v.vals, v.is_list) for k, v in sorted(r.patch.items())] for r in patch.diff_to_patch(diff.semantic_diff(pairs)).collect()}
    for s, _, a, b in rows:
        assert patch.paths_of_diff(diff.differences(ted.to_tree(a), ted.to_tree(b))) == made.get(s, [])
    for algorithm in ("chawathe", "nj", "zhang_shasha"):
        scripted = ted.scripts(pairs, algorithm)
        ops = {r.source_id: json.loads(r.ops) for r in scripted.collect()}
        for r in patch.summarize_script(scripted).collect():
            assert patch.counts_of(ops[r.source_id]) == tuple(r[n] for n in patch.COUNTS)
