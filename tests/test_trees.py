"""Tree operators against plain definitions on random trees."""

import json
import random
from functools import lru_cache
from itertools import combinations, product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbordelta.operators import diff, features, patch, ranking, render, ted
from arbordelta.plans.trees import SEQ, nodes, validate

LABELS, VALUES = "abc", ["x", "y", "", None]


def random_seq(rng, n):
    out = [{"label": "r", "value": None, "depth": 0}]
    for _ in range(n - 1):
        out.append({"label": rng.choice(LABELS), "value": rng.choice(VALUES), "depth": rng.randint(1, out[-1]["depth"] + 1)})
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    return [(f"s{i}", f"t{i}", random_seq(rng, rng.randint(1, 9)), random_seq(rng, rng.randint(1, 9))) for i in range(60)]


@pytest.fixture(scope="module")
def pairs(spark, cases):
    return spark.createDataFrame(cases, f"source_id string, target_id string, a {SEQ}, b {SEQ}").cache()


@st.composite
def seqs(draw):
    return random_seq(random.Random(draw(st.integers(0, 10**6))), draw(st.integers(1, 8)))


def chawathe(a, b):
    m, n, inf = len(a), len(b), 10**9

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        x, y = a[i - 1], b[j - 1]
        return min(
            d(i - 1, j) + 1 if j == n or x["depth"] >= y["depth"] else inf,
            d(i, j - 1) + 1 if i == m or y["depth"] >= x["depth"] else inf,
            d(i - 1, j - 1) + ((x["label"], x["value"]) != (y["label"], y["value"])) if x["depth"] == y["depth"] else inf,
        )

    return d(m, n)


def test_native_distance_and_script_length(pairs, cases):
    want = {s: chawathe(a, b) for s, _, a, b in cases}
    assert {r.source_id: r.distance for r in ted.distances(pairs).collect()} == want
    assert {r.source_id: r.distance for r in ted.chawathe_native(pairs).collect()} == want
    assert {r.source_id: r.distance for r in ted.scripts(pairs).collect()} == want


def test_lower_bound(pairs, cases):
    want = {s: chawathe(a, b) for s, _, a, b in cases}
    assert all(r.bound <= want[r.source_id] for r in pairs.select("source_id", ted.lower_bound().alias("bound")).collect())


@pytest.mark.parametrize("algorithm", ["chawathe", "nj", "zhang_shasha"])
def test_patching_a_source_gives_its_target(pairs, cases, algorithm):
    out = {r.source_id: r for r in patch.apply_script(pairs, ted.scripts(pairs, algorithm), algorithm).collect()}
    for s, _, a, b in cases:
        want = ted.to_seq(ted.sort_children(ted.to_tree(b))) if algorithm == "zhang_shasha" else b
        if out[s].error:
            assert algorithm == "zhang_shasha" and "root" in out[s].error
            continue
        got = [x.asDict() for x in out[s].patched]
        if algorithm == "nj":  # it takes null and empty values as equal
            got, want = ([x | {"value": x["value"] or ""} for x in v] for v in (got, want))
        assert got == want


def test_wrong_node_is_an_error(spark):
    a = [{"label": "r", "value": None, "depth": 0}]
    ops = json.dumps([{"op": "delete", "position": 0, "old": {"label": "q", "value": None, "depth": 0}, "new": None}])
    df = spark.createDataFrame([("s", "t", a, ops)], f"source_id string, target_id string, a {SEQ}, ops string")
    with pytest.raises(Exception, match="node mismatch"):
        patch.apply_positional(df).collect()


def _sorted(seq):
    return ted.sort_children(ted.to_tree(seq))


def brute_zhang_shasha(a, b):
    """The cheapest mapping that keeps ancestors and order, by trying all."""
    x, y = ted.preorder(_sorted(a)), ted.preorder(_sorted(b))
    above = lambda t: {(i, j) for i, n in enumerate(t) for j in range(len(t)) if t[j] is not n and any(t[j] is c for c in ted.preorder(n))}
    ax, ay = above(x), above(y)
    best = len(x) + len(y)
    for k in range(1, min(len(x), len(y)) + 1):
        for p, q in product(combinations(range(len(x)), k), combinations(range(len(y)), k)):
            if all(((p[i], p[j]) in ax) == ((q[i], q[j]) in ay) for i in range(k) for j in range(i + 1, k)):
                best = min(best, len(x) + len(y) - 2 * k + sum((x[i].label, x[i].value) != (y[j].label, y[j].value) for i, j in zip(p, q)))
    return best


@settings(max_examples=60, deadline=None)
@given(seqs(), seqs())
def test_zhang_shasha_is_the_cheapest_mapping(a, b):
    a, b = a[:6], b[:6]
    distance, mapped = ted.zhang_shasha(a, b)
    assert distance == brute_zhang_shasha(a, b) == ted.zhang_shasha(b, a)[0]
    assert len(set(mapped)) == len(mapped)


@settings(max_examples=100, deadline=None)
@given(seqs(), seqs())
def test_nj_distance(a, b):
    distance, ops = ted.nj(a, b)
    assert distance == ted.nj(b, a)[0] and ted.nj(a, a) == (0, [])
    cost = {"update": lambda o: 1}
    assert distance <= sum(cost.get(o["op"], lambda o: o["count"])(o) for o in ops)


def brute_nj(a, b):
    """Whole-subtree distance from its definition, by plain recursion over trees as tuples (label, value, children)."""
    tup = lambda n: (n.label, n.value or "", tuple(map(tup, n.children)))
    size = lambda t: 1 + sum(map(size, t[2]))
    every = lambda t: [t, *(x for c in t[2] for x in every(c))]

    @lru_cache(None)
    def matches(x, y):
        """x fits onto y: same node, and x's children fit onto some of y's children in order."""
        if x[:2] != y[:2]:
            return False
        return any(all(map(matches, x[2], some)) for some in combinations(y[2], len(x[2])))

    x, y = tup(ted.to_tree(a)), tup(ted.to_tree(b))
    gone = lru_cache(None)(lambda t: 1 if any(matches(t, n) for n in every(y)) else size(t))
    come = lru_cache(None)(lambda t: 1 if any(matches(t, n) for n in every(x)) else size(t))

    @lru_cache(None)
    def forest(p, q):
        if not p or not q:
            return sum(map(gone, p)) + sum(map(come, q))
        return min(forest(p[:-1], q[:-1]) + tree(p[-1], q[-1]), forest(p[:-1], q) + gone(p[-1]), forest(p, q[:-1]) + come(q[-1]))

    @lru_cache(None)
    def tree(p, q):
        return (p[:2] != q[:2]) + forest(p[2], q[2])

    return tree(x, y)


@settings(max_examples=150, deadline=None)
@given(seqs(), seqs())
def test_nj_is_the_cheapest_by_definition(a, b):
    assert ted.nj(a, b)[0] == brute_nj(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(seqs(), min_size=2, max_size=6))
def test_distances_without_scripts_are_those_of_scripts(trees):
    arrays = [tuple([x[k] for x in t] for k in ("label", "value", "depth")) for t in trees]
    one = {k: make(ted.Names()) for k, make in ted._DISTANCES.items()}
    for a, b in zip(trees, trees[1:]):
        x, y = (arrays[trees.index(t)] for t in (a, b))
        assert (one["chawathe"](x, y), one["nj"](x, y), one["zhang_shasha"](x, y)) == (chawathe(a, b), ted.nj(a, b)[0], ted.zhang_shasha(a, b)[0])


def test_nj_moves_of_contained_subtrees_cost_one():
    leaf = lambda v, d: {"label": "k", "value": v, "depth": d}
    sub = [{"label": "g", "value": None, "depth": 1}, leaf("1", 2), leaf("2", 2)]
    a, b = [{"label": "r", "value": None, "depth": 0}, *sub], [{"label": "r", "value": None, "depth": 0}, *sub, *sub]
    assert ted.nj(a, b)[0] == 1


def test_nodes(spark, cases):
    trees = spark.createDataFrame([(s, a) for s, _, a, _ in cases], f"tree_id string, seq {SEQ}")
    got = {(r.tree_id, r.pre): r for r in nodes(trees).collect()}
    for s, _, a, _ in cases:
        root = ted.to_tree(a)
        post, order = {}, []

        def walk(n):
            for c in n.children:
                walk(c)
            post[n.pre] = len(order)
            order.append(n)

        walk(root)
        for n in ted.preorder(root):
            r = got[s, n.pre]
            assert (r.size, r.post, r.n) == (n.size, post[n.pre], len(a))
            for k, c in enumerate(n.children):
                assert (got[s, c.pre].parent_pre, got[s, c.pre].ordinal, got[s, c.pre].path) == (n.pre, k, [*r.path, c.label])


def plain_similarity(a, b):
    def blank(n):
        return not (n.value or "").strip() if not n.children else all(map(blank, n.children))

    def loose(n):
        return (0 if blank(n) else 2) + sum(map(loose, n.children))

    def score(x, y):
        m, t = (x.label == y.label) + ((x.value or "") == (y.value or "")), 2
        left = list(y.children)
        for c in x.children:
            k = next((k for k, o in enumerate(left) if o.label == c.label), None)
            dm, dt = (0, loose(c)) if k is None else score(c, left.pop(k))
            m, t = m + dm, t + dt
        return m, t + sum(map(loose, left))

    return score(ted.to_tree(a), ted.to_tree(b))


def test_tree_similarity(pairs, cases):
    got = {r.source_id: (r.matches, r.total) for r in diff.tree_similarity(pairs).collect()}
    assert got == {s: plain_similarity(a, b) for s, _, a, b in cases}


T = [("root", None, 0), ("meta", None, 1), ("country_name", "Lebanon", 2), ("fields", None, 1), ("area", None, 2), ("total_km2", "10452", 3), ("water_percent", "1.8", 3), ("economy", None, 2), ("gdp_nominal_total", "18B", 3)]
U = [("root", None, 0), ("meta", None, 1), ("country_name", "Switzerland", 2), ("fields", None, 1), ("area", None, 2), ("total_km2", "41285", 3), ("water_percent", "4.2", 3), ("economy", None, 2), ("gdp_nominal_total", "818B", 3)]


def test_feature_patch_leaves_excluded_paths(spark):
    df = spark.createDataFrame([("s", "t", T, U)], f"source_id string, target_id string, a {SEQ}, b {SEQ}")
    wanted = ["area.total_km2", "area.water_percent", "meta.country_name", "economy.gdp_nominal_total"]  # a name in full stands for both copies
    made = patch.patch_from_features(df, wanted, ["area.total_km2"])
    rows = made.join(df, "source_id").selectExpr("source_id as tree_id", "a as seq", "patch")
    out = patch.apply_paths(rows)
    value = lambda p: (features.lookup(out, p).first() or [None, None])[1]
    assert [value(p) for p in ("fields.area.total_km2", "fields.area.water_percent", "meta.country_name", "fields.country_name", "fields.economy.gdp_nominal_total")] == ["10452", "4.2", "Switzerland", "Switzerland", "818B"]
    assert value("area.total_km2") is None


def test_list_patch_replaces_items_and_none_clears():
    seq = [{"label": "r", "value": None, "depth": 0}, {"label": "fields", "value": None, "depth": 1}, {"label": "tld", "value": None, "depth": 2}, {"label": "tld_item", "value": ".a", "depth": 3}, {"label": "x", "value": "1", "depth": 2}]
    got = patch.patch_tree(seq, [("fields.tld.tld_item", [".b", ".c"], True), ("fields.x", None, False), ("fields.new.leaf", ["v"], False)])
    assert [(n["label"], n["value"], n["depth"]) for n in got] == [("r", None, 0), ("fields", None, 1), ("tld", None, 2), ("tld_item", ".b", 3), ("tld_item", ".c", 3), ("x", None, 2), ("new", None, 2), ("leaf", "v", 3)]


def test_semantic_diff(spark):
    df = spark.createDataFrame([("s", "t", T, [*U[:7], ("population", "1.0", 2)])], f"source_id string, target_id string, a {SEQ}, b {SEQ}")
    ops = diff.semantic_diff(df)
    got = sorted((r.op, ".".join(r.path), r.old_value, r.new_value, r.value) for r in ops.collect())
    assert got == [("delete", "fields.economy", '{"gdp_nominal_total": "18B"}', None, None), ("insert", "fields.population", None, None, "1.0"), ("update", "fields.area.total_km2", "10452", "41285", None), ("update", "fields.area.water_percent", "1.8", "4.2", None)]
    assert {r.category: r.n for r in diff.categorize(ops).collect()} == {"Economy": 1, "Geography": 2, "Population": 1}
    r = diff.summarize(ops).first()
    assert (r.inserts, r.deletes, r.updates, r.total) == (1, 1, 2, 4)


def test_prune_and_render(spark):
    trees = spark.createDataFrame([("s", T)], f"tree_id string, seq {SEQ}")
    kept = features.prune_include(trees, ["fields.area"]).first().seq
    assert [n.label for n in kept] == ["root", "fields", "area", "total_km2", "water_percent"]
    gone = features.prune_exclude(trees, ["fields", "meta"]).first().seq
    assert [(n.label, n.value) for n in gone] == [("root", None)]
    assert render.infobox_text(trees).first().text.split("\n")[:3] == ["{{Infobox country", "| name = Lebanon", "| area.total_km2 = 10452"]
    r = render.documents(trees).first()
    assert json.loads(r.json)["root"]["fields"]["area"] == {"total_km2": "10452", "water_percent": "1.8"}
    assert r.xml.startswith("<root><meta><country_name>Lebanon</country_name></meta><fields>")
    assert "  fields\n    area\n      total_km2 = 10452" in render.indented(trees).first().text
    assert render.drawn(trees).first().text.split("\n")[:3] == ["root", "├── meta", "│   └── country_name = Lebanon"]


def test_drawing_cuts_at_a_depth(spark):
    trees = spark.createDataFrame([("s", [("r", "v", 0), ("a", "x", 1), ("b", "1", 2), ("c", None, 1), ("d", None, 2), ("e", "2", 3)])], f"tree_id string, seq {SEQ}")
    text = lambda df: df.first().text.split("\n")
    assert text(render.drawn(trees)) == ["r = v", "├── a = x", "│   └── b = 1", "└── c", "    └── d", "        └── e = 2"]
    assert text(render.drawn(trees, 1)) == ["r = v", "├── a = x", "│   ...", "└── c", "    ..."]
    assert text(render.drawn(trees, 2, show_root=False)) == ["├── a = x", "│   └── b = 1", "└── c", "    └── d", "        ..."]
    assert text(render.drawn(trees, 0)) == ["r = v", "..."]
    assert text(render.indented(trees)) == ["r: v", "  a: x", "    b = 1", "  c", "    d", "      e = 2"]
    assert text(render.indented(trees, 1)) == ["r: v", "  a: x", "    ...", "  c", "    ..."]
    r = render.documents(trees).first()
    assert json.loads(r.json) == {"r": {"a": {"b": "1", "_value": "x"}, "c": {"d": {"e": "2"}}, "_value": "v"}} and list(json.loads(r.json)["r"])[-1] == "_value"
    assert [render.xml_name(x) for x in (" a b ", "1x", "é-é", "", "a((b")] == ["a_b", "n_1x", "_-_", "node", "a_b"]


def test_values_of_tokens_and_list_places(spark):
    rows = [("r", None, 0), ("fields", None, 1), ("x[0]", None, 2), ("token", "a", 3), ("token", " b", 3), ("x[1]", None, 2), ("value", "9", 3), ("y_item", "1", 2), ("y_item", None, 2), ("y_item", "3", 2)]
    trees = spark.createDataFrame([("s", rows)], f"tree_id string, seq {SEQ}")
    value = lambda p: tuple(features.lookup(trees, p).first())[1:]
    assert [value(p) for p in ("fields.x", "fields.x[1]", "fields.y_item[7]", "fields.z", "fields", "")] == [("a b", True), ("9", True), ("1", True), (None, False), (None, True), (None, False)]
    assert features.lookup_all(trees, "fields.y_item").first()["values"] == ["1", "3"] and features.lookup_all(trees, "fields.x[5]").first()["values"] == ["a b", "9"]


def test_semantic_values_and_operations():
    tree = lambda *rows: ted.tree_of(*map(list, zip(("r", None, 0), *rows)))
    a = tree(("fields", None, 1), ("langs", None, 2), ("langs_item", "1.50", 3), ("langs_item", "b", 3), ("words", None, 2), ("token", "x", 3), ("token", "y", 3), ("n", " 07 ", 2), ("gone", " ", 2), ("m", None, 2), ("token", "x", 3), ("value", "1", 3))
    b = tree(("fields", None, 1), ("n", "7", 2), ("words", None, 2), ("value", "2", 3), ("value", "c", 3), ("m", None, 2), ("token", "z", 3), ("value", "1", 3))
    got = diff.differences(a, b)
    assert got == [
        {"op": "delete", "path": ["fields", "gone"], "old_value": ""}, {"op": "delete", "path": ["fields", "langs"], "old_value": {"langs": [1.5, "b"]}},
        {"op": "update", "path": ["fields", "m", "token"], "old_value": "x", "new_value": "z"}, {"op": "update", "path": ["fields", "words"], "old_value": "x y", "new_value": [2, "c"]},
    ]
    assert [diff.is_blank_op(o) for o in got] == [True, False, False, False]
    assert diff.human(got).split("\n") == ["- Gone: ∅", "- Langs: Langs: 1.5, b", "- Token: x", "+ Token: z", "- Words: x y", "+ Words: 2, c"]
    assert diff.structured(got[:1]) == "❌ DELETE — Gone\n   - Value: ∅"
    ops = [{"op": "update", "path": ["a", "b[1]"], "old_label": "b", "new_label": "c", "old_value": 1, "new_value": 2}, {"op": "update", "path": ["a"], "old_node": {"label": "a"}, "new_node": {"label": "a"}, "old_value": 1, "new_value": 2}]
    want = [{"op": "delete", "path": ["a", "b[1]"], "old_value": 1}, {"op": "insert", "path": ["a", "c[1]"], "value": 2}, {"op": "update", "path": ["a"], "old_value": 1, "new_value": 2}]
    assert diff.split_renamed(ops) == want and diff.distinct_ops(want + want) == want


def test_normalized_scripts_leave_ignored_paths_unplayed():
    n = lambda label, value, depth: {"label": label, "value": value, "depth": depth}
    a = [n("r", None, 0), n("slug", "1", 1), n("x", "2", 1)]
    ops = [{"op": "insert", "position": 1, "old": None, "new": n("source", "s", 1)}, {"op": "delete", "position": 1, "old": a[1], "new": None}, {"op": "update", "position": 2, "old": a[2], "new": n("y", "2", 1)}]
    assert [(o["op"], o["position"]) for o in patch.normalize_script(a, ops)] == [("delete", 2), ("insert", 2)]
    nj = [{"op": "update", "old": ["slug", "1"], "new": ["slug", "2"]}, {"op": "delete_tree", "subtree": a[2:]}, {"op": "insert_tree", "subtree": a[1:2]}]
    assert patch.normalize_nj_script(nj) == nj[1:2]


def test_a_bad_row_has_an_error_and_the_others_stay(spark):
    two = [("a", None, 0), ("b", None, 0)]
    trees = spark.createDataFrame([("bad", two), ("good", T)], f"tree_id string, seq {SEQ}")
    assert {r.tree_id: r.error and r.error.split(":")[0] for r in render.documents(trees).collect()} == {"bad": "ValueError", "good": None}
    pairs = spark.createDataFrame([("s", "bad", T, two), ("s", "good", T, U)], f"source_id string, target_id string, a {SEQ}, b {SEQ}")
    for algorithm in ("nj", "zhang_shasha"):
        assert {r.target_id: r.distance is None for r in ted.distances(pairs, algorithm).collect()} == {"bad": True, "good": False}


def test_validate(spark):
    bad = [("empty", []), ("roots", [("a", None, 0), ("b", None, 0)]), ("blank", [("a", None, 0), (" ", None, 1)]), ("fine", T)]
    got = {r.tree_id: r.error for r in validate(spark.createDataFrame(bad, f"tree_id string, seq {SEQ}")).collect()}
    assert got == {"empty": "empty tree", "roots": "more than one root", "blank": "blank label", "fine": None}


def test_ranking_breaks_ties_by_id(spark):
    trees = spark.createDataFrame([("q", T), ("b", U), ("a", U), ("c", T)], f"tree_id string, seq {SEQ}")
    assert [r.tree_id for r in ranking.rank(trees, "q", 3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_queries_match_their_sql(spark):
    from arbordelta import queries, queries_documents

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "orders", "part", "events", "documents", "nation", "conversations", "supplier", "pages"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    made = queries.QUERIES | queries_documents.QUERIES
    for name, sql in (queries.SQL | queries_documents.SQL).items():
        got, want = made[name](spark, d).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)
        rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))  # noqa: E731, B023
        assert rows(got) == rows(want), name
