"""Queries over documents, pages and pairs of one shape, whose results SQL can say from the tables they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import diff, features, patch, render, ted
from .plans import api
from .plans.datasets import CUSTOMER_SQL, PART_SQL, SUPPLIER_SQL, customer_trees, neighbours, part_pairs, part_trees, read, supplier_documents
from .plans.trees import nodes, per_tree, validate
from .queries import _AS_TEXT, _PAIRS, _as_text, _sql
from .sources import codec, html, store

KEY = ["source_id", "target_id"]
_PART_PAIRS = (PART_SQL, _PAIRS.format(t="parts"))
_DIFFERS = "len(list_filter(list_zip(a, b), lambda z: z[1].value IS DISTINCT FROM z[2].value))"
#: The places of the leaves of a part's tree that a semantic diff reports.
_FIELDS = {5: "brand", 6: "name", 7: "size", 8: "type"}
_FIELD_DIFFERS = " + ".join(f"(a[{i}].value <> b[{i}].value)::BIGINT" for i in _FIELDS)


def _documents(spark, sf_dir):
    return codec.trees_of_documents(supplier_documents(spark, sf_dir))


# ---- trees from and as JSON ----
def document_trees(spark, sf_dir):
    return _as_text(_documents(spark, sf_dir))


DOCUMENT_SQL = _sql(SUPPLIER_SQL, then=f"SELECT tree_id, {_AS_TEXT.format(s='seq')} AS tree FROM suppliers")


def tree_json(spark, sf_dir):
    return codec.to_json(part_trees(spark, sf_dir))


_OBJECT = """'{"label": "' || {l} || '", "value": ' || {v} || ', "children": [' || {c} || ']}'"""


def _object(label: str, value: str = "'null'", children: str = "''") -> str:
    return _OBJECT.replace("{l}", label).replace("{v}", value).replace("{c}", children)


_quoted = "'\"' || {} || '\"'".format
TREE_JSON_SQL = _sql(
    PART_SQL,
    then="SELECT tree_id, " + _object("'part'", children=_object("'meta'", children=_object("'slug'", _quoted("tree_id"))) + " || ', ' || " + _object("'fields'", children=" || ', ' || ".join(_object(f"seq[{i}].label", _quoted(f"seq[{i}].value")) for i in _FIELDS))) + " AS json FROM parts",
)


def json_trees(spark, sf_dir):
    return _as_text(codec.from_json(codec.to_json(customer_trees(spark, sf_dir))))


JSON_TREES_SQL = _sql(CUSTOMER_SQL, then=f"SELECT tree_id, {_AS_TEXT.format(s='seq')} AS tree FROM customers")


def json_elements(spark, sf_dir):
    return render.plain_xml(read(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "xml")


ELEMENTS_SQL = "SELECT event_id, '<root><k>' || (props->>'$.k') || '</k></root>' AS xml FROM events"


# ---- validation: one customer in five is sound, the others each have a fault ----
def validate_trees(spark, sf_dir):
    trees = customer_trees(spark, sf_dir).withColumn("k", F.regexp_extract("tree_id", "([0-9]+)$", 1).cast("long") % 5)
    fault = lambda k, i, x: (F.col("k") == k) & (i == x)
    broken = F.transform(
        "seq",
        lambda x, i: F.struct(
            F.when(fault(1, i, 1), " ").otherwise(x["label"]).alias("label"), x["value"].alias("value"),
            F.when(fault(2, i, 3), 0).when(fault(3, i, 0), 1).when(fault(4, i, 2), 300).otherwise(x["depth"]).alias("depth"),
        ),
    )
    return validate(trees.select("tree_id", broken.alias("seq")))


VALIDATE_SQL = _sql(
    CUSTOMER_SQL,
    "k AS (SELECT *, regexp_extract(tree_id, '([0-9]+)$', 1)::BIGINT % 5 AS k FROM customers)",
    then="SELECT tree_id, len(seq)::INT AS n, CASE WHEN k = 4 THEN 300 ELSE list_max(list_transform(seq, lambda x: x.depth)) END::INT AS depth, CASE k WHEN 1 THEN 'blank label' WHEN 2 THEN 'more than one root' WHEN 3 THEN 'the first node is not a root' WHEN 4 THEN 'too deep' END AS error FROM k",
)


# ---- distances and scripts of parts: trees of one shape, so a distance is the number of leaves that differ ----
def ted_nj_parts(spark, sf_dir):
    return ted.distances(part_pairs(spark, sf_dir), "nj")


def ted_zhang_shasha_parts(spark, sf_dir):
    return ted.distances(part_pairs(spark, sf_dir), "zhang_shasha")


PART_TED_SQL = _sql(*_PART_PAIRS, f"d AS (SELECT source_id, target_id, {_DIFFERS}::INT AS distance FROM pairs)", then="SELECT source_id, target_id, 8 AS n_source, 8 AS n_target, distance, 1.0::DOUBLE - distance::DOUBLE / 16 AS similarity FROM d")


def scripts_parts(spark, sf_dir):
    """Each operation of the positional scripts: place, labels and values."""
    ops = F.explode(F.from_json("ops", patch.OPS)).alias("o")
    rows = ted.scripts(part_pairs(spark, sf_dir)).select(*KEY, ops)
    return rows.select(*KEY, "o.op", "o.position", F.col("o.old.label").alias("label"), F.col("o.old.value").alias("old_value"), F.col("o.new.value").alias("new_value"))


SCRIPTS_SQL = _sql(
    *_PART_PAIRS, "leaves AS (SELECT source_id, target_id, unnest(range(1, 9)) AS i, a, b FROM pairs)",
    then="SELECT source_id, target_id, 'update' AS op, (i - 1)::INT AS position, a[i].label AS label, a[i].value AS old_value, b[i].value AS new_value FROM leaves WHERE a[i].value IS DISTINCT FROM b[i].value",
)


def scripts_nj_parts(spark, sf_dir):
    ops = F.explode(F.from_json("ops", "array<struct<op:string,ref:string,old:array<string>,new:array<string>,note:string>>")).alias("o")
    rows = ted.scripts(part_pairs(spark, sf_dir), "nj").select(*KEY, ops)
    return rows.select(*KEY, "o.op", "o.ref", F.col("o.old")[1].alias("old_value"), F.col("o.new")[1].alias("new_value"), "o.note")


SCRIPTS_NJ_SQL = _sql(
    *_PART_PAIRS, "leaves AS (SELECT source_id, target_id, unnest(range(1, 9)) AS i, a, b FROM pairs)",
    then="SELECT source_id, target_id, 'update' AS op, 's' || (i - 1) AS ref, a[i].value AS old_value, b[i].value AS new_value, 'Upd(R(s' || (i - 1) || '), t' || (i - 1) || ')' AS note FROM leaves WHERE a[i].value IS DISTINCT FROM b[i].value",
)


def mappings_parts(spark, sf_dir):
    """The number of mapped nodes of each pair, and of those whose postorder numbers are the same."""
    maps = F.from_json("ops", "array<array<int>>")
    return ted.scripts(part_pairs(spark, sf_dir), "zhang_shasha").select(*KEY, F.size(maps).alias("mapped"), F.size(F.filter(maps, lambda p: p[0] == p[1])).alias("same"))


MAPPINGS_SQL = _sql(*_PART_PAIRS, then="SELECT source_id, target_id, 8 AS mapped, 8 AS same FROM pairs")


def _normalized(spark, sf_dir, algorithm):
    pairs = part_pairs(spark, sf_dir)
    kinds = {"chawathe": patch.OPS, "nj": "array<struct<op:string>>"}
    done = patch.normalized_scripts(pairs, ted.scripts(pairs, algorithm, keep=("a",)), algorithm)
    return done.select(*KEY, F.size(F.from_json("ops", kinds[algorithm])).cast("long").alias("n"), "error", *([F.array_join(F.transform(F.from_json("ops", patch.OPS), lambda o: F.concat_ws(":", o["op"], o["position"].cast("string"), o["new"]["label"])), ",").alias("steps")] if algorithm == "chawathe" else []))


def script_normalized(spark, sf_dir):
    return _normalized(spark, sf_dir, "chawathe")


def script_normalized_nj(spark, sf_dir):
    return _normalized(spark, sf_dir, "nj")


NORMALIZED_SQL = _sql(*_PART_PAIRS, then=f"SELECT source_id, target_id, {_FIELD_DIFFERS} AS n, NULL::VARCHAR AS error, concat_ws(',', " + ", ".join(f"CASE WHEN a[{i}].value <> b[{i}].value THEN 'update:{i - 1}:{k}' END" for i, k in _FIELDS.items()) + ") AS steps FROM pairs")
NORMALIZED_NJ_SQL = _sql(*_PART_PAIRS, then=f"SELECT source_id, target_id, {_FIELD_DIFFERS} AS n, NULL::VARCHAR AS error FROM pairs")


def script_summary_parts(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir)
    made = [patch.summarize_script(ted.scripts(pairs, a)).withColumn("algorithm", F.lit(a)) for a in ("chawathe", "nj", "zhang_shasha")]
    return made[0].unionByName(made[1]).unionByName(made[2])


SCRIPT_SUMMARY_SQL = _sql(
    *_PART_PAIRS, f"d AS (SELECT source_id, target_id, algorithm, CASE WHEN algorithm = 'zhang_shasha' THEN 0 ELSE {_DIFFERS} END AS d FROM pairs, (VALUES ('chawathe'), ('nj'), ('zhang_shasha')) v(algorithm))",
    then="SELECT source_id, target_id, 0::BIGINT AS inserts, 0::BIGINT AS deletes, d::BIGINT AS updates, CASE WHEN algorithm = 'zhang_shasha' THEN 8 ELSE 0 END::BIGINT AS maps, d::BIGINT AS length, 0::BIGINT AS deleted_nodes, 0::BIGINT AS inserted_nodes, algorithm FROM d",
)


# ---- full diffs, patches, texts ----
_LINES = " || chr(10) || ".join(f"'| {k} = ' || {{s}}[{i}].value" for i, k in _FIELDS.items())


def _infobox(side: str, title: str) -> str:
    return "'{{Infobox country' || chr(10) || '| name = ' || " + title + " || chr(10) || " + _LINES.replace("{s}", side) + " || chr(10) || '}}'"


def full_diff(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir)
    made = [api.full_diff(pairs, a).select(*KEY, "kind", "distance", "similarity", "updates", "matches_target", "report", "error") for a in ("chawathe", "nj", "zhang_shasha")]
    return made[0].unionByName(made[1]).unionByName(made[2])


_NJ_STEPS = "chr(10) || array_to_string(list_transform(steps, lambda x, k: '  ' || k || '. Upd(R(s' || (x - 1) || '), t' || (x - 1) || ')'), chr(10))"
FULL_DIFF_SQL = _sql(
    *_PART_PAIRS,
    f"d AS (SELECT *, {_DIFFERS} AS d, list_filter(range(1, 9), lambda i: a[i].value IS DISTINCT FROM b[i].value) AS steps FROM pairs, (VALUES ('chawathe', 'chawathe_ld_pair_ted'), ('nj', 'Nierman & Jagadish (2002)'), ('zhang_shasha', 'zhang_shasha')) v(kind, algorithm))",
    "n AS (SELECT *, CASE WHEN kind = 'zhang_shasha' THEN 0 ELSE d END AS u FROM d)",
    then=f"""SELECT source_id, target_id, kind, d::INT AS distance, 1.0::DOUBLE - d::DOUBLE / 16 AS similarity, u::BIGINT AS updates, true AS matches_target,
  'Comparison: ' || source_id || ' -> ' || target_id || chr(10) || 'Algorithm: ' || algorithm || chr(10) || 'Distance: ' || d || chr(10) || 'Similarity: ' || format('{{:.4f}}', 1.0::DOUBLE - d::DOUBLE / 16) || chr(10) || chr(10) || 'Edit script summary:' || chr(10) ||
  CASE WHEN kind = 'nj' THEN '- model: nierman_jagadish_subtree' || chr(10) || '- update: ' || u || chr(10) || '- insert_tree: 0' || chr(10) || '- delete_tree: 0' || chr(10) || '- total_operations: ' || u || chr(10) || '- nodes_in_deleted_subtrees: 0' || chr(10) || '- nodes_in_inserted_subtrees: 0' || chr(10) || '- subtree_node_volume: 0' || chr(10) || chr(10) || '{render.NOTES["nj"]}'
    ELSE '- model: chawathe_ld_pair_sequence' || chr(10) || '- insert: 0' || chr(10) || '- delete: 0' || chr(10) || '- update: ' || u || chr(10) || '- total_operations: ' || u || chr(10) || '- each_operation_is_one_preorder_node: True' END || chr(10) || '- total: ' || u || chr(10) ||
  CASE WHEN kind = 'nj' THEN chr(10) || 'Operations:' || {_NJ_STEPS} || chr(10) ELSE '' END || chr(10) || 'Patched infobox:' || chr(10) || {_infobox('b', 'b[3].value')} || CASE WHEN kind = 'zhang_shasha' THEN chr(10) || chr(10) || '(Patched via Zhang–Shasha postorder alignment.)' || chr(10) ELSE '' END AS report, NULL::VARCHAR AS error FROM n""",
)


def compare_parts(spark, sf_dir):
    trees = part_trees(spark, sf_dir)
    wanted = neighbours(trees).select(*KEY)
    return api.compare(trees, wanted, ["meta", "fields.size"], exclude=True, root_label="infobox").select(*KEY, "distance", "similarity", "updates", "total", "text", "structured", "algorithm")


_NO_SIZE = {i: k for i, k in _FIELDS.items() if k != "size"}


def _texts(first: str, second: str) -> str:
    return ", ".join(f"CASE WHEN a[{i}].value <> b[{i}].value THEN " + first.format(k=k.title(), i=i) + " || " + second.format(k=k.title(), i=i) + " END" for i, k in _NO_SIZE.items())


COMPARE_SQL = _sql(
    *_PART_PAIRS, "d AS (SELECT *, " + " + ".join(f"(a[{i}].value <> b[{i}].value)::BIGINT" for i in _NO_SIZE) + " AS d FROM pairs)",
    then="SELECT source_id, target_id, d::INT AS distance, 1.0::DOUBLE - d::DOUBLE / 10 AS similarity, d AS updates, d AS total, concat_ws(chr(10), " + _texts("'- {k}: ' || a[{i}].value || chr(10)", "'+ {k}: ' || b[{i}].value")
    + ") AS text, concat_ws(chr(10) || chr(10), " + _texts("'🔄 UPDATE — {k}' || chr(10) || '   - Old: ' || a[{i}].value || chr(10)", "'   + New: ' || b[{i}].value") + ") AS structured, 'chawathe_ld_pair_ted' AS algorithm FROM d",
)


def patch_all_features(spark, sf_dir):
    """All features but the brand: what is left differs in the brand only."""
    trees = part_trees(spark, sf_dir)
    return api.patch_features(trees, neighbours(trees).select(*KEY), None, ["brand"]).select(*KEY, "text", "score", "differences", "error")


_PATCHED = "list_concat(b[1:4], [a[5]], b[6:8])"
PATCH_ALL_SQL = _sql(
    *_PART_PAIRS, f"d AS (SELECT source_id, target_id, {_PATCHED} AS p, (a[5].value <> b[5].value)::BIGINT AS d FROM pairs)",
    then=f"SELECT source_id, target_id, {_infobox('p', 'p[3].value')} AS text, 1.0::DOUBLE - d::DOUBLE / 16 AS score, d AS differences, NULL::VARCHAR AS error FROM d",
)


def patch_clean_diff(spark, sf_dir):
    """Patched by the semantic diff, which never reports the slug."""
    return api.patch_clean(part_pairs(spark, sf_dir).where("a <> b")).select(*KEY, "text", "score", "differences", "error")


PATCH_CLEAN_SQL = _sql(*_PART_PAIRS, then=f"SELECT source_id, target_id, {_infobox('b', 'a[3].value')} AS text, 1.0::DOUBLE AS score, 0::BIGINT AS differences, NULL::VARCHAR AS error FROM pairs WHERE {_FIELD_DIFFERS} > 0")


def patch_script(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir)
    made = [api.patch_script(pairs, ted.scripts(pairs, a, keep=("a", "b")), a).select(*KEY, F.lit(a).alias("algorithm"), "json", "differences", "error") for a in ("chawathe", "nj", "zhang_shasha")]
    done = made[0].unionByName(made[1]).unionByName(made[2])
    return done.withColumn("json", F.get_json_object("json", "$.part.fields.name"))


PATCH_SCRIPT_SQL = _sql(*_PART_PAIRS, then="SELECT source_id, target_id, algorithm, b[6].value AS json, 0::BIGINT AS differences, NULL::VARCHAR AS error FROM pairs, (VALUES ('chawathe'), ('nj'), ('zhang_shasha')) v(algorithm)")


def equal_trees(spark, sf_dir):
    """Whether neighbouring parts are equal but for their ids."""
    pairs = neighbours(features.prune_exclude(part_trees(spark, sf_dir), ["meta", "fields.name"]))
    return per_tree(pairs, lambda a, b: (diff.equal(a, b), diff.equal(a, b, "chawathe")), {"equal": "boolean", "equal_pairs": "boolean"}, ids=tuple(KEY), given=("a", "b"))


EQUAL_SQL = _sql(*_PART_PAIRS, "d AS (SELECT source_id, target_id, a[5] = b[5] AND a[7] = b[7] AND a[8] = b[8] AS e FROM pairs)", then="SELECT source_id, target_id, e AS equal, e AS equal_pairs FROM d")


def cleaned_ops(spark, sf_dir):
    """Operations as JSON: a renamed field, a repeat and meta's copy of the name."""
    p = read(spark, sf_dir, "part")
    op = lambda body: F.concat(F.lit('{"op": "update", '), body, F.lit("}"))
    size = F.concat(F.lit('"path": ["fields", "size[1]"], "old_label": "size", "new_label": "width", "old_value": '), F.col("p_size").cast("string"), F.lit(', "new_value": 1'))
    name = F.concat(F.lit('"path": ["meta", "country_name"], "old_value": "x", "new_value": "'), F.col("p_name"), F.lit('"'))
    brand = F.concat(F.lit('"path": ["fields", "brand"], "old_value": "'), F.col("p_brand"), F.lit('", "new_value": null'))
    return diff.cleaned_ops(p.select("p_partkey", F.concat(F.lit("["), F.array_join(F.array(op(size), op(name), op(brand), op(brand)), ", "), F.lit("]")).alias("ops")), ("p_partkey",))


CLEANED_SQL = """SELECT p_partkey, '[{"op": "delete", "path": ["fields", "size[1]"], "old_value": ' || p_size || '}, {"op": "insert", "path": ["fields", "width[1]"], "value": 1}, {"op": "update", "path": ["fields", "brand"], "old_value": "' || p_brand || '", "new_value": null}]' AS ops, NULL::VARCHAR AS error FROM part"""


# ---- documents: pairs with sections that are there on one side only ----
def _document_pairs(spark, sf_dir):
    return neighbours(_documents(spark, sf_dir).select("tree_id", "seq"))


def document_diff(spark, sf_dir):
    return diff.summarize(diff.without_empty(diff.semantic_diff(_document_pairs(spark, sf_dir))))


# Even ids have one list item, odd ones two, of which one is blank: one item against two is a delete and two inserts, or the reverse.
_DOCUMENT_PAIRS = (SUPPLIER_SQL, "p AS (SELECT x.tree_id AS source_id, y.tree_id AS target_id, x.k, x.nk <> y.nk AS nation, x.k % 3 = 0 OR y.k % 3 = 0 AS government FROM suppliers x JOIN suppliers y ON y.k = x.k + 1)")
_ECONOMY = {"update": "(k % 4 < 2)::BIGINT", "delete": "(k % 4 = 2)::BIGINT", "insert": "(k % 4 = 3)::BIGINT"}
_UPDATES = f"3 + 2 * nation::BIGINT + government::BIGINT + {_ECONOMY['update']}"
DOCUMENT_DIFF_SQL = _sql(
    *_DOCUMENT_PAIRS, f"c AS (SELECT source_id, target_id, 1 + {_ECONOMY['insert']} AS inserts, 1 + {_ECONOMY['delete']} AS deletes, {_UPDATES} AS updates FROM p)",
    then="SELECT source_id, target_id, inserts, deletes, updates, inserts + deletes + updates AS total FROM c",
)


def diff_categories(spark, sf_dir):
    return diff.categorize(diff.semantic_diff(_document_pairs(spark, sf_dir)))


CATEGORIES_SQL = _sql(
    *_DOCUMENT_PAIRS,
    "c AS (SELECT sum(1)::BIGINT AS economy, sum(government::BIGINT)::BIGINT AS government, sum(1 + nation::BIGINT)::BIGINT AS area, sum(5 + nation::BIGINT)::BIGINT AS others FROM p)",
    then="SELECT category, n FROM (SELECT unnest(['Economy', 'Government', 'Geography', 'Others']) AS category, unnest([economy, government, area, others]) AS n FROM c) WHERE n > 0",
)


def value_lookup(spark, sf_dir):
    """Look-ups with list places that aren't there, groups and lists."""
    trees = _documents(spark, sf_dir).select("tree_id", "seq")
    one = lambda name, path: features.lookup(trees, path).select("tree_id", F.col("value").alias(name), F.col("found").alias(f"has_{name}"))
    all_ = features.lookup_all(trees, "fields.languages[0].languages_item[4]").select("tree_id", F.array_join("values", "+").alias("languages"))
    return one("domain", "fields.internet_tld.internet_tld_item[9]").join(one("gdp", "fields.economy.gdp_nominal_total"), "tree_id").join(one("area", "fields.area"), "tree_id").join(all_, "tree_id")


VALUE_LOOKUP_SQL = _sql(SUPPLIER_SQL, then="SELECT tree_id, 's' || nk AS domain, true AS has_domain, CASE WHEN k % 4 <> 3 THEN (k + 1) || '.500 billion' END AS gdp, k % 4 <> 3 AS has_gdp, NULL::VARCHAR AS area, true AS has_area, 'l' || (k % 4) || '+en' AS languages FROM suppliers")


# ---- pages ----
def _built_pages(spark, sf_dir, grouped=False):
    """An infobox page of each supplier. Its figures are the key's digits put before others, as infobox_rows compares the text;
    grouped: commas stand between thousands whatever the key, so that they can be read as numbers.
    """
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    thousands = lambda more: F.format_number(F.col("s_suppkey") * 1000 + more, 0)
    area, people = (thousands(452), thousands(1_000_482)) if grouped else (F.concat(k, F.lit(",452")), F.concat(F.lit("1,"), F.lpad(k, 3, "0"), F.lit(",482")))
    row = lambda label, *value: F.concat(F.lit(f"<tr><th>{label}</th><td>"), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit("</td></tr>"))
    head = lambda label: F.lit(f'<tr><th class="infobox-header">{label}</th></tr>')
    body = F.concat(
        F.lit('<p>x</p><table class="other"><tr><th>No</th><td>no</td></tr></table><table class="infobox vcard"><tbody><tr><th colspan="2">Top</th></tr>'),
        row("Capital", "City ", k, ' 33°54′N 35°32′E<sup class="reference">[1]</sup>'), row("Official languages", "Arabic, L", k), row("Government", "Unitary &amp; republic"),
        F.lit('<tr style="display:none"><th>Hidden</th><td>1</td></tr>'), head("Area"), row("• Total", area, " km2 (161st)"), row("• Water (%)", "1.8"),
        head("Population"), row("• 2023 estimate", people, " (118th)"), row("GDP (nominal)", "2022 estimate"), row("• Total", "$ ", k, ".2 billion (104th)"), row("• Per capita", "$ 1,000"),
        row("HDI (2022)", "0.723 high (109th)"), row("Gini (2011)", "31.8"), row("Currency", "Pound ", k, " (LBP)"), row("Calling code", "+96", k), row("Internet TLD", ".lb"), row("Time zone", "UTC +2 (EET)"), row("Empty", ""), F.lit("</tbody></table>"),
    )
    slug = F.concat(F.lit("s"), F.lpad(k, 9, "0"))
    return s.select(slug.alias("slug"), F.col("s_name").alias("name"), F.concat(F.lit("http://w/"), k).alias("url"), body.alias("html"))


def infobox_rows(spark, sf_dir):
    rows = html.infoboxes(_built_pages(spark, sf_dir).select("slug", "html")).select("slug", F.posexplode("rows").alias("pos", "r"))
    return rows.select("slug", "pos", "r.label", "r.value_text", "r.raw_text")


_K = "s_suppkey"
_BOX = [
    ("Capital", f"'City ' || {_K} || ' 33°54′N 35°32′E'", f"'City ' || {_K} || ' 33°54′N 35°32′E [1]'"), ("Official languages", f"'Arabic, L' || {_K}", None), ("Government", "'Unitary & republic'", None),
    ("Area • Total", f"{_K} || ',452 km2 (161st)'", None), ("Area • Water (%)", "'1.8'", None), ("Population • 2023 estimate", f"'1,' || lpad({_K}::VARCHAR, 3, '0') || ',482 (118th)'", None), ("GDP (nominal)", "'2022 estimate'", None),
    ("• Total", f"'$ ' || {_K} || '.2 billion (104th)'", None), ("• Per capita", "'$ 1,000'", None), ("HDI (2022)", "'0.723 high (109th)'", None), ("Gini (2011)", "'31.8'", None), ("Currency", f"'Pound ' || {_K} || ' (LBP)'", None),
    ("Calling code", f"'+96' || {_K}", None), ("Internet TLD", "'.lb'", None), ("Time zone", "'UTC +2 (EET)'", None),
]
INFOBOX_ROWS_SQL = " UNION ALL ".join(f"SELECT 's' || lpad({_K}::VARCHAR, 9, '0') AS slug, {i} AS pos, '{label}' AS label, {value} AS value_text, {raw or value} AS raw_text FROM supplier" for i, (label, value, raw) in enumerate(_BOX))


def ingest_pages(spark, sf_dir):
    """The leaves of the trees that the pages become."""
    rows = nodes(api.ingest(_built_pages(spark, sf_dir, grouped=True), "2024-01-01T00:00:00Z")).where("size = 1")
    return rows.select("tree_id", F.array_join(F.slice("path", F.lit(2), F.size("path")), ".").alias("path"), "value")


_LEAVES = {
    "meta.country_name": "replace(s_name, '#', ' ')", "meta.retrieved_at": "'2024-01-01T00:00:00Z'", "meta.slug": f"'s' || lpad({_K}::VARCHAR, 9, '0')", "meta.source": "'wikipedia'", "meta.wikipedia_url": f"'http://w/' || {_K}",
    "fields.area.total_km2": f"({_K} * 1000 + 452)::VARCHAR", "fields.area.water_percent": "'1.8'", "fields.calling_code": f"'96' || {_K}", "fields.capital": "'City'", "fields.coordinates.latitude": "'33 54 N'", "fields.coordinates.longitude": "'35 32 E'",
    "fields.country_name": "replace(s_name, '#', ' ')", "fields.currency.code": "'LBP'", "fields.currency.name": f"'Pound ' || {_K}", "fields.development.gini.value": "'31.8'", "fields.development.gini.year": "'2011'",
    "fields.development.hdi.rank": "'109'", "fields.development.hdi.value": "'0.723'", "fields.development.hdi.year": "'2022'", "fields.economy.gdp_nominal_per_capita": "'1.000'", "fields.economy.gdp_nominal_total": f"{_K} || '.2 billion'", "fields.economy.gdp_nominal_year": "'2022'",
    "fields.government.type": "'Unitary republic'", "fields.internet_tld.internet_tld_item": "'lb'", "fields.languages.official.official_item": "'Arabic'", "fields.languages.official.official_item ": f"'L' || {_K}", "fields.largest_city": "'City'",
    "fields.population.rank": "'118'", "fields.population.total": f"(1000000 + {_K} * 1000 + 482)::VARCHAR", "fields.population.year": "'2023'", "fields.time_zone.standard": "'UTC+2'",
}


def pages_infobox(spark, sf_dir):
    """Every page of the table: the rows of its infobox, null without one, and the error if it can't be read."""
    return html.infoboxes(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"), "error")


PAGES_SQL = "SELECT page_id, CASE WHEN regexp_matches(html, '<table[^>]*infobox') THEN 0 END::INT AS n_rows, NULL::VARCHAR AS error FROM pages"


def entity_list(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    line = F.concat(F.lit("<tr><td><a href=\"/wiki/"), F.col("n_name"), F.lit('">'), F.initcap(F.lower("n_name")), F.lit(" (x)</a></td></tr>"))
    page = n.groupBy("n_regionkey").agg(F.concat(F.lit('<table class="wikitable sortable">'), F.array_join(F.sort_array(F.collect_list(line)), ""), F.lit("</table>")).alias("html"))
    return html.entity_list(page, "https://w").select("name", "url", "slug")


ENTITY_SQL = "SELECT 'Nation_' || n_nationkey || ' (x)' AS name, 'https://w/wiki/' || n_name AS url, 'nation_' || n_nationkey || '_x' AS slug FROM nation"


# ---- field texts, and stored documents ----
def field_functions(spark, sf_dir):
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    said = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    money, place = text.currency(said("Pound ", k, " (x; LBP)")), text.coordinates(said(k, "x 1°2′N 130°45′E"))
    return s.select(
        "s_suppkey", text.strip_rank(said("$ ", k, " billion ( 3rd ) ")).alias("unranked"), text.human_index(said("2 ", k, ".5 0.71235 high")).alias("index"), text.capital_name(said(" City  ", k, " 12°30′N Country: x")).alias("capital"),
        place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), money["name"].alias("money"), money["code"].alias("code"), F.array_join(text.split_list(said("a", k, "; b, c · d / e,, ")), "|").alias("parts"),
        text.utc_offset(said("x UTC +", k, ":30 (y)")).alias("offset"), text.collapse(said("  a \t b", k, "\n")).alias("collapsed"), text.scalar_key(said(" ", k, ".0 ")).alias("key"), text.path_label(F.array(F.lit("fields"), F.lit("gdp_ppp_total[2]"))).alias("label"),
        F.array_join(text.segments(said("a..b.", k)), "|").alias("segments"), text.xml_name(said(" ", k, " é((x")).alias("xml"), F.array_join(text.leaf_tokens(said("a b1-", k, " x N")), "|").alias("tokens"),
        F.array_join(F.transform(text.parse_numbers(said("-1,234.5 x ", k, " y")), lambda n: n["txt"]), "|").alias("numbers"), F.array_join(text.tokenize(said("Ab-", k, "_c")), "|").alias("words"), F.array_join(text.split_domains(said(".a; .b,", k)), "|").alias("domains"),
    )


FIELD_SQL = """SELECT s_suppkey, '$ ' || k || ' billion' AS unranked, CASE WHEN k = '0' THEN 0.5 WHEN k = '0' THEN 1 ELSE 0.7124 END::DOUBLE AS "index", 'City' AS capital, '1°2′N' AS latitude, '130°45′E' AS longitude, 'Pound ' || k AS money, 'LBP' AS code,
  'a' || k || '|b|c|d|e' AS parts, 'UTC+' || k || ':30' AS "offset", 'a b' || k AS collapsed, k AS "key", 'Gdp Ppp Total' AS label, 'a|b|' || k AS segments, 'n_' || k || '_x' AS xml, CASE WHEN len(k) > 0 THEN 'b1|' || k || '|N' END AS tokens, '-1234.5|' || k AS numbers, 'Ab|' || k || '|c' AS words, '.a|.b|' || k AS domains
  FROM (SELECT s_suppkey, s_suppkey::VARCHAR AS k FROM supplier)"""


def tree_updates(spark, sf_dir):
    """Stored documents with a new tree where there is one; documents that aren't stored are not added."""
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    old = n.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("slug"), F.when(F.col("n_nationkey") != 3, F.col("n_name")).alias("country_name"), F.lit("old").alias("tree"))
    new = s.groupBy((F.col("s_nationkey") * 2).alias("k")).agg(F.max("s_suppkey").cast("string").alias("tree")).select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("slug"), "tree")
    return store.entity_index(old).join(store.update_existing(old, new, "tree").drop("country_name"), "slug").join(store.slugs(old), "slug")


UPDATES_SQL = """WITH new AS (SELECT s_nationkey * 2 AS k, max(s_suppkey)::VARCHAR AS tree FROM supplier GROUP BY 1) SELECT 'c' || n_nationkey AS slug, CASE WHEN n_nationkey = 3 THEN 'C3' ELSE n_name END AS name, coalesce(new.tree, 'old') AS tree FROM nation LEFT JOIN new ON k = n_nationkey"""

INGEST_SQL = " UNION ALL ".join(f"SELECT 's' || lpad({_K}::VARCHAR, 9, '0') AS tree_id, '{path.strip()}' AS path, {value} AS value FROM supplier" for path, value in _LEAVES.items())


QUERIES = {
    f.__name__: f
    for f in (
        document_trees, tree_json, json_trees, json_elements, validate_trees, ted_nj_parts, ted_zhang_shasha_parts, scripts_parts, scripts_nj_parts, mappings_parts, script_normalized, script_normalized_nj, script_summary_parts,
        full_diff, compare_parts, patch_all_features, patch_clean_diff, patch_script, equal_trees, cleaned_ops, document_diff, diff_categories, value_lookup, infobox_rows, pages_infobox, entity_list, field_functions, tree_updates,
        ingest_pages,
    )
}
SQL = {
    "document_trees": DOCUMENT_SQL, "tree_json": TREE_JSON_SQL, "json_trees": JSON_TREES_SQL, "json_elements": ELEMENTS_SQL, "validate_trees": VALIDATE_SQL, "ted_nj_parts": PART_TED_SQL, "ted_zhang_shasha_parts": PART_TED_SQL,
    "scripts_parts": SCRIPTS_SQL, "scripts_nj_parts": SCRIPTS_NJ_SQL, "mappings_parts": MAPPINGS_SQL, "script_normalized": NORMALIZED_SQL, "script_normalized_nj": NORMALIZED_NJ_SQL, "script_summary_parts": SCRIPT_SUMMARY_SQL,
    "full_diff": FULL_DIFF_SQL, "compare_parts": COMPARE_SQL, "patch_all_features": PATCH_ALL_SQL, "patch_clean_diff": PATCH_CLEAN_SQL, "patch_script": PATCH_SCRIPT_SQL, "equal_trees": EQUAL_SQL, "cleaned_ops": CLEANED_SQL,
    "document_diff": DOCUMENT_DIFF_SQL, "diff_categories": CATEGORIES_SQL, "value_lookup": VALUE_LOOKUP_SQL, "infobox_rows": INFOBOX_ROWS_SQL, "pages_infobox": PAGES_SQL, "entity_list": ENTITY_SQL, "field_functions": FIELD_SQL,
    "tree_updates": UPDATES_SQL, "ingest_pages": INGEST_SQL,
}
