"""The queries for the tree operators over the star schema's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import diff, features, normalize, patch, ranking, render, ted
from .plans.datasets import CUSTOMER_SQL, PART_SQL, customer_pairs, customer_trees, part_pairs, part_trees, read
from .plans.trees import nodes
from .sources import store

QUERY_PART = "part_000000007"
FEATURES = ["fields.name", "fields.orders.orders_item.status"]

# ---- SQL building blocks ----
_PAIRS = """pairs AS (SELECT x.tree_id AS source_id, y.tree_id AS target_id, x.seq AS a, y.seq AS b FROM {t} x JOIN {t} y
  ON regexp_extract(y.tree_id, '([0-9]+)$', 1)::BIGINT = regexp_extract(x.tree_id, '([0-9]+)$', 1)::BIGINT + 1)"""
_TED = """list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]), lambda up, ie:
  list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda r, je: list_append(r, least(
    CASE WHEN je[1] = len(b) OR a[ie[1]].depth >= b[je[1]].depth THEN up[je[1] + 1] + 1 ELSE 1000000000 END,
    CASE WHEN ie[1] = len(a) OR b[je[1]].depth >= a[ie[1]].depth THEN r[je[1]] + 1 ELSE 1000000000 END,
    CASE WHEN a[ie[1]].depth = b[je[1]].depth THEN up[je[1]] + (CASE WHEN a[ie[1]].label = b[je[1]].label AND a[ie[1]].value IS NOT DISTINCT FROM b[je[1]].value THEN 0 ELSE 1 END) ELSE 1000000000 END)),
  [ie[1]]), range(0, len(b) + 1))[-1]"""
_NODES = """base AS (SELECT tree_id, seq, len(seq) AS n, unnest(range(0, len(seq))) AS pre FROM {t}),
sized AS (SELECT tree_id, seq, n, pre, seq[pre + 1].label AS label, seq[pre + 1].value AS value, seq[pre + 1].depth AS depth,
  list_min(list_filter(range(pre + 1, n + 1), lambda k: k = n OR seq[k + 1].depth <= seq[pre + 1].depth)) - pre AS size,
  list_transform(range(0, seq[pre + 1].depth + 1), lambda d: list_max(list_filter(range(0, pre + 1), lambda k: seq[k + 1].depth = d))) AS line FROM base),
placed AS (SELECT *, CASE WHEN pre = 0 THEN -1 ELSE line[-2] END AS parent_pre FROM sized),
counted AS (SELECT *, row_number() OVER (PARTITION BY tree_id, parent_pre, label ORDER BY pre) - 1 AS k, count(*) OVER (PARTITION BY tree_id, parent_pre, label) AS alike,
  row_number() OVER (PARTITION BY tree_id, parent_pre ORDER BY pre) - 1 AS ordinal FROM placed),
named AS (SELECT *, label || '#' || k AS occ, CASE WHEN alike > 1 THEN label || '[' || k || ']' ELSE label END AS keyed FROM counted),
whole AS (SELECT tree_id, list({{'occ': occ, 'keyed': keyed}} ORDER BY pre) AS every FROM named GROUP BY tree_id),
nodes AS (SELECT named.tree_id, n, pre, pre - depth + size - 1 AS post, parent_pre, depth, ordinal, size, pre - depth AS lmd, label, value,
  list_transform(line, lambda k: seq[k + 1].label) AS path, list_transform(line[2:], lambda k: every[k + 1].occ) AS occ_path,
  list_transform(line[2:], lambda k: every[k + 1].keyed) AS keyed_path FROM named JOIN whole USING (tree_id))"""


def _sql(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


_CUSTOMER_NODES = (CUSTOMER_SQL, _NODES.format(t="customers"))
_CUSTOMER_PAIRS = (CUSTOMER_SQL, _PAIRS.format(t="customers"))


def rank_chawathe(spark, sf_dir):
    return ranking.rank(part_trees(spark, sf_dir), QUERY_PART, 10)


RANK_SQL = _sql(
    PART_SQL,
    "shown AS (SELECT tree_id, list_prepend({'label': 'infobox', 'value': NULL::VARCHAR, 'depth': 0}, seq[2:]) AS seq FROM parts)",
    f"pairs AS (SELECT y.tree_id, x.seq AS a, y.seq AS b FROM shown x, shown y WHERE x.tree_id = '{QUERY_PART}' AND y.tree_id <> x.tree_id)",
    f"scored AS (SELECT tree_id, len(a) + len(b) AS total, {_TED}::INT AS distance FROM pairs)",
    then="SELECT row_number() OVER (ORDER BY greatest(0.0::DOUBLE, 1.0::DOUBLE - distance::DOUBLE / total) DESC, tree_id)::INT AS rank, tree_id, distance, greatest(0.0::DOUBLE, 1.0::DOUBLE - distance::DOUBLE / total) AS similarity FROM scored QUALIFY rank <= 10",
)


def ted_chawathe_pairs(spark, sf_dir):
    return ted.distances(customer_pairs(spark, sf_dir))


TED_SQL = _sql(
    *_CUSTOMER_PAIRS, f"d AS (SELECT source_id, target_id, len(a)::INT AS n_source, len(b)::INT AS n_target, {_TED}::INT AS distance FROM pairs)",
    then="SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - distance::DOUBLE / (n_source + n_target)) AS similarity FROM d",
)


def ted_nj_pairs(spark, sf_dir):
    return ted.distances(customer_pairs(spark, sf_dir), "nj")


def ted_zhang_shasha_pairs(spark, sf_dir):
    return ted.distances(customer_pairs(spark, sf_dir), "zhang_shasha")


def ted_scripts_chawathe(spark, sf_dir):
    return ted.scripts(customer_pairs(spark, sf_dir))


def rank_both(spark, sf_dir):
    return ranking.rank_both(part_trees(spark, sf_dir), QUERY_PART)


#: Trees of parts differ in the values of leaves only: each algorithm's distance is the number of leaves that differ.
RANK_BOTH_SQL = _sql(
    PART_SQL,
    f"scored AS (SELECT y.tree_id, len(list_filter(list_zip(x.seq, y.seq), lambda z: z[1].value IS DISTINCT FROM z[2].value))::INT AS distance FROM parts x, parts y WHERE x.tree_id = '{QUERY_PART}' AND y.tree_id <> x.tree_id)",
    then="SELECT row_number() OVER (PARTITION BY algorithm ORDER BY 1 - distance / 16.0 DESC, tree_id)::INT AS rank, tree_id, distance, 1.0::DOUBLE - distance::DOUBLE / 16 AS similarity, algorithm FROM scored, (VALUES ('chawathe'), ('nj')) v(algorithm) QUALIFY rank <= 5",
)


def _joined(df):
    """Arrays as text, so that results can be compared by value."""
    return df.select(*[F.array_join(c, "/").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])


def tree_nodes(spark, sf_dir):
    return _joined(nodes(customer_trees(spark, sf_dir)))


NODES_SQL = _sql(
    *_CUSTOMER_NODES,
    then="SELECT tree_id, n::INT AS n, pre::INT AS pre, post::INT AS post, parent_pre::INT AS parent_pre, depth, ordinal::INT AS ordinal, size::INT AS size, lmd::INT AS lmd, label, value, array_to_string(path, '/') AS path, array_to_string(occ_path, '/') AS occ_path, array_to_string(keyed_path, '/') AS keyed_path FROM nodes",
)


def keyroots(spark, sf_dir):
    """The nodes whose forests the keyroot distance solves: the last in postorder of each leftmost leaf."""
    return nodes(customer_trees(spark, sf_dir)).groupBy("tree_id", "lmd").agg(F.max("post").alias("keyroot"))


KEYROOTS_SQL = _sql(*_CUSTOMER_NODES, then="SELECT tree_id, lmd::INT AS lmd, max(post)::INT AS keyroot FROM nodes GROUP BY ALL")


def leaf_paths(spark, sf_dir):
    return features.leaf_paths(customer_trees(spark, sf_dir))


_LEAVES = "SELECT DISTINCT tree_id, array_to_string(path[2:], '.') AS path FROM nodes WHERE size = 1"
LEAF_PATHS_SQL = _sql(*_CUSTOMER_NODES, then=_LEAVES)


def feature_union(spark, sf_dir):
    return features.feature_union(customer_trees(spark, sf_dir), first=50)


FEATURE_UNION_SQL = _sql(*_CUSTOMER_NODES, f"leaves AS ({_LEAVES})", then="SELECT DISTINCT path FROM leaves WHERE tree_id IN (SELECT tree_id FROM customers ORDER BY tree_id LIMIT 50) ORDER BY path")


def _as_text(trees):
    return trees.select("tree_id", F.array_join(F.transform("seq", lambda x: F.concat_ws("=", F.concat(x["depth"].cast("string"), F.lit(":"), x["label"]), F.coalesce(x["value"], F.lit("")))), "|").alias("tree"))


def prune_include(spark, sf_dir):
    return _as_text(features.prune_include(customer_trees(spark, sf_dir), FEATURES))


def prune_exclude(spark, sf_dir):
    return _as_text(features.prune_exclude(customer_trees(spark, sf_dir), FEATURES))


def _prune_sql(wanted: str) -> str:
    test = " OR ".join(f"list_slice(path, 2, {len(f.split('.')) + 1}) = {f.split('.')!r}" for f in FEATURES)
    return _sql(
        *_CUSTOMER_NODES, f"leaves AS (SELECT tree_id, pre FROM nodes WHERE size = 1 AND {wanted} ({test}))",
        "kept AS (SELECT * FROM nodes p WHERE EXISTS (SELECT 1 FROM leaves l WHERE l.tree_id = p.tree_id AND l.pre >= p.pre AND l.pre < p.pre + p.size))",
        then="SELECT tree_id, string_agg(depth || ':' || label || '=' || coalesce(value, ''), '|' ORDER BY pre) AS tree FROM kept GROUP BY tree_id",
    )


def path_lookup(spark, sf_dir):
    return features.lookup(customer_trees(spark, sf_dir), "fields.orders.orders_item.status")


LOOKUP_SQL = _sql(*_CUSTOMER_NODES, "found AS (SELECT tree_id, arg_min(value, pre) AS value FROM nodes WHERE path[2:] = ['fields', 'orders', 'orders_item', 'status'] GROUP BY tree_id)", then="SELECT tree_id, value, found.tree_id IS NOT NULL AS found FROM customers LEFT JOIN found USING (tree_id)")


def tree_similarity(spark, sf_dir):
    return diff.tree_similarity(customer_pairs(spark, sf_dir))


_SIDES = (
    *_CUSTOMER_NODES, _PAIRS.format(t="customers"),
    "sa AS (SELECT source_id, target_id, nodes.* FROM pairs JOIN nodes ON tree_id = source_id)", "sb AS (SELECT source_id, target_id, nodes.* FROM pairs JOIN nodes ON tree_id = target_id)",
)
SIMILARITY_SQL = _sql(
    *_SIDES,
    "j AS (SELECT coalesce(sa.source_id, sb.source_id) AS source_id, coalesce(sa.target_id, sb.target_id) AS target_id, CASE WHEN sa.pre IS NOT NULL AND sb.pre IS NOT NULL THEN (sa.label = sb.label)::BIGINT + (coalesce(sa.value, '') = coalesce(sb.value, ''))::BIGINT ELSE 0 END AS m FROM sa FULL OUTER JOIN sb ON sa.source_id = sb.source_id AND sa.target_id = sb.target_id AND sa.occ_path = sb.occ_path)",
    then="SELECT source_id, target_id, sum(m)::BIGINT AS matches, (2 * count(*))::BIGINT AS total, sum(m)::DOUBLE / (2 * count(*)) AS score FROM j GROUP BY source_id, target_id",
)


def semantic_diff(spark, sf_dir):
    return _joined(diff.semantic_diff(customer_pairs(spark, sf_dir)))


_DIFF = (
    *_SIDES,
    "ka AS (SELECT source_id, target_id, keyed_path AS path, size = 1 AS atomic, CASE WHEN size = 1 AND label = 'nation' THEN value WHEN size = 1 THEN '\"' || value || '\"' END AS v, pre FROM sa WHERE depth > 0)",
    "kb AS (SELECT source_id, target_id, keyed_path AS path, size = 1 AS atomic, CASE WHEN size = 1 AND label = 'nation' THEN value WHEN size = 1 THEN '\"' || value || '\"' END AS v, pre FROM sb WHERE depth > 0)",
    "item_a AS (SELECT source_id, target_id, keyed_path[1:depth - 1] AS path, '{' || string_agg('\"' || label || '\": \"' || value || '\"', ', ' ORDER BY pre) || '}' AS v, min(pre) AS pre FROM sa WHERE depth = 4 GROUP BY ALL)",
    "item_b AS (SELECT source_id, target_id, keyed_path[1:depth - 1] AS path, '{' || string_agg('\"' || label || '\": \"' || value || '\"', ', ' ORDER BY pre) || '}' AS v, min(pre) AS pre FROM sb WHERE depth = 4 GROUP BY ALL)",
    "orders_a AS (SELECT source_id, target_id, ['fields', 'orders'] AS path, '{\"orders\": [' || string_agg(v, ', ' ORDER BY pre) || ']}' AS v, min(pre) AS pre FROM item_a GROUP BY ALL)",
    "orders_b AS (SELECT source_id, target_id, ['fields', 'orders'] AS path, '{\"orders\": [' || string_agg(v, ', ' ORDER BY pre) || ']}' AS v, min(pre) AS pre FROM item_b GROUP BY ALL)",
    "text_a AS (FROM item_a UNION ALL FROM orders_a)", "text_b AS (FROM item_b UNION ALL FROM orders_b)",
    "m AS (SELECT coalesce(ka.source_id, kb.source_id) AS source_id, coalesce(ka.target_id, kb.target_id) AS target_id, coalesce(ka.path, kb.path) AS path, ka.path IS NOT NULL AS in_a, kb.path IS NOT NULL AS in_b, ka.atomic AS atomic_a, kb.atomic AS atomic_b, ka.v AS old, kb.v AS new FROM ka FULL OUTER JOIN kb ON ka.source_id = kb.source_id AND ka.target_id = kb.target_id AND ka.path = kb.path)",
    "live AS (SELECT m.* FROM m LEFT JOIN m p ON p.source_id = m.source_id AND p.target_id = m.target_id AND p.path = m.path[1:len(m.path) - 1] WHERE len(m.path) = 1 OR (p.in_a AND p.in_b AND NOT p.atomic_a AND NOT p.atomic_b))",
    "ops AS (SELECT live.source_id, live.target_id, CASE WHEN NOT in_a THEN 'insert' WHEN NOT in_b THEN 'delete' ELSE 'update' END AS op, live.path, CASE WHEN in_a AND NOT atomic_a THEN text_a.v ELSE old END AS old, CASE WHEN in_b AND NOT atomic_b THEN text_b.v ELSE new END AS new FROM live LEFT JOIN text_a USING (source_id, target_id, path) LEFT JOIN text_b USING (source_id, target_id, path) WHERE (NOT in_a OR NOT in_b OR ((atomic_a OR atomic_b) AND old IS DISTINCT FROM new)) AND NOT list_has_any(live.path, ['retrieved_at', 'slug', 'wikipedia_url', 'source']))",
)
DIFF_SQL = _sql(*_DIFF, then="SELECT source_id, target_id, op, array_to_string(path, '/') AS path, CASE WHEN op <> 'insert' THEN old END AS old_value, CASE WHEN op = 'update' THEN new END AS new_value, CASE WHEN op = 'insert' THEN new END AS value FROM ops")


def semantic_summary(spark, sf_dir):
    return diff.summarize(diff.semantic_diff(customer_pairs(spark, sf_dir)))


SUMMARY_SQL = _sql(*_DIFF, then="SELECT source_id, target_id, count(*) FILTER (op = 'insert') AS inserts, count(*) FILTER (op = 'delete') AS deletes, count(*) FILTER (op = 'update') AS updates, count(*) AS total FROM ops GROUP BY ALL")




# ---- patches and renderings ----
_AS_TEXT = "array_to_string(list_transform({s}, lambda x: x.depth || ':' || x.label || '=' || coalesce(x.value, '')), '|')"


def _round_trip(spark, sf_dir, algorithm):
    """Sources patched by their scripts; they must become their targets."""
    pairs = customer_pairs(spark, sf_dir)
    done = patch.apply_script(pairs, ted.scripts(pairs, algorithm, keep=("a", "b")), algorithm)
    seq = F.transform("patched", lambda x: F.concat_ws("=", F.concat(x["depth"].cast("string"), F.lit(":"), x["label"]), F.coalesce(x["value"], F.lit(""))))
    return done.select("source_id", "target_id", F.array_join(seq, "|").alias("tree"), "error")


def patch_round_trip_chawathe(spark, sf_dir):
    return _round_trip(spark, sf_dir, "chawathe")


def patch_round_trip_nj(spark, sf_dir):
    return _round_trip(spark, sf_dir, "nj")


def patch_zhang_shasha(spark, sf_dir):
    return _round_trip(spark, sf_dir, "zhang_shasha")


ROUND_TRIP_SQL = _sql(*_CUSTOMER_PAIRS, then=f"SELECT source_id, target_id, {_AS_TEXT.format(s='b')} AS tree, NULL::VARCHAR AS error FROM pairs")


#: The target with its sections in order of label.
ZHANG_SHASHA_SQL = _sql(*_CUSTOMER_PAIRS, then=f"SELECT source_id, target_id, {_AS_TEXT.format(s='list_concat(b[1:1], b[4:], b[2:3])')} AS tree, NULL::VARCHAR AS error FROM pairs")


def feature_patch(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir)
    made = patch.patch_from_features(pairs, ["name", "fields.size", "brand"], ["brand"], keep=("a",))
    return _as_text(patch.apply_paths(made.select(F.col("source_id").alias("tree_id"), F.col("a").alias("seq"), "patch")))


FEATURE_PATCH_SQL = _sql(
    PART_SQL, _PAIRS.format(t="parts"),
    then="SELECT source_id AS tree_id, array_to_string(list_transform(a, lambda x, i: x.depth || ':' || x.label || '=' || coalesce(CASE WHEN x.label IN ('name', 'size') THEN b[i].value ELSE x.value END, '')), '|') AS tree FROM pairs",
)


def script_summary_nj(spark, sf_dir):
    return patch.summarize_script(ted.scripts(customer_pairs(spark, sf_dir), "nj"))


def script_summary_chawathe(spark, sf_dir):
    return patch.summarize_script(ted.scripts(customer_pairs(spark, sf_dir)))


def infobox_text(spark, sf_dir):
    return render.infobox_text(customer_trees(spark, sf_dir))


INFOBOX_SQL = _sql(
    *_CUSTOMER_NODES,
    then="""SELECT tree_id, '{{Infobox country' || chr(10) || '| name = ' || tree_id || chr(10) || string_agg('| ' || array_to_string(path[3:], '.') || ' = ' || value, chr(10) ORDER BY pre) || chr(10) || '}}' AS text
  FROM nodes WHERE size = 1 AND path[2] = 'fields' GROUP BY tree_id""",
)


def indented_text(spark, sf_dir):
    return render.indented(customer_trees(spark, sf_dir))


INDENTED_SQL = _sql(CUSTOMER_SQL, then="SELECT tree_id, array_to_string(list_transform(seq, lambda x: repeat('  ', x.depth) || x.label || CASE WHEN x.value IS NULL THEN '' ELSE ' = ' || x.value END), chr(10)) AS text FROM customers")


def drawn_text(spark, sf_dir):
    return render.drawn(customer_trees(spark, sf_dir))


DRAWN_SQL = _sql(
    *_CUSTOMER_NODES,
    "spans AS (SELECT n.*, n.pre + n.size = p.pre + p.size AS last FROM nodes n LEFT JOIN nodes p ON p.tree_id = n.tree_id AND p.pre = n.parent_pre)",
    "lasts AS (SELECT tree_id, list(last ORDER BY pre) AS lasts FROM spans GROUP BY tree_id)",
    "lines AS (SELECT tree_id, pre, CASE WHEN depth = 0 THEN '' ELSE array_to_string(list_transform(placed.line[2:depth], lambda k: CASE WHEN lasts[k + 1] THEN '    ' ELSE '│   ' END), '') || CASE WHEN lasts[pre + 1] THEN '└── ' ELSE '├── ' END END || label || CASE WHEN value IS NULL THEN '' ELSE ' = ' || value END AS said FROM placed JOIN lasts USING (tree_id))",
    then="SELECT tree_id, string_agg(said, chr(10) ORDER BY pre) AS text FROM lines GROUP BY tree_id",
)


def json_xml(spark, sf_dir):
    return render.documents(part_trees(spark, sf_dir))


_LEAVES_OF_PART = {"brand": "p_brand", "name": "p_name", "size": "p_size", "type": "p_type"}
JSON_XML_SQL = (
    """WITH p AS (SELECT *, 'part_' || lpad(p_partkey::VARCHAR, 9, '0') AS tree_id, chr(10) AS e FROM part) SELECT tree_id, '{' || e || '  "part": {' || e || '    "meta": {' || e || '      "slug": "' || tree_id || '"' || e || '    },' || e || '    "fields": {' || e || """
    + " || ',' || e || ".join(f"""'      "{k}": "' || {v} || '"'""" for k, v in _LEAVES_OF_PART.items())
    + """ || e || '    }' || e || '  }' || e || '}' AS json, '<part><meta><slug>' || tree_id || '</slug></meta><fields>' || """
    + " || ".join(f"'<{k}>' || {v} || '</{k}>'" for k, v in _LEAVES_OF_PART.items())
    + """ || '</fields></part>' AS xml, NULL::VARCHAR AS error FROM p"""
)


def upsert_entities(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("slug"), F.col("c_name").alias("name"), "c_custkey")
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("c_custkey"))
    return store.upsert(n, c, order="c_custkey")


UPSERT_SQL = """WITH new AS (SELECT 'c' || c_nationkey AS slug, c_name AS name, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1),
old AS (SELECT 'c' || n_nationkey AS slug, n_name AS name, n_nationkey::BIGINT AS c_custkey FROM nation) SELECT * FROM new UNION ALL SELECT * FROM old WHERE slug NOT IN (SELECT slug FROM new)"""


def fields_last_wins(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return normalize.fields(c.select(F.col("conv_id").alias("entity"), F.col("turn").alias("pos"), F.col("role").alias("label"), F.length("text").cast("string").alias("value_text"))).withColumnRenamed("pos", "first_pos")


FIELDS_SQL = "SELECT conv_id AS entity, role AS key, min(turn) AS first_pos, role AS raw_label, arg_max(length(text)::VARCHAR, turn) AS text FROM conversations GROUP BY conv_id, role"


# ---- text functions over documents ----
def text_functions(spark, sf_dir):
    d, t = read(spark, sf_dir, "documents"), F.col("text")
    rank = text.extract_rank("text")
    return d.select(
        "doc_id", text.normalize_key("text").alias("key"), F.size(text.tokenize("text")).cast("long").alias("tokens"), F.size(text.parse_numbers("text")).cast("long").alias("numbers"),
        text.first_year("text").alias("year"), rank.alias("rank"), text.digits_only("text").alias("digits"), text.slugify(F.concat_ws(" ", "lang", F.lit("(x),"), "source")).alias("slug"),
        F.size(text.split_domains(t)).cast("long").alias("pieces"), text.normalize_path(F.concat(F.col("source"), F.lit(".a"))).alias("path"), text.xml_name(F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"))).alias("xml"),
    )


TEXT_SQL = r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^0-9a-zA-Z]+', '_', 'g'), '_'), ''), 'field') AS key,
  len(list_filter(regexp_split_to_array(text, '[^0-9A-Za-z]+'), lambda x: x <> '')) AS tokens, len(regexp_extract_all(text, '[-+]?(?:[0-9]{1,3}(?:[,\x{00A0}][0-9]{3})+|[0-9]+)(?:\.[0-9]+)?')) AS numbers,
  TRY_CAST(regexp_extract(text, '\b((?:19|20)[0-9]{2})\b', 1) AS INT) AS year,
  coalesce(TRY_CAST(regexp_extract(text, '(?i)\(([0-9]+)(?:st|nd|rd|th)\)', 1) AS INT), TRY_CAST(regexp_extract(text, '(?i)\b([0-9]+)(?:st|nd|rd|th)\b', 1) AS INT)) AS rank,
  nullif(regexp_replace(text, '[^0-9]+', '', 'g'), '') AS digits, replace(replace(replace(replace(lower(lang || ' (x), ' || source), ' ', '_'), '(', ''), ')', ''), ',', '') AS slug,
  len(list_filter(regexp_split_to_array(text, '[\s,;]+'), lambda x: x <> '')) AS pieces, 'fields.' || source || '.a' AS path, 'n_' || doc_id || '_' || lang AS xml FROM documents"""


def merge_tokens(spark, sf_dir):
    """Leaf texts of part attributes and dates, as the tree builder makes them."""
    p = read(spark, sf_dir, "part")
    labels = {"name": F.col("p_name"), "type": F.col("p_type"), "price": F.format_number("p_retailprice", 2), "gdp_nominal_total": F.concat(F.col("p_size").cast("string"), F.lit(" 5 billion"))}
    return p.select("p_partkey", *[text.leaf_value(F.lit(k), v).alias(k) for k, v in labels.items()])


def _leaf_sql(label: str, v: str) -> str:
    tokens = f"list_filter(regexp_split_to_array({v}, '[^0-9A-Za-z_]+'), lambda t: t <> '' AND (len(t) > 1 OR regexp_full_match(t, '[0-9]') OR t IN ('N', 'E')))"
    digits = "regexp_full_match({}, '[0-9]+')"
    body = f"CASE WHEN len(t) < 2 OR '{label}' IN ('name') AND false THEN array_to_string(t, ' ') WHEN len(list_filter(t[:-2], lambda x: NOT {digits.format('x')})) = 0 AND regexp_full_match(t[-1], '[A-Za-z]+') THEN array_to_string(t[:-2], '.') || ' ' || t[-1] WHEN len(list_filter(t, lambda x: NOT {digits.format('x')})) = 0 THEN array_to_string(t, '.') ELSE array_to_string(t, ' ') END"
    return f"(SELECT CASE WHEN regexp_full_match(v, '[0-9]+\\.[0-9]+') OR regexp_matches(v, '[T:-]') THEN v ELSE {body} END FROM (SELECT {v} AS v, {tokens} AS t)) AS {label}"


MERGE_SQL = "SELECT p_partkey, " + ", ".join(_leaf_sql(k, v) for k, v in {"name": "p_name", "type": "p_type", "price": "format('{:,.2f}', p_retailprice)", "gdp_nominal_total": "p_size || ' 5 billion'"}.items()) + " FROM part"


def json_shred(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.display_name(F.lit(None).cast("string"), F.concat(F.lit("event_"), F.col("event_type"))).alias("name"))


JSON_SQL = "SELECT event_id, (props->>'$.k')::BIGINT AS k, 'Event ' || upper(event_type[1]) || event_type[2:] AS name FROM events"

QUERIES = {
    f.__name__: f
    for f in (
        rank_chawathe, rank_both, ted_chawathe_pairs, ted_nj_pairs, ted_zhang_shasha_pairs, ted_scripts_chawathe, tree_nodes, keyroots, leaf_paths, feature_union,
        prune_include, prune_exclude, path_lookup, tree_similarity, semantic_diff, semantic_summary, text_functions, merge_tokens, json_shred,
        patch_round_trip_chawathe, patch_round_trip_nj, patch_zhang_shasha, feature_patch, script_summary_nj, script_summary_chawathe, infobox_text, indented_text, drawn_text, json_xml,
        upsert_entities, fields_last_wins,
    )
}
SQL = {
    "rank_chawathe": RANK_SQL, "rank_both": RANK_BOTH_SQL, "ted_chawathe_pairs": TED_SQL, "tree_nodes": NODES_SQL, "keyroots": KEYROOTS_SQL, "leaf_paths": LEAF_PATHS_SQL,
    "feature_union": FEATURE_UNION_SQL, "prune_include": _prune_sql(""), "prune_exclude": _prune_sql("NOT"), "path_lookup": LOOKUP_SQL, "tree_similarity": SIMILARITY_SQL,
    "semantic_diff": DIFF_SQL, "semantic_summary": SUMMARY_SQL, "text_functions": TEXT_SQL, "merge_tokens": MERGE_SQL, "json_shred": JSON_SQL,
    "patch_round_trip_chawathe": ROUND_TRIP_SQL, "patch_round_trip_nj": ROUND_TRIP_SQL, "patch_zhang_shasha": ZHANG_SHASHA_SQL, "feature_patch": FEATURE_PATCH_SQL, "infobox_text": INFOBOX_SQL, "indented_text": INDENTED_SQL,
    "drawn_text": DRAWN_SQL, "json_xml": JSON_XML_SQL, "upsert_entities": UPSERT_SQL, "fields_last_wins": FIELDS_SQL,
}
