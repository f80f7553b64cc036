"""HTML to trees, and the composite queries."""

from pyspark.sql import functions as F

from arbordelta.functions import text
from arbordelta.plans import api
from arbordelta.plans.trees import SEQ, nodes
from arbordelta.sources import codec, html, store

PAGE = """<p>x</p><table class="infobox vcard"><tbody>
<tr><th colspan=2 class="infobox-above">Lebanon</th></tr>
<tr><th>Capital</th><td>Beirut 33°54′N 35°32′E<sup class="reference">[1]</sup></td></tr>
<tr><th>Official languages</th><td>Arabic, French</td></tr>
<tr style="display:none"><th>Hidden</th><td>1</td></tr>
<tr><th class="infobox-header">Area</th></tr><tr><th>• Total</th><td>10,452 km2 (161st)</td></tr><tr><th>• Water (%)</th><td>1.8</td></tr>
<tr><th class="infobox-header">Population</th></tr><tr><th>• 2023 estimate</th><td>5,364,482 (118th)</td></tr>
<tr><th>GDP ( PPP )</th><td>2022 estimate</td></tr><tr><th>• Total</th><td>$ 78.2 billion (104th)</td></tr>
<tr><th>HDI (2022)</th><td>0.723 high (109th)</td></tr>
<tr><th>Currency</th><td>Lebanese pound (LBP)</td></tr><tr><th>Calling code</th><td>+961</td></tr><tr><th>Internet TLD</th><td>.lb .ly</td></tr>
<tr><th>Time zone</th><td>UTC +2 (EET)</td></tr><tr><th>Empty</th><td></td></tr></tbody></table>"""


def test_infobox_rows():
    rows = html.infobox_rows(PAGE)
    labels = [r["label"] for r in rows]
    assert "Hidden" not in labels and "Empty" not in labels and "Area • Total" in labels and "Population • 2023 estimate" in labels
    assert rows[0]["value_text"] == "Beirut 33°54′N 35°32′E" and rows[0]["raw_text"].endswith("[1]")
    assert labels[labels.index("GDP ( PPP )") + 1] == "• Total"
    assert html.infobox_rows("<table class='other'></table>") is None and html.infobox_rows(None) is None


def test_ingest(spark):
    pages = spark.createDataFrame([("lebanon", "Lebanon", "http://w/Lebanon", PAGE), ("none", "None", "u", "<p>")], "slug string, name string, url string, html string")
    trees = api.ingest(pages, "2024-01-01T00:00:00Z").cache()
    (row,) = trees.collect()
    got = {".".join(r.path[1:]): r.value for r in nodes(trees).where("size = 1").collect()}
    want = {
        "fields.capital": "Beirut", "fields.coordinates.latitude": "33 54 N", "fields.area.total_km2": "10452", "fields.area.water_percent": "1.8", "fields.population.total": "5364482",
        "fields.population.year": "2023", "fields.population.rank": "118", "fields.economy.gdp_ppp_total": "78.2 billion", "fields.economy.gdp_ppp_year": "2022", "fields.development.hdi.value": "0.723",
        "fields.currency.code": "LBP", "fields.calling_code": "961", "fields.time_zone.standard": "UTC+2", "meta.slug": "lebanon", "fields.languages.official.official_item": "French", "fields.country_name": "Lebanon",
    }
    assert {k: got.get(k) for k in want} == want
    assert row.seq[0].label == "lebanon" and [n.label for n in row.seq if n.depth == 1] == ["meta", "fields"]
    top = [n.label for n in row.seq[[n.label for n in row.seq].index("fields") :] if n.depth == 2]
    assert top == sorted(top)


def test_entity_list(spark):
    page = '<table class="wikitable sortable"><tr><td><a href="/wiki/A">Aland (x)</a></td></tr><tr><td><a href="/wiki/B">Aland x</a></td></tr><tr><td><a href="#c">no</a></td></tr></table>'
    got = html.entity_list(spark.createDataFrame([(page,)], "html string"), "https://w").collect()
    assert [(r.name, r.url, r.slug) for r in got] == [("Aland (x)", "https://w/wiki/A", "aland_x")]


def test_text_functions(spark):
    df = spark.createDataFrame([(" GDP (PPP):  ", "12,345.5 and -7", "17 329 billion", "Rank 3rd (12th)")], "a string, b string, c string, d string")
    r = df.select(
        text.normalize_key("a").alias("key"), text.parse_numbers("b").alias("numbers"), text.merge_tokens(text.leaf_tokens("c"), F.lit("gdp_ppp_total")).alias("merged"), text.extract_rank("d").alias("rank"),
        text.normalize_path(F.lit("area.x")).alias("p1"), text.normalize_path(F.lit("meta.x")).alias("p2"), text.normalize_path(F.lit(" ")).alias("p3"), text.scalar_key(F.lit(" 1.0 ")).alias("one"), text.normalize_key(F.lit("::")).alias("none"),
    ).first()
    assert r.key == "gdp_ppp" and [(n.dbl, n.is_int) for n in r.numbers] == [(12345.5, False), (-7.0, True)] and r.merged == "17.329 billion" and r["rank"] == 12
    assert (r.p1, r.p2, r.p3, r.one, r.none) == ("fields.area.x", "meta.x", "", "1", "field")


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "slug string, v int")
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, store.update_existing(old, new, "v").collect())) == [("a", 1), ("b", 3)]


def test_compare_and_patch(spark):
    t = [("r", None, 0), ("fields", None, 1), ("area", "1", 2), ("name", "x", 2)]
    u = [("r", None, 0), ("fields", None, 1), ("area", "2", 2), ("name", "x", 2)]
    trees = spark.createDataFrame([("a", t), ("b", u)], f"tree_id string, seq {SEQ}")
    wanted = spark.createDataFrame([("a", "b"), ("a", "zz")], "source_id string, target_id string")
    (r,) = api.compare(trees, wanted).collect()
    assert (r.distance, r.updates, r.total, r.text, r.similarity) == (1, 1, 1, "- Area: 1\n+ Area: 2", 0.875)
    (r,) = api.compare(trees, wanted, ["fields.area"], exclude=True).collect()
    assert (r.distance, r.total) == (0, 0)
    (r,) = api.patch_features(trees, wanted, ["area"]).collect()
    assert (r.score, r.differences) == (1.0, 0) and "| area = 2" in r.text


def test_trees_as_json(spark):
    t = [("r", None, 0), ("a", "é\"", 1), ("b", None, 1), ("c", "", 2)]
    trees = spark.createDataFrame([("x", t)], f"tree_id string, seq {SEQ}")
    assert [tuple(n) for n in codec.from_json(codec.to_json(trees)).first().seq] == t
    bad = spark.createDataFrame([("x", "{"), ("y", '{"label": "l"}'), ("z", None)], "tree_id string, json string")
    got = {r.tree_id: (r.seq and [tuple(n) for n in r.seq], r.error is None) for r in codec.from_json(bad).collect()}
    assert got == {"x": (None, False), "y": ([("l", None, 0)], True), "z": (None, False)}


def test_trees_of_documents(spark):
    document = """{"meta": {"slug": "x-1", "n": null}, "normalized": {"fields": {"b": {"z": 1, "a": [], "c": {"d": "17 329"}, "languages": ["en", " ", null, {"k": "v"}]}, "a": ["p q", 2.5, true]}}}"""
    (r,) = codec.trees_of_documents(spark.createDataFrame([("x", document)], "tree_id string, document string")).collect()
    want = [
        ("x-1", None, 0), ("meta", None, 1), ("n", "", 2), ("slug", "x-1", 2), ("fields", None, 1), ("a", None, 2), ("a_item", "", 3), ("a_item", "2.5", 3), ("a_item", "True", 3),
        ("b", None, 2), ("z", "1", 3), ("a", None, 3), ("c", None, 3), ("d", "17.329", 4), ("languages", None, 3), ("languages_item", "en", 4), ("languages_item", None, 4), ("k", "", 5),
    ]
    assert [tuple(n) for n in r.seq] == want


def test_full_diff_and_patches(spark):
    t = [("r", None, 0), ("fields", None, 1), ("area", "1", 2), ("name", "x", 2)]
    u = [("r", None, 0), ("fields", None, 1), ("area", "2", 2), ("name", "x", 2), ("more", "3", 2)]
    pairs = spark.createDataFrame([("a", "b", t, u)], f"source_id string, target_id string, a {SEQ}, b {SEQ}")
    for algorithm in ("chawathe", "nj", "zhang_shasha"):
        (r,) = api.full_diff(pairs, algorithm).collect()
        assert (r.distance, r.matches_target, r.error) == (2, True, None) and r.report.startswith("Comparison: a -> b\nAlgorithm: ") and "| area = 2" in r.report
    assert "  1. Upd(R(s2), t2)\n  2. InsTree(t4, s1, 3)" in api.full_diff(pairs, "nj").first().report
    for made in (api.patch_clean(pairs), api.patch_script(pairs, api.ted.scripts(pairs, "nj"), "nj")):
        (r,) = made.collect()
        assert (r.score, r.differences, r.error) == (1.0, 0, None) and "| more = 3" in r.text
    trees = spark.createDataFrame([("a", t), ("b", u)], f"tree_id string, seq {SEQ}")
    wanted = spark.createDataFrame([("a", "b"), ("a", "zz")], "source_id string, target_id string")
    (r,) = api.patch_features(trees, wanted, None, ["area"]).collect()
    assert r.differences == 1 and "| area = 1" in r.text and "| more = 3" in r.text
    assert [tuple(x) for x in api.missing(trees, wanted).collect()] == [("a", "zz", "no tree for 'zz'")]
