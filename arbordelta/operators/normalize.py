"""Infobox rows to fields, fields to comparison values, comparison values to trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.trees import SEQ


def fields(rows: DataFrame) -> DataFrame:
    """entity, key, pos, raw_label, text from rows (entity, pos, label, value_text).

    GDP rows set a context that bulleted total and per-capita rows after them inherit and any other row ends. Of equal keys
    the last value counts, at the first one's place.
    """
    base = T.normalize_key("label")
    r = rows.withColumns({"base": base, "bullet": T.strip("label").startswith("•")})
    gdp = F.col("base").isin("gdp_ppp", "gdp_nominal")
    mark = F.when(gdp, F.col("base")).when(~F.col("bullet"), F.lit(""))
    context = F.last(mark, ignorenulls=True).over(W.partitionBy("entity").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    tail = T.normalize_key(F.regexp_replace("label", r"(?U)^\s*•+\s*", ""))
    key = F.when(F.col("bullet") & (F.col("context") != "") & tail.isin("total", "per_capita"), F.concat_ws("_", "context", tail)).otherwise(F.col("base"))
    r = r.withColumn("context", context).withColumn("key", key)
    last = F.max(F.struct("pos", F.col("label").alias("raw_label"), T.strip("value_text").alias("text")))
    return r.groupBy("entity", "key").agg(F.min("pos").alias("pos"), last.alias("x")).select("entity", "key", "pos", "x.raw_label", "x.text")


def _number(x: Column) -> Column:
    """A double as short decimal text with a point."""
    return F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0")))


def comparison(found: DataFrame, names: DataFrame) -> DataFrame:
    """entity, leaves: array of (path array, place, value): the curated values of each entity. names: entity, country_name."""
    kind = "map<string,struct<text:string,raw_label:string>>"
    m = found.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.struct("text", "raw_label")))).cast(kind).alias("m"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "key", "text", "raw_label"))), lambda x: F.struct(x["key"].alias("key"), x["text"].alias("text"), x["raw_label"].alias("raw_label"))).alias("all"),
    )
    get = lambda *keys: F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in keys])
    txt = lambda *keys: get(*keys)["text"]
    has = lambda *keys: get(*keys).isNotNull()
    first_number = lambda x: F.try_element_at(T.parse_numbers(x), F.lit(1))["dbl"]
    named = lambda test: F.try_element_at(F.filter("all", test), F.lit(1))
    out: list[Column] = []

    def leaf(path: str, value: Column, when: Column | None = None) -> None:
        """A leaf if value is not null, or if `when` holds (null is then empty)."""
        v = value.cast("string")
        out.append(F.when(v.isNotNull() if when is None else when, F.array(F.struct(F.split(F.lit(path), r"\.").alias("path"), F.lit(0).alias("place"), v.alias("value")))))

    def items(path: str, values: Column, when: Column) -> None:
        label = path.rpartition(".")[2] + "_item"
        out.append(F.when(when, F.transform(values, lambda x, i: F.struct(F.split(F.lit(f"{path}.{label}"), r"\.").alias("path"), i.alias("place"), x.alias("value")))))

    leaf("country_name", F.when(F.col("country_name") != "", F.col("country_name")))
    leaf("official_name", txt("official_name"))
    capital = txt("capital", "capital_and_largest_city")
    shown = lambda c: F.coalesce(F.when(T.capital_name(c) != "", T.capital_name(c)), c)
    leaf("capital", shown(capital))
    leaf("largest_city", F.when(capital.isNotNull(), F.coalesce(T.capital_name(txt("largest_city")), shown(capital))))
    at = T.coordinates(capital)
    placed = F.coalesce(at["latitude"], at["longitude"]).isNotNull()
    leaf("coordinates.latitude", at["latitude"], placed)
    leaf("coordinates.longitude", at["longitude"], placed)
    items("languages.official", T.split_list(txt("official_languages")), has("official_languages"))
    minority = ("recognised_minority_language", "recognised_minority_languages")
    items("languages.recognized_minority", T.split_list(txt(*minority)), has(*minority))
    leaf("government.type", txt("government"))
    leaf("government.head_of_state", txt("president", "monarch", "king", "queen", "emir", "supreme_leader"))
    leaf("government.head_of_government", txt("prime_minister", "chancellor", "premier"))
    leaf("government.speaker_of_parliament", txt("speaker_of_parliament", "parliament_speaker"))
    leaf("legislature", txt("legislature"))
    leaf("area.total_km2", first_number(txt("area_total")).cast("long"))
    leaf("area.water_percent", _number(first_number(txt("area_water_percent", "area_water"))))
    # The first population row counts: the year in a key never stands between word borders.
    count = named(lambda x: x["key"].startswith("population_") & (x["key"].contains("estimate") | x["key"].contains("census")))
    leaf("population.year", F.coalesce(T.first_year(count["raw_label"]), T.first_year(count["text"]), T.first_year(count["key"])))
    leaf("population.total", F.try_element_at(F.filter(T.parse_numbers(count["text"]), lambda n: n["dbl"] >= 10000), F.lit(1))["dbl"].cast("long"))
    leaf("population.rank", T.extract_rank(count["text"]))
    leaf("population.density_per_km2", _number(first_number(txt("population_density"))))
    for kind_, mark in (("ppp", "GDP ( PPP"), ("nominal", "GDP (nominal")):
        year = F.coalesce(T.first_year(txt(f"gdp_{kind_}")), T.first_year(get(f"gdp_{kind_}")["raw_label"]))
        leaf(f"economy.gdp_{kind_}_year", year, has(f"gdp_{kind_}"))
        for part, said in (("total", "Total"), ("per_capita", "Per capita")):
            other = named(lambda x: x["raw_label"].contains(mark) & x["raw_label"].contains(said))["text"]  # noqa: B023
            leaf(f"economy.gdp_{kind_}_{part}", T.strip_rank(F.coalesce(txt(f"gdp_{kind_}_{part}"), other)))
    index = F.concat(F.filter("all", lambda x: x["key"] == "hdi"), F.array_sort(F.filter("all", lambda x: x["key"].startswith("hdi_"))))
    said = F.array_join(F.filter(F.transform(index, lambda x: x["text"]), lambda x: x != ""), " ")
    years = F.concat(F.transform(index, lambda x: F.coalesce(T.first_year(x["key"]), T.first_year(x["raw_label"]), T.first_year(x["text"]))), F.array(T.first_year(said)))
    leaf("development.hdi.year", F.array_max(years), F.size(index) > 0)
    leaf("development.hdi.value", T.human_index(said), F.size(index) > 0)
    leaf("development.hdi.rank", T.extract_rank(said), F.size(index) > 0)
    gini = F.try_element_at(F.array_sort(F.filter("all", lambda x: x["key"].startswith("gini"))), F.lit(-1))
    number = F.try_element_at(T.parse_numbers(gini["text"]), F.lit(1))
    leaf("development.gini.year", F.coalesce(T.first_year(gini["key"]), T.first_year(gini["raw_label"])), gini.isNotNull())
    leaf("development.gini.value", F.when(number["is_int"], number["dbl"].cast("long").cast("string")).otherwise(_number(number["dbl"])), gini.isNotNull())
    money = T.currency(txt("currency"))
    leaf("currency.name", F.when(has("currency") & (money["name"] != ""), money["name"]))
    leaf("currency.code", F.when(has("currency"), money["code"]))
    leaf("calling_code", F.coalesce(T.digits_only(txt("calling_code")), txt("calling_code")))
    leaf("iso_3166_code", txt("iso_3166_code"))
    items("internet_tld", T.split_domains(txt("internet_tld")), has("internet_tld"))
    leaf("time_zone.standard", T.utc_offset(txt("time_zone")))
    leaf("time_zone.dst", F.when(has("time_zone"), T.utc_offset(txt("summer_dst", "time_zone_dst"))))
    leaf("demonym", txt("demonym"))
    none = F.expr("cast(array() as array<struct<path:array<string>,place:int,value:string>>)")
    return m.join(names, "entity", "left").select("entity", F.flatten(F.array(*[F.coalesce(x, none) for x in out])).alias("leaves"))


def trees(values: DataFrame, meta: DataFrame) -> DataFrame:
    """tree_id, seq: root (the entity) with meta (entity, name, value rows) and fields.

    Below fields names ascend; deeper, leaves come before groups. A group stands before its first leaf.
    """
    key = lambda p: F.transform(p, lambda s, i: F.when(i == 0, s).when(i == F.size(p) - 1, F.concat(F.lit("0"), s)).otherwise(F.concat(F.lit("1"), s)))
    ranked = F.array_sort(F.transform("leaves", lambda x: F.struct(key(x["path"]).alias("k"), x["place"].alias("place"), x["path"].alias("path"), T.leaf_value(F.element_at(x["path"], -1), x["value"]).alias("value"))))
    body = f"""flatten(transform(ranked, (x, i) -> concat(
      transform(filter(sequence(1, size(x.path)), d -> d < size(x.path) and (i = 0 or not (slice(ranked[i - 1].path, 1, d) <=> slice(x.path, 1, d)))),
        d -> struct(x.path[d - 1] as label, cast(null as string) as value, cast(d + 1 as int) as depth)),
      array(struct(x.path[size(x.path) - 1] as label, x.value as value, cast(size(x.path) + 1 as int) as depth)))))"""
    head = meta.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("name", F.coalesce("value", F.lit("")).alias("value")))).alias("meta"))
    rows = values.withColumn("ranked", ranked).withColumn("body", F.expr(body)).join(head, "entity", "left")
    node = lambda label, depth: F.struct(label.cast("string").alias("label"), F.lit(None).cast("string").alias("value"), F.lit(depth).alias("depth"))
    empty = F.expr(f"cast(array() as {SEQ})")
    metas = F.when(F.size("meta") > 0, F.concat(F.array(node(F.lit("meta"), 1)), F.transform("meta", lambda x: F.struct(x["name"].alias("label"), T.leaf_value(x["name"], x["value"]).alias("value"), F.lit(2).alias("depth")))))
    below = F.when(F.size("body") > 0, F.concat(F.array(node(F.lit("fields"), 1)), F.col("body").cast(SEQ)))
    return rows.select(F.col("entity").alias("tree_id"), F.concat(F.array(node(F.col("entity"), 0)), F.coalesce(metas, empty), F.coalesce(below, empty)).alias("seq"))
