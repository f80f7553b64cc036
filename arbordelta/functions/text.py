"""Scalar text functions as column expressions. All stay in the JVM and are ordinary parts of a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and field names that results depend on.
NUMBER = r"[-+]?(?:[0-9]{1,3}(?:[,\x{A0}][0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
YEAR = r"\b((?:19|20)[0-9]{2})\b"
NAME_FIELDS = ("head_of_government", "head_of_state", "capital", "country_name")
NUMERIC_FIELDS = ("gdp_nominal_total", "gdp_ppp_total")
COORDINATES = ("latitude", "longitude")
#: Runs of what is not an ASCII letter or digit. The class [^0-9A-Za-z] is the same, but Java took 25 times as long for it.
NOT_WORD = r"[\W_]+"
RAW_LABELS = ("retrieved_at", "wikipedia_url", "slug", "source")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def _none_if_empty(x: Column) -> Column:
    return F.when(x != "", x)


def normalize_key(x) -> Column:
    """Lower case, runs of other characters become one `_`, none at the ends; `field` if nothing is left."""
    body = F.regexp_replace(F.lower(_c(x)), NOT_WORD, "_")
    return F.coalesce(_none_if_empty(F.regexp_replace(body, r"^_+|_+$", "")), F.lit("field"))


def tokenize(x) -> Column:
    return F.filter(F.split(_c(x), NOT_WORD), lambda t: t != "")


def parse_numbers(x) -> Column:
    """array<struct<txt, dbl, is_int>> of the numbers in reading order."""
    return F.transform(
        F.regexp_extract_all(_c(x), F.lit(NUMBER), F.lit(0)),
        lambda m: F.struct(F.translate(m, ", ", "").alias("txt"), F.translate(m, ", ", "").cast("double").alias("dbl"), (~m.contains(".")).alias("is_int")),
    )


def first_year(x) -> Column:
    return F.regexp_extract(_c(x), YEAR, 1).try_cast("int")


def collapse(x) -> Column:
    return strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def extract_rank(x) -> Column:
    """The ordinal in parentheses, else the first ordinal word."""
    first, second = (F.regexp_extract(_c(x), p, 1) for p in (r"(?i)\(([0-9]+)(?:st|nd|rd|th)\)", r"(?i)\b([0-9]+)(?:st|nd|rd|th)\b"))
    return F.coalesce(first.try_cast("int"), second.try_cast("int"))


def strip_rank(x) -> Column:
    return strip(F.regexp_replace(_c(x), r"(?i)\s*\(\s*[0-9]+(?:st|nd|rd|th)\s*\)\s*$", ""))


def digits_only(x) -> Column:
    return _none_if_empty(F.regexp_replace(_c(x), r"[^0-9]+", ""))


def split_list(x) -> Column:
    return F.filter(F.transform(F.split(_c(x), r"[;,·]|\s/\s"), lambda t: strip(t)), lambda t: t != "")


def split_domains(x) -> Column:
    return F.filter(F.split(_c(x), r"(?U)[\s,;]+"), lambda t: t != "")


def utc_offset(x) -> Column:
    found = F.regexp_replace(F.regexp_extract(_c(x), r"UTC\s*[+-]?[0-9]+(?::[0-9]+)?", 0), r"\s+", "")
    return F.coalesce(_none_if_empty(found), strip(x))


def human_index(x) -> Column:
    """The first number above 0 and up to 1, rounded to 4 places."""
    return F.bround(F.try_element_at(F.filter(parse_numbers(x), lambda n: (n["dbl"] > 0) & (n["dbl"] <= 1)), F.lit(1))["dbl"], 4)


def capital_name(x) -> Column:
    body = F.substring_index(_c(x), "Country:", 1)
    body = F.regexp_replace(body, r"[0-9]{1,3}°.*$", "")
    return collapse(F.regexp_replace(body, r"\s*[0-9]+\s*$", ""))


def coordinates(x) -> Column:
    lat, lon = (_none_if_empty(F.regexp_extract(_c(x), p, 0)) for p in ("[0-9]{1,2}°[0-9]{1,2}′[NS]", "[0-9]{1,3}°[0-9]{1,2}′[EW]"))
    return F.struct(lat.alias("latitude"), lon.alias("longitude"))


def currency(x) -> Column:
    name = strip(F.substring_index(_c(x), "(", 1))
    return F.struct(F.coalesce(_none_if_empty(name), strip(x)).alias("name"), _none_if_empty(F.regexp_extract(F.regexp_extract(_c(x), r"\(([^)]*)\)", 1), r"\b([A-Z]{3})\b", 1)).alias("code"))


def slugify(x) -> Column:
    return F.translate(F.lower(strip(x)), " (),", "_")


def display_name(name, slug) -> Column:
    return F.coalesce(_none_if_empty(_c(name)), F.initcap(F.replace(_c(slug), F.lit("_"), F.lit(" "))))


def merge_tokens(tokens, label) -> Column:
    """One string of a leaf's tokens: digit groups are joined by points, with a unit word after them if there is one."""
    t, label = _c(tokens), _c(label)
    head, last = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.try_element_at(t, F.lit(-1))
    number = lambda a: F.forall(a, lambda v: v.rlike(r"^[0-9]+$"))
    spaced = F.array_join(t, " ")
    unit = F.concat(F.array_join(head, "."), F.lit(" "), last)
    with_unit = F.when(label.isin(*NUMERIC_FIELDS), ~last.rlike(r"^[0-9]+$")).otherwise(last.rlike(r"(?U)^\p{Alpha}+$"))
    return (
        F.when(F.size(t) == 0, "").when(label.isin(*NAME_FIELDS, *COORDINATES), spaced).when(F.size(t) == 1, last)
        .when(number(head) & with_unit, unit).when(number(t), F.array_join(t, ".")).otherwise(spaced)
    )


def leaf_tokens(x) -> Column:
    return F.filter(F.split(_c(x), r"(?U)[^\w]+"), lambda t: (t != "") & ((F.length(t) > 1) | t.rlike(r"^[0-9]$") | t.isin("N", "E")))


def leaf_value(label, value) -> Column:
    """The text that a scalar becomes as a leaf."""
    label, v = _c(label), F.coalesce(_c(value), F.lit(""))
    raw = label.isin(*RAW_LABELS) | v.startswith("UTC") | v.rlike(r"^[0-9]+\.[0-9]+$") | v.rlike(r"[T\-:]")
    return F.when(raw, v).otherwise(merge_tokens(leaf_tokens(v), label))


def scalar_key(x) -> Column:
    """A canonical text by which two leaf values compare: 1 and 1.0 are equal, and spaces at the ends don't count."""
    v = strip(x)
    whole = v.rlike(r"^[+-]?[0-9]{1,38}$")
    point = v.rlike(r"^[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    number = v.try_cast("double")
    return F.when(whole, v.try_cast("decimal(38,0)").cast("string")).when(point & (F.abs(number) < 1e15) & (number == F.floor(number)), number.try_cast("decimal(38,0)").cast("string")).when(point, number.cast("string")).otherwise(v)


def segments(path) -> Column:
    return F.filter(F.split(_c(path), r"\."), lambda s: s != "")


def segment_base(s) -> Column:
    return F.substring_index(_c(s), "[", 1)


def normalize_path(path) -> Column:
    p = strip(path)
    return F.when((p == "") | p.startswith("fields.") | p.startswith("meta."), p).otherwise(F.concat(F.lit("fields."), p))


def path_label(path) -> Column:
    return F.initcap(F.replace(segment_base(F.try_element_at(_c(path), F.lit(-1))), F.lit("_"), F.lit(" ")))


def xml_name(x) -> Column:
    body = F.regexp_replace(strip(x), r"[^0-9A-Za-z_.\-]+", "_")
    return F.when(body == "", "node").when(body.rlike(r"^[A-Za-z_]"), body).otherwise(F.concat(F.lit("n_"), body))
