"""Secret scans by multipart credential linking, in DataFrame functions only.

Parts of a credential are found by pattern in whole texts: access identifiers, secrets and endpoints. Strong parts
(assign, access, hex) are reported as they are. Weak ones (a user or client name, a random-looking key, an address) are
reported only if the parts that complete them lie within `scope` code points: a weak identifier needs a secret, a weak key
an identifier, an endpoint both. That is an interval join of the parts with themselves inside a document; as only the
nearest part on either side matters, it is done by running windows, so dense documents make no pairs.

Positions: split() and regexp_extract_all() give the texts between and in the matches; running sums of their
lengths are the offsets in code points. Only lengths leave the scan, never texts.

Defined cases: null text is empty and gives no spans (the sha256 of the empty string); repeated rows are scanned each;
equal starts are ordered by kind as listed, then end; weak parts inside a strong span are dropped; an empty table gives
no rows; other columns are not read. redact() leaves a null text null and reads spans by a number written with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, text_or_empty

# The patterns of the parts. Hex runs are maximal, so asking for 24 in the pattern finds the same ones.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
WEAK_ID = r"""(?<![A-Za-z0-9_])(?i:client_?id|user_?name|account_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_KEY = r"(?<![A-Za-z0-9+/=_.-])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?"
KINDS = ("assign", "access", "hex", "weak_id", "weak_key", "endpoint")
STRONG = 3
#: Kinds that identify an account, and kinds that are a secret.
IDENTIFIERS, SECRETS = (1, 3), (0, 2, 4)


def _found(text: Column, kind: int, pattern: str, least: int = 0, group: int | None = None) -> Column:
    """Array of (kind, i, gap, len, ok): the length before match i since the one before it, its own length, and if it counts."""
    parts = [F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))]
    if group is not None:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    measured = F.transform(
        F.arrays_zip(*parts),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["0"]).alias("gap"), F.length(x["1"]).alias("len"),
            (F.length(x["1" if group is None else "2"]) >= least).alias("ok"),
        ),
    )
    return F.filter(measured, lambda x: x["len"].isNotNull())


def parts(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, row, kind, start, end: a row for each part, and one without a kind for a document that has none.

    row tells rows apart: the column `key`, or a number given here.
    """
    text = F.col("text")
    none = F.expr("cast(array() as array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>)")
    found = F.flatten(
        F.array(
            _found(text, 0, ASSIGN, 6, 2),
            F.when(text.contains("AKIA"), _found(text, 1, ACCESS, 20)).otherwise(none),
            _found(text, 2, HEX, 24),
            F.when(text.rlike(r"[:=]"), _found(text, 3, WEAK_ID)).otherwise(none),
            _found(text, 4, WEAK_KEY),
            F.when(text.contains("://"), _found(text, 5, ENDPOINT)).otherwise(none),
        )
    )
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.monotonically_increasing_id() if key is None else F.col(key)).alias("row"), text_or_empty().alias("text")).select("doc_id", "row", found.alias("found"))
    rows = scanned.select("doc_id", "row", F.explode_outer("found").alias("p")).select("doc_id", "row", "p.*").repartition("doc_id", "row")
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("doc_id", "row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", end).where("ok is null or ok")
    return rows.select("doc_id", "row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def link(found: DataFrame, scope: int) -> DataFrame:
    """Adds `kept`: a strong part, or a weak one whose complements are within scope."""
    document = W.partitionBy("doc_id", "row")
    ahead = document.orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1)
    behind = document.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)

    def near(kinds: tuple[int, ...]) -> Column:
        own = F.col("kind").isin(*kinds)
        before, after = F.max(F.when(own, F.col("end"))).over(ahead), F.min(F.when(own, F.col("start"))).over(behind)
        return F.coalesce(before >= F.col("start") - scope, F.lit(False)) | F.coalesce(after <= F.col("end") + scope, F.lit(False))

    covered = F.coalesce(F.max(F.when(F.col("kind") < STRONG, F.col("end"))).over(ahead) > F.col("start"), F.lit(False))
    needs = F.when(F.col("kind") == 3, near(SECRETS)).when(F.col("kind") == 4, near(IDENTIFIERS)).otherwise(near(SECRETS) & near(IDENTIFIERS))
    return found.withColumn("kept", F.when(F.col("kind") < STRONG, True).otherwise(needs & ~covered))


def scan(docs: DataFrame, scope: int = 256, key: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, row, n_assign, n_access, n_hex, n_weak, base_sha256, spans, found (array of start, kind, end)."""
    linked = link(parts(docs, key), scope)
    entry = F.struct("start", "kind", "end")
    rows = linked.groupBy("doc_id", "row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(STRONG)],
        F.count_if((F.col("kind") >= STRONG) & F.col("kept")).alias("n_weak"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), entry))).alias("found"),
    )
    names = F.array(*map(F.lit, KINDS))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    strong = F.filter("found", lambda x: x["kind"] < STRONG)
    return rows.select("doc_id", "row", "n_assign", "n_access", "n_hex", "n_weak", F.sha2(said(strong).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), "found")


def report(docs: DataFrame, scope: int = 256) -> DataFrame:
    return scan(docs, scope).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak")


def redact(docs: DataFrame, scope: int = 256, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every reported span of text replaced by mask (overlapping spans by one).

    The rows are written once with a number; the spans are found in what was written and meet their text by that number.
    """
    row, own, spans = fresh(docs, "_row", "_own", "_spans")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    merged = F.aggregate(
        "found",
        none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] > x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["end"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("a"), x["end"].alias("b"))))),
    )
    found = scan(numbered, scope, row).where(F.size("found") > 0).select(F.col("row").alias(own), merged.alias(spans))
    rows = numbered.join(found.hint("merge"), F.col(row) == F.col(own), "left")
    text, after = F.col("text"), lambda i: F.when(i > 0, F.try_element_at(spans, i)["b"]).otherwise(0)
    head = F.transform(spans, lambda x, i: text.substr((after(i) + 1).cast("int"), (x["a"] - after(i)).cast("int")))
    tail = text.substr((F.try_element_at(spans, F.lit(-1))["b"] + 1).cast("int"), F.length(text))
    masked = F.when(F.col(spans).isNull(), text).otherwise(F.concat(F.array_join(head, mask), F.lit(mask), tail))
    return rows.withColumn("text", masked).select(*docs.columns)
