"""Edge cases of the pipeline's stages and of operators beside clashing columns, and the queries that have SQL."""

import os
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arbordelta.llm import ann, language, queries, secrets, stages, warc
from arbordelta.llm.common import materialize

D = "/root/testdata/sf0.001"
#: Columns that the operators use themselves, in the documents.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, found string, _row long, _size int, class_id long, kept boolean, node long, copy string, row long, size long, taken long"
LONG = " ".join(f"w{k}" for k in range(40_000)) + " password=hunter2hunter2"
SOME = "the cat sat on the mat and then it went away again for good"


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, "zz", "f", 7, 8, 9, True, 1, "c", 2, 3, 4)


ROWS = [row(1, SOME), row(2, SOME), row(2, "token: abcdef123 " + SOME[::-1]), row(None, SOME), row(None, "quite another text it is, without any number"), row(5, None), row(6, ""), row(7, "12 34 56"), row(8, LONG), row(9, "der Hund", None, None), row(9, "der Hund", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(ROWS, CLASH).repartition(3), "test")


@pytest.mark.parametrize("name", ["identify_language", "drop_near_duplicates", "redact_secrets", "mix_sources"])
def test_stages_keep_columns_and_take_empty_tables(spark, docs, name):
    stage = getattr(stages, name)
    got = stage(spark, docs, D)
    assert got.columns == docs.columns and got.schema["score"] == docs.schema["score"]
    for r in got.collect():
        assert (r.score, r.found, r._row, r._size, r.class_id, r.node, r.copy) == (0.5, "f", 7, 8, 9, 1, "c")
    nothing = stage(spark, docs.where("false"), D)
    assert nothing.columns == docs.columns and nothing.count() == 0


def test_language_stage(spark, docs):
    got = stages.identify_language(spark, docs, D).collect()
    # Learned from the documents themselves: all have a language but those without a letter.
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS if r[1] and any(map(str.isalpha, r[1]))) and {r.lang for r in got} == {"en"} and {r.lang_pred for r in got} == {"zz"}


def test_near_duplicate_stage_judges_rows(spark, docs):
    got = Counter((r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, D).collect())
    want = Counter((r[0], r[1]) for r in ROWS)
    for gone in ((2, SOME), (None, SOME), (9, "der Hund")):
        want[gone] -= 1
    assert got == +want


def test_secret_stage(spark, docs):
    got = Counter((r.doc_id, r.text, r.n_chars) for r in stages.redact_secrets(spark, docs, D).collect())
    mask = lambda t: t and t.replace("token: abcdef123", "[REDACTED]").replace("password=hunter2hunter2", "[REDACTED]")
    assert got == Counter((r[0], mask(r[1]), None if r[1] is None else len(mask(r[1]))) for r in ROWS)


def test_mixing_stage(spark, docs):
    got = stages.mix_sources(spark, docs, D).collect()
    assert {r.text for r in got} <= {r[1] for r in ROWS} | {r.text for r in got if any((t or "").startswith(r.text) for t in (x[1] for x in ROWS))} and all(r.text for r in got)
    words = sum(len(r[1].split()) for r in ROWS if r[1])
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * words) <= 2


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter()
    for r in stages.pack_sequences(spark, docs, D).collect():
        got[r.doc_id] += r.length
    want = Counter()
    for r in ROWS:
        want[r[0]] += len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert got == want and stages.pack_sequences(spark, docs.where("false"), D).count() == 0


def test_redaction_beside_clashing_columns(docs):
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).where("text like '%hunter2%'").count() == 0


def test_operators_beside_clashing_columns(spark):
    pages = spark.createDataFrame([(i, "u", "<p>" + "x" * (50_000 if i == 2 else 120), 1, 2, "d", "a") for i in range(4)], "page_id long, url string, html string, digest int, refers_to int, archive string, record string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {0: ("response", None, 123), 1: ("revisit", 0, 123), 2: ("response", None, 50_003), 3: ("revisit", 0, 123)}
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0, 0.5], 1.0, 2, 3, "v") for i in range(60)], "vec_id long, embedding array<float>, score double, rank int, shard int, v string")
    assert ann.nearest(vectors, F.col("vec_id") % 50 == 0).count() == 10


def test_the_language_sample_has_a_fixed_size(spark, monkeypatch):
    monkeypatch.setattr(language, "Model", lambda x, langs: Counter(langs))
    rows = [(f"text {k}", "aa") for k in range(3000)] + [("one text", "bb")] * 3000
    assert language.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=60) == {"aa": 60, "bb": 1}


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, D).toPandas(), con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))  # noqa: E731, B023
        assert rows(got) == rows(want), name
