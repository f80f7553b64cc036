"""Stages of the corpus pipeline: each keeps or changes documents and returns their columns (but the last).

A stage's result is to be written before the next stage is called: then the files the stage made for itself are deleted.
Defined cases of every stage: rows are told apart by a number of their own, so repeated rows, rows that share a doc_id and rows
without one are judged each; extra columns of any name are kept as they are; an empty table gives no rows; very long texts
are read whole. A null text has no language and leaves in the first stage; given to the others by themselves, it is a
class of its own, has no secrets and stays null, has size 0 and is not taken by the mix, and packs as the end id alone. An
empty or blank text is like a null one, but stays as it is. Ties: of equal documents the first by doc_id, then by number, stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, language, mixing, packing, secrets
from .common import WORD, fresh, materialize, staged


@staged
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go; lang becomes the predicted one."""
    model = language.fit(docs.where(~language.held_out()))
    # Columns travel by place, so none of theirs clashes with the operator's.
    found = language.predict(docs, model, {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}).where("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred" if c == "lang" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


@staged
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id (null last), of several rows with it any one."""
    row, own = fresh(docs, "_row", "_own")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    stays = bagminhash.near_duplicates(numbered, key=row).where("kept").select(F.col(row).alias(own))
    return numbered.join(stays.hint("merge"), F.col(row) == F.col(own), "left_semi").select(*docs.columns)


@staged
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span becomes a mark; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, WORD, -1)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    both = F.arrays_zip(F.slice(pieces, F.lit(1), n), F.slice(words, F.lit(1), n))
    return F.array_join(F.transform(both, lambda x: F.concat(x["0"], x["1"])), "")


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a part of a copy is the document's first words. Documents not taken go.

    Rows are told apart by a number of their own, written with them, so documents without doc_id and repeated rows are mixed like all others.
    """
    row, own, size, taken, copy = fresh(docs, "_row", "_own", "_size", "_taken", "_copy")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plan = mixing.mix(numbered, key=row).where("taken > 0").select(F.col(row).alias(own), F.col("size").alias(size), F.col("taken").alias(taken))
    rows = numbered.join(plan.hint("merge"), F.col(row) == F.col(own))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    words = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    text = F.when(words < F.col(size), _first_words(F.col("text"), words)).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@staged
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
