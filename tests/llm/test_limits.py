"""What operators hold in memory and leave on disk."""

import time
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbordelta.llm import ann, common, packing, substrings, tokens


def _sent_super_windows(texts: list[bytes]) -> list[pa.RecordBatch]:
    """What chunks of one text each send to the only bucket, if every anchor is in two texts."""
    batches = []
    for i, x in enumerate(texts):
        chunk = substrings.Chunk(np.array([i]), np.array([len(x)]), x)
        distinct = substrings._anchors(chunk, 50, 20, 1)[0]
        ones, none = np.packbits(np.ones(len(distinct), bool)), np.packbits(np.zeros(len(distinct), bool))
        body = substrings._pack(chunk.ids, chunk.lengths, chunk.bytes)
        replies = [{"bucket": 0, "kind": 1, "payload": substrings._pack(ones, none)}]
        batches.append(pa.RecordBatch.from_pylist([{"chunk": chunk.key, "body_size": len(body), "body": pa.compress(body, codec="zstd", asbytes=True), "replies": replies}]))
    return list(substrings._send_super_windows(50, 20, 1)(iter(batches)))


def test_repeats_bucket_in_parts():
    """A bucket's arrays are those of a part of it, and its replies are runs, not windows."""
    text = np.random.default_rng(5).integers(97, 123, 1 << 20).astype(np.uint8).tobytes()
    sent = _sent_super_windows([text + b"a" * 60, text + b"b" * 60])
    tracemalloc.start()
    back = list(substrings._judge_super_windows(50, 2 << 20)(iter(sent)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = [r for b in back for r in b.to_pylist()]
    assert [r["kind"] for r in rows] == [4]
    first, count = substrings._unpack(rows[0]["payload"], np.int32, np.int32)
    assert (first.tolist(), count.tolist()) == ([0], [len(text) - 49])
    assert peak < 160 << 20, peak


def test_materialize_leaves_no_shuffle_files(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in folders for f in Path(d.toString()).rglob("shuffle_*")}
    before = files()
    assert len(common.materialize(spark.range(0, 1000, 1, 4).repartition(3, "id"), "test").collect()) == 1000
    for _ in range(50):  # files go in the background
        if not (left := {f for f in files() - before if f.suffix == ".data"}):
            break
        time.sleep(0.1)
    assert not left


def test_words_learned_are_few_bytes_and_forgotten_exactly(monkeypatch):
    """Kept words take arrays, not objects, and ids stay the library's while words are forgotten all the time."""
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(30_000)]
    texts = [" ".join(words[i] + (".", "", ",\n", "")[i % 4] for i in rng.integers(0, len(words), 400)) for _ in range(400)] + ["x" * 300 + " " + "A" * 300, "", "  two", "One. one ONE!"]
    for name, spaced in (("word_bpe_49k", False), ("byte_bpe_50k", True)):
        vocabulary = Path(public_tokenizers.path(f"{name}.json")).read_text()
        library = Tokenizer.from_str(vocabulary)
        want = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        encoder = tokens.PieceEncoder(vocabulary, spaced)
        encoder.encode(["a"])  # tables that do not grow
        tracemalloc.start()
        got = encoder.encode(texts)
        held = tracemalloc.get_traced_memory()[0] - sum(map(len, got))
        tracemalloc.stop()
        assert got == want
        assert held < 4 << 20, held
        with monkeypatch.context() as small:
            for limit, n in (("MAX_WORDS", 500), ("MAX_RECENT", 50), ("MAX_IDS", 2000)):
                small.setattr(tokens, limit, n)
            encoder = tokens.PieceEncoder(vocabulary, spaced)
            assert [encoder.encode([t])[0] for t in texts] == want
            assert len(encoder.words.kept[0]) <= 1000


def test_packing_gives_pieces_out_within_a_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(packing, "arrow_map", lambda rows, run, schema: run)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, size=16)
    n = 30_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["one two three four five six seven"[: 5 + i % 28] for i in range(n)]})
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert sum(sizes) >= n and len(sizes) >= 4 and max(sizes[:-1]) < n // 2, sizes


def test_neighbours_copy_no_queries_to_shards(spark):
    """With many shards and blocks of queries, no shuffle or broadcast holds vectors, and a group of shards gives k rows a query."""
    v = np.random.default_rng(2).normal(size=(600, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = ann.nearest(rows, F.col("vec_id") % 10 == 0, k=5, shard_rows=40, block=8, tasks=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Broadcast" not in plan
    assert all("queries" not in x and "vectors" not in x for x in plan.split("\n") if "Exchange" in x)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
    assert len(got) == 60 * 5
    want = {(q, j + 1): x for q in range(0, 600, 10) for j, x in enumerate(np.argsort(-near[q], kind="stable")[:5].tolist())}
    assert sum(got[key] == x for key, x in want.items()) >= 0.97 * len(want)
