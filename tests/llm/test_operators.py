"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbordelta.llm import ann, bagminhash, language, media, mixing, packing, secrets, shingles, substrings, suffix_array, token_files, tokens, warc

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kind int"
LONG = "word " * 60_000
EDGE = [
    (5, None, None, None, None, "x", 1), (3, "", "en", "s", 0, "x", 1), (4, "a", "en", "s", 1, None, None), (9, LONG, "en", None, 300_000, "x", 1),
    (None, "no id here, five words", "de", "t", 3, "x", 1), (11, "same text twice over again ok", "en", "s", 9, "x", 1), (11, "same text twice over again ok", "en", "s", 9, "x", 1), (12, "\U0001F600 é \x00 nul", "en", "s", 3, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{D}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- 1 ----
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


def test_secrets_base(docs, texts, spark, edge, empty):
    more = ["é😀 password: hunter22 token=ab Secret = 'abcdef'", "AKIA" + "Z" * 16 + " AKIAshort " + "0a" * 12, "secret: token: abcdefg api_key=x.y-z_1", "0a" * 3000]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    every = texts | {1000 + i: t for i, t in enumerate(more)}
    got = {r.doc_id: r for r in secrets.report(docs.select("doc_id", "text").union(extra)).collect()}
    for i, t in every.items():
        want = base_spans(t or "")
        assert got[i].base_sha256 == sha(want.encode()) and set(want.split(",")) - {""} <= set(got[i].spans.split(",")), i
        assert got[i].n_assign + got[i].n_access + got[i].n_hex == (want.count(",") + 1 if want else 0)
    assert secrets.report(empty).count() == 0
    assert secrets.report(edge).count() == len(EDGE)


def test_secrets_link_weak_parts_only_when_they_co_occur(spark):
    key, gap = "aB3" + "xY7zQ9wK" * 4, " lorem ipsum" * 60
    rows = [(1, f"login=alice {key} https://db.example.com/x"), (2, f"see {key} and https://db.example.com/x"), (3, f"login=alice {gap} {key}"), (4, f"login=alice {gap}"), (5, f"AKIA{'Q' * 16} {key}")]
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["weak_id", "weak_key", "endpoint"], 2: [], 3: [], 4: [], 5: ["access", "weak_key"]}


def test_secrets_link_keys_of_any_length(spark):
    rows = [(n, "login=alice " + ("aB3" + "xY7zQ9wK" * (n // 8 + 1))[:n]) for n in (32, 124, 128, 129, 132, 5000)]
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: f"weak_id:0:11,weak_key:12:{12 + n}" for n, _ in rows}


def test_redaction(spark):
    rows = [(1, "a token = \"" + "0f" * 12 + "\" b", "x"), (2, "plain", "y"), (None, None, "z")]
    got = [r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, keep string")).orderBy("keep").collect()]
    assert got == ['a [REDACTED]" b', "plain", None]


# ---- 2 ----
def brute_repeats(rows, length):
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[substrings.NO_ID if i is None else i].append((t or "").encode())
    seen, out = set(), []
    for i in sorted(by_id):
        own = set()
        for b in by_id[i]:
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                own.add(w)
                if w in seen:
                    gone[k : k + length] = True
            kept = bytes(np.frombuffer(b, np.uint8)[~gone])
            out.append((None if i == substrings.NO_ID else i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), sha(kept)))
        seen |= own
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeats(docs, texts, edge, empty, hot):
    got = [tuple(r) for r in substrings.remove_repeats(docs, chunk_bytes=50_000, bucket_bytes=1 << 20, hot=hot).collect()]
    assert sorted(got, key=repr) == brute_repeats(texts.items(), 50)
    rows = [(r[0], r[1]) for r in EDGE]
    assert sorted((tuple(r) for r in substrings.remove_repeats(edge, chunk_bytes=1000).collect()), key=repr) == brute_repeats(rows, 50)
    assert substrings.remove_repeats(empty).count() == 0


def test_two_stage_suffix_array():
    rng = np.random.default_rng(2)
    for _ in range(40):
        parts = [bytes(rng.integers(0, rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        t = suffix_array.join(np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts))))
        sa = suffix_array.suffix_array(t, 50)
        content = lambda p: tuple(t[p : p + int(np.flatnonzero(t[p:] == 0)[0])].tolist())[:50]  # noqa: E731, B023
        order = [content(p) for p in sa.tolist()]
        assert sorted(sa.tolist()) == list(range(len(t))) and order == sorted(order)
        want = [next((k for k in range(50) if k >= len(a) or k >= len(b) or a[k] != b[k]), 50) for a, b in zip(order, order[1:])]
        assert suffix_array.common_prefixes(t, sa, 50).tolist() == want


# ---- 3 ----
def test_media_round_trip(docs, texts, edge, empty):
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for i, t in texts.items():
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == (len(b), len(p), sha(p), zlib.crc32(p[-16:]), sha(media.encode(p, len(b))))
        assert r.samples == 1152 * len(p) // 192 == 1152 * len(r.frame_offsets) and r.seconds == r.samples / 48000
    assert media.media_columns(edge).count() == len(EDGE) and media.media_columns(empty).count() == 0


def test_media_reader_resynchronises_and_checks():
    p = bytes(range(32, 127)) * 20
    p = p[: len(p) // 192 * 192]
    data = media.encode(p, len(p))
    s = media.decode(data)
    assert b"".join(s.ancillary) == p and s.crc_errors == 0 and s.tag_crc_ok and s.table == "Info" and s.table_frames == len(s.offsets)
    cut = data[: s.offsets[3]] + b"junk\xff\xfbjunk" + data[s.offsets[3] :]
    again = media.decode(cut)
    assert b"".join(again.ancillary) == p and again.resyncs >= 1 and again.skipped == 10
    bad = bytearray(data)
    bad[s.offsets[2] + 8] ^= 1  # side information
    assert media.decode(bytes(bad)).crc_errors == 1
    assert media.decode(b"").offsets == [] and media.decode(b"\xff" * 50).offsets == []


# ---- 4 and 9 ----
def ids_of(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text, add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piecewise_encoding_is_the_libraries(name, spaced):
    rng = np.random.default_rng(4)
    some = ["a", "The", "É", "Σ", "İ", ".", ",", "'s", "'", "%%", "½", "_", "\u0301", "<|END", " ", "  ", "\n", "\t", "\r\n", "1", " ", " ", "\x1c", "\x85", "...", "é", " ́", "中", "😀", "<|endoftext|>", "word"]
    rows = ["".join(rng.choice(some, rng.integers(0, 20))) for _ in range(3000)]
    e = tokens.PieceEncoder(open(public_tokenizers.path(name)).read(), spaced)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(rows, add_special_tokens=False)]
    assert e.encode(rows) == want and e.encode(rows) == want


def test_token_files(spark, docs, texts, edge, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in token_files.token_output(docs, path, 2).collect()}
    start = 0
    for i in sorted(texts):
        ids = ids_of("word_bpe_49k.json", texts[i] or "", 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_output(edge, path, 2).count() == len(EDGE) and token_files.token_output(empty, path, 2).count() == 0
    out = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, out, path, 2)
    one = token_files.read_tokens(spark, out, [7]).first()
    assert np.array_equal(np.array(one.ids, "<u4"), ids_of("word_bpe_49k.json", texts[7], 2))
    f = next(tmp_path.glob("t/*.parquet"))
    columns = {pq.ParquetFile(f).metadata.row_group(0).column(k).path_in_schema: pq.ParquetFile(f).metadata.row_group(0).column(k) for k in range(5)}
    assert "DELTA_BINARY_PACKED" in columns["shard_start"].encodings and columns["ids.list.element"].has_dictionary_page and columns["doc_id"].has_offset_index


def check_packing(rows, want, size=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing(docs, texts, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = {i: ids_of("byte_bpe_50k.json", t or "", 1) for i, t in texts.items()}
    assert check_packing(packing.pack(docs, path, 1).collect(), want) == 0
    rows = packing.pack(edge, path, 1).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r[0] for r in EDGE) and packing.pack(empty, path, 1).count() == 0


def test_sum_of_squares_rule_and_bounded_open_windows():
    rng, size, out = np.random.default_rng(1), 64, []
    p = packing.Packer(size, out.append, max_open=10)
    for i in range(3000):
        s = int(rng.integers(1, 100))
        if (r := s % size) and s < size:
            own = p.count.copy()

            def cost(h, own=own, r=r):
                n = own.copy()
                if h:
                    n[h] -= 1
                if h + r < size:
                    n[h + r] += 1
                return int((n[1:size] ** 2).sum())

            assert cost(p.choose(r)) == min(cost(h) for h in range(size - r + 1) if h == 0 or own[h])
        p.add(i, np.arange(s, dtype="<u4").tobytes())
        assert p.open <= 11
    p.drain()
    assert all((n := sum(x[2] for x in w)) == size or n & (n - 1) == 0 for w in out)


# ---- 5 ----
def test_mixing(docs, texts, edge, empty):
    rows = mixing.mix(docs).collect()
    t = pq.read_table(f"{D}/documents.parquet")
    source = dict(zip(t["doc_id"].to_pylist(), t["source"].to_pylist()))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x in texts.items()}
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    left, target = 1.5 * sum(size.values()), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    while True:  # share out, hold at the cap, share the excess again
        rest = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sums[s]]
        if not over:
            target |= {s: level * weight[s] for s in rest}
            break
        for s in over:
            target[s] = 2.0 * sums[s]
            left -= target[s]
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(empty).count() == 0


def test_mixing_by_document_weight(spark):
    rows = spark.createDataFrame([(i, "w " * 10, f"s{i % 2}", i % 4 < 2) for i in range(4000)], "doc_id long, text string, source string, heavy boolean")
    weight = F.when(F.col("heavy"), 3.0).otherwise(1.0)
    got = mixing.mix(rows, weights=(1.0, 1.0), share=0.5, document_weight=weight).join(rows.select("doc_id", "heavy"), "doc_id").groupBy("heavy").agg(F.sum("taken").alias("n")).collect()
    n = {r.heavy: r.n for r in got}
    assert n[True] + n[False] == 20_000 and 2.5 < n[True] / n[False] < 3.5


# ---- 6 ----
PAGES = [
    (1, "http://a", "x" * 100), (7, "http://b", "x" * 100), (3, None, "x" * 100), (4, "http://c d\r\n", "y"), (5, "u", "y"), (6, "u", None), (None, "u", "x" * 100), (8, "u", ""),
    (9, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3), (10, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (1, "http://a", "x" * 100),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    got = sorted((tuple(r)[:5] for r in warc.round_trip(pages).collect()), key=repr)
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        same = [j for j, _, h in PAGES if j is not None and (h or "").encode() == b]
        first = min(same) if same and len(b) >= 100 and i is not None else i
        want.append((i, len(b), sha(b), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.where("false")).count() == 0
    real = spark.read.parquet(f"{D}/pages.parquet")
    assert warc.round_trip(real).count() == real.count()


def test_boundary_chain():
    inner = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    record = lambda body: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    parts = [record(b"one"), record(b"\r\n\r\n" + inner * 2), record(b""), record(inner)]
    data = b"".join(parts)
    at, after, _, _ = warc.candidates(data)
    starts = [sum(map(len, parts[:k])) for k in range(4)]
    assert at[warc.reachable(at, after, len(data))].tolist() == starts and len(at) == 7
    for bad in (data[:-1], data[5:], data + b"x"):
        at, after, _, _ = warc.candidates(bad)
        with pytest.raises(ValueError, match="chain"):
            warc.reachable(at, after, len(bad))


# ---- 7 ----
def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows, least=0.8):
    bags = {i: bag(t) for i, t in rows}
    up = {i: i for i in bags}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(bags)
    where = defaultdict(set)
    for i in ids:
        for s in bags[i]:
            where[s].add(i)
    for i in ids:
        for j in {j for s in bags[i] for j in where[s] if j > i}:
            if sum((bags[i] & bags[j]).values()) >= least * sum((bags[i] | bags[j]).values()):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs, texts, edge, empty):
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()} == brute_classes(texts.items())
    got = bagminhash.near_duplicates(edge).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((r[0], r[0]) for r in EDGE if r[0] is not None)
    assert bagminhash.near_duplicates(empty).count() == 0


def hot_group(seed):
    """Texts with two places of 120 changed: most pairs are near 0.7, so the few links at 0.8 stand among hundreds of pairs that estimates can take for them."""
    rng, rows = np.random.default_rng(seed), []
    base = [f"w{k}" for k in range(120)]
    for i in range(300):
        w = list(base)
        for k in rng.integers(0, 120, 2):
            w[k] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(3, 8192), (3, 32), (4, 8192), (5, 64)])
def test_a_hot_group_of_near_copies_in_small_blocks(spark, seed, block):
    rows = hot_group(seed)
    want, df = brute_classes(rows), spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df, block=block).collect()} == want
    if seed > 3:
        return
    # With the text that all were copied from among them, every copy is linked to it.
    rows += [(1000 + i, " ".join(f"z{i}-{k}" for k in range(50))) for i in range(20)] + [(500, " ".join(f"w{k}" for k in range(120)))]
    want, df = brute_classes(rows), spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df, block=block).collect()} == want


@pytest.mark.parametrize("links", [3, 200_000])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(bagminhash, "LINKS", links)
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (200, 201)]
    got = {r.node: r.label for r in bagminhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    classes = defaultdict(set)
    for node, label in got.items():
        classes[label].add(node)
    assert sorted(map(sorted, classes.values())) == [list(range(41)), list(range(100, 130)), [200, 201]]
    assert bagminhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_a_doc_id_are_judged_by_their_own_texts(spark):
    one, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(2, one, 0), (1, one, 1), (2, other, 2), (3, other + " c", 3), (None, one, 4), (None, "alone", 5), (2, one, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {r.n: (r.class_id, r.kept) for r in bagminhash.near_duplicates(df, key="n").collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (2, True), 3: (2, False), 4: (1, False), 5: (None, True), 6: (1, False)}
    assert sorted(r.class_id for r in bagminhash.near_duplicates(df).collect()) == [1, 1, 1, 2, 2]


def test_a_bucket_cut_into_blocks(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base[: i % 120], f"e{i}", *base[i % 120 + 1 :]])) for i in range(200)]  # 0.92 to the base, 0.83 to each other
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in bagminhash.near_duplicates(df, block=32).collect()} == {0}


def rare_links(n=140):
    """Texts that are mostly at 0.75 to 0.79 to each other: 7 of 100 places changed in each, 0.802 and more where two have 3 or more of them in common."""
    rng, rows = np.random.default_rng(5), []
    for i in range(n):
        w = [f"w{k}" for k in range(504)]
        for k in rng.choice(100, 7, replace=False).tolist():
            w[5 * k + 2] = f"e{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_rare_links_among_many_likely_pairs(spark):
    rows = rare_links()
    want, df = brute_classes(rows), spark.createDataFrame(rows, "doc_id long, text string")
    assert 1 < len(set(want.values())) < len(want)
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df).collect()} == want


def test_rare_links_between_blocks(spark):
    rows = rare_links()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df, block=32).collect()} == brute_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.integers(0, 9, 300))
    code = shingles.mix(np.arange(300, dtype=np.uint64))
    both = [np.concatenate(x) for x in zip(*((code[w > 0], np.full((w > 0).sum(), i), w[w > 0]) for i, w in enumerate((a, b))))]
    s = bagminhash.signatures(*both, 2, m=8000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


# ---- 8 ----
def test_language(docs, edge, empty):
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert own and sum(r.lang_pred == r.lang for r in own) / len(own) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert Counter(r.lang_pred for r in language.identify(empty).collect()) == {}
    model = language.fit(docs.where(~language.held_out()))
    got = {r.doc_id: r.lang_pred for r in language.predict(edge, model, {"doc_id": F.col("doc_id")}).collect()}
    assert got[5] == "und" and got[3] == "und" and got[4] != "und"
    none = language.predict(edge, None, {"doc_id": F.col("doc_id")}).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_every_language_is_learned_from_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "Model", lambda x, langs: Counter(langs))
    rows = [(f"text {lang} {k}", lang) for lang in ("aa", "bb", "cc", "dd") for k in range(5)] + [("text aa 0", "aa")] * 300
    assert language.fit(spark.createDataFrame(rows, "text string, lang string"), at_most=40) == {"aa": 5, "bb": 5, "cc": 5, "dd": 5}


# ---- 10 ----
def test_neighbours(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 16))
    rows = [(i, v[i].astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(12)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, rows[1][1]), (0, rows[0][1]), (-4, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    valid = {i: np.array(e, np.float64) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    hit = 0
    for q in [i for i in valid if i % 50 == 0]:
        score = {i: float(e @ valid[q] / np.sqrt((e @ e) * (valid[q] @ valid[q]))) for i, e in valid.items() if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        hit += len({i for i, _ in got[q]} & set(want))
        assert len(got[q]) == 5 and all(abs(s - score[i]) < 1e-12 for i, s in got[q])
    assert hit / (5 * len(got)) >= 0.95
    assert [i for i, _ in got[50]] == [1000, 1001, 1002, 1003, 1004]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# ---- pipeline ----
def test_mixing_stage_takes_documents_without_an_id_and_each_repeated_row_once(spark):
    from arbordelta.llm import stages

    rows = [(None, f"n{i} " * 10, "a") for i in range(20)] + [(i // 2, "w " * 11, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = stages.mix_sources(spark, df, D).collect()
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    # 640 words * 1.5 = 960: source a is held at twice its 200, b gets the rest.
    assert words == {"a": 400, "b": 560}
    assert Counter(r.text.split()[0] for r in got if r.doc_id is None) == {f"n{i}": 2 for i in range(20)}


def test_pipeline(spark, docs, texts):
    import corpus_pipeline
    from arbordelta.llm.common import materialize

    kept = docs.limit(0).union(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = materialize(stage(spark, before, D), name)
        assert kept.columns == docs.columns, name
        if name == "minhash_near_dedup":
            ids = {r.doc_id for r in before.collect()}
            classes = brute_classes([(i, texts[i]) for i in ids])
            assert {r.doc_id for r in kept.collect()} == set(classes.values())
        if name == "secret_scan":
            assert kept.count() == before.count() and not any(base_spans(r.text) for r in kept.collect())
        if name == "source_mixing":
            count = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
            size, mixed = count(before), count(kept)
            assert abs(sum(mixed.values()) - 1.5 * sum(size.values())) <= len(size) and all(mixed[s] <= 2 * size[s] for s in mixed)
    want = Counter()
    for r in kept.collect():
        want[r.doc_id] += len(ids_of("byte_bpe_50k.json", r.text, 1))
    got = Counter()
    for r in corpus_pipeline.run(spark, D).collect():
        got[r.doc_id] += r.length
    assert got == want
