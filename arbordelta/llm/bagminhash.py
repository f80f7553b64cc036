"""MinHash near-duplicates of multisets: BagMinHash signatures, banding, exact verification, connected classes.

Signature: a shingle of weight w owns a Poisson process on [0, w) for every component. The axis is cut into dyadic
intervals [0, 1), [1, 2), [2, 4), ...; each (shingle, interval) has one process for all components, whose points come in
ascending order and carry a component and a place in the interval. A text uses the points whose place is below its weight,
and stops when the next point is past the largest value in its signature. A component's value is its least point, so
two texts agree in it with the probability of their weighted Jaccard similarity.

Classes: equal word sequences are one node. Nodes that agree in a band meet in a bucket.

1. A bucket's first node leads: those that are 0.8 or more alike by estimate make a pair with it. The first of the rest
   leads next, and makes a pair with the earlier leader it is most like. A bucket of more than `block` nodes is cut into
   blocks, whose leaders meet again. Every node has few pairs, and mostly the same ones in all its buckets.
2. Pairs are verified exactly on the multisets; links (similarity of at least `least`) join nodes into classes.
3. All pairs of a bucket that are likely (an estimate of LOWEST) and still lie in different classes are tried, in rounds:
   of each node ; the blocks of a larger bucket meet two by two.

So no likely pair between classes is left untried. A bucket that is one class costs nothing in step 3; one of g nodes that
are likely but not similar costs up to g^2 / 2 exact comparisons. Links inside a class are not counted: most are never tried.

Defined cases: texts without a word (null, empty, blank) have no shingles and are classes of their own; texts of fewer
than five words have one shingle, all their words; repeated rows have the same class; rows that share a doc_id are judged
by their own texts; without `key` rows without doc_id are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialize, text_or_empty
from .shingles import mix, shingles_of, similarity, weighted, words_of

WORDS = 5
#: Bands of rows: a pair at 0.8 is missed with probability (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
#: Signature values; the bands use the first of them, estimates all: one standard error is 0.02 at 0.8.
VALUES = 384
SALTS = 16
NO_ID = np.iinfo(np.int64).max


def signatures(code: np.ndarray, own: np.ndarray, weight: np.ndarray, texts: int, m: int = VALUES) -> np.ndarray:
    """BagMinHash values (texts x m, inf where a text has no shingle) of shingles with integer weights."""
    sig = np.full(texts * m, np.inf)
    # One process for each shingle and dyadic interval that its weight reaches: [0, 1) is level 0, [2^(k-1), 2^k) level k.
    levels = np.zeros(len(weight), np.int64)
    many = weight > 1
    levels[many] = np.ceil(np.log2(weight[many])).astype(np.int64)
    of = np.repeat(np.arange(len(code)), levels + 1)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.maximum(low, 1.0)
    seed = mix(code[of] + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    doc, w, x = own[of], weight[of].astype(np.float64), np.zeros(len(of))
    step = 0
    unit = lambda h: ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    while len(doc):
        step += 1
        h = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(unit(h)) / rate
        h = mix(h ^ np.uint64(0xE7037ED1A0B428DB))
        part = doc * m + (h % np.uint64(m)).astype(np.int64)
        place = low + rate * unit(mix(h + np.uint64(0x8EBC6AF09C88C6E3)))
        used = (place < w) & (x < sig[part])
        np.minimum.at(sig, part[used], x[used])
        going = x < sig.reshape(texts, m).max(1)[doc]
        seed, doc, w, x, low, rate = seed[going], doc[going], w[going], x[going], low[going], rate[going]
    return sig.reshape(texts, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """texts x BANDS signed 64-bit keys; a key depends on its band's number."""
    bits = np.ascontiguousarray(sig[:, : BANDS * ROWS]).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key ^ bits[:, :, k]) + np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def _digests(words: np.ndarray, owners: np.ndarray, texts: int) -> list[bytes | None]:
    """A digest of each text's word sequence, None without words."""
    cuts = np.searchsorted(owners, np.arange(texts + 1))
    view = memoryview(words).cast("B")
    return [hashlib.blake2b(view[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _together(texts: list[str], most: int = 500_000):
    """(from, to) of texts in a row that are `most` characters long, or one longer text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < most):
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def _texts(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, row (what tells rows apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).cast("long").alias("row"), text_or_empty().alias("text")).where("row is not null")


def sketch(texts: DataFrame) -> DataFrame:
    """doc_id, row, copy (a digest of the word sequence, null without words), bands, marks (a byte of each signature value)."""

    def run(batches):
        for batch in batches:
            ids, rows, own = batch.column("doc_id"), batch.column("row"), batch.column("text").to_pylist()
            for at, stop in _together(own):
                words, owners = words_of(own[at:stop])
                sig = signatures(*weighted(*shingles_of(words, owners, WORDS)), stop - at)
                copies = _digests(words, owners, stop - at)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (stop - at + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_keys(sig).ravel()))
                marks = (mix(np.ascontiguousarray(sig).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                columns = [ids.slice(at, stop - at), rows.slice(at, stop - at), pa.array(copies, pa.binary()), bands, pa.array([x.tobytes() for x in marks], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "copy", "bands", "marks"])

    return arrow_map(texts, run, "doc_id long, row long, copy binary, bands array<long>, marks binary")


#: Estimated similarity below which an edge isn't tried: four standard errors under 0.8.
LOWEST = 0.72
#: Links that one task joins into trees, in memory.
LINKS = 200_000


def leaders(marks: np.ndarray, lowest: float = LOWEST, sure: float = 0.8) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs (positions) of rows of marks to try, and the rows that lead."""
    m, led, pairs = marks.shape[1], [], []
    need, strict = max(1, int(lowest * m)), max(1, int(sure * m))
    left = np.arange(len(marks))
    while len(left):
        at, left = int(left[0]), left[1:]
        if led:
            alike = (marks[led] == marks[at]).sum(1)
            if alike[best := int(alike.argmax())] >= need:
                pairs.append((led[best], at))
        led.append(at)
        if len(left):
            near = (marks[left] == marks[at]).sum(1) >= strict
            pairs += [(at, k) for k in left[near].tolist()]
            left = left[~near]
    return pairs, led


def _array(column: pa.Array) -> np.ndarray:
    """A column as an array: lists of one length as rows, byte strings as objects."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _groups(batches, by: tuple[str, ...], more: tuple[str, ...]):
    """Rows (by, more, marks) ordered by `by` -> a tuple of arrays (by, more, marks) for each group."""
    held = None
    for batch in _and_end(batches):
        if batch is not None:
            marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            now = (*(_array(batch.column(n)) for n in (*by, *more)), marks)
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            last = np.flatnonzero(np.any([x != x[-1] for x in held[: len(by)]], 0))
            ready = int(last[-1]) + 1 if len(last) else 0
        else:
            ready = len(held[0]) if held is not None else 0
        if ready:
            new = np.any([x[1:ready] != x[: ready - 1] for x in held[: len(by)]], 0)
            cuts = np.flatnonzero(np.concatenate([[True], new, [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield tuple(x[a:b] for x in held)
            held = tuple(x[ready:] for x in held)


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)


def _first_pairs(batches):
    """Rows (key, salt, node, marks) ordered by key, salt and node -> (key, a, b), with b null for a leader of a block that goes on."""
    out: list[tuple] = []
    for keys, salts, own, marks in _groups(batches, ("key", "salt"), ("node",)):
        pairs, led = leaders(marks)
        key, nodes = int(keys[0]), own.tolist()
        out += [(key, min(nodes[x], nodes[y]), max(nodes[x], nodes[y])) for x, y in pairs]
        if salts[0] >= 0:  # a block of a larger bucket
            out += [(key, nodes[r], None) for r in led]
        if len(out) > 10_000:
            yield _longs(out, ["key", "a", "b"])
            out = []
    yield _longs(out, ["key", "a", "b"])


def _likely(probe: np.ndarray, label: np.ndarray, marks: np.ndarray, bands: np.ndarray, key: int):
    """For each probe (position) the positions of likely nodes of other labels that it shares no earlier bucket with, and their estimates."""
    need, others = max(1, int(LOWEST * marks.shape[1])), np.flatnonzero(~probe)
    if not len(others):
        return
    column = int(np.flatnonzero(bands[others[0]] == key)[0])
    for i in np.flatnonzero(probe).tolist():
        apart = others[label[others] != label[i]]
        alike = (marks[apart] == marks[i]).sum(1)
        near = alike >= need
        apart, alike = apart[near], alike[near]
        if len(apart) and column:
            first = ~(bands[apart, :column] == bands[i, :column]).any(1)
            apart, alike = apart[first], alike[first]
        if len(apart):
            yield i, apart, alike


_AT = ("key", "row", "column")


def _wanted(batches):
    """Rows of a block (key, row, column, probe, node, label, marks, bands) ordered by the first three -> (key, row, column, probe, node) of those with a pair to try."""
    for key, row, column, probe, node, label, bands, marks in _groups(batches, _AT, ("probe", "node", "label", "bands")):
        used = np.zeros(len(node), bool)
        for i, apart, _ in _likely(probe, label, marks, bands, int(key[0])):
            used[i] = True
            used[apart] = True
        at = np.flatnonzero(used)
        arrays = [pa.array(key[at]), pa.array(row[at]), pa.array(column[at]), pa.array(probe[at], pa.bool_()), pa.array(node[at])]
        yield pa.RecordBatch.from_arrays(arrays, [*_AT, "probe", "node"])


def _linked(least: float):
    """Rows of a block, as _wanted's and with code and weight -> (a, b): links that join nodes of different labels."""

    def run(batches):
        out: list[tuple] = []
        for key, _, _, probe, node, label, bands, code, weight, marks in _groups(batches, _AT, ("probe", "node", "label", "bands", "code", "weight")):
            bags_ = [(np.frombuffer(c, np.uint64), np.frombuffer(w, np.uint32)) for c, w in zip(code, weight)]
            up = {x: x for x in label.tolist()}

            def find(x: int, up=up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            tries = [(-n, i, j) for i, apart, alike in _likely(probe, label, marks, bands, int(key[0])) for j, n in zip(apart.tolist(), alike.tolist())]
            for _, i, j in sorted(tries):
                x, y = find(int(label[i])), find(int(label[j]))
                if x != y and similarity(bags_[i], bags_[j]) >= least:
                    up[max(x, y)] = min(x, y)
                    out.append((int(node[i]), int(node[j])))
        yield _longs(out, ["a", "b"])

    return run


def _and_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def candidates(members: DataFrame, block: int) -> DataFrame:
    """Distinct pairs (a, b) to verify first. members: key, node, marks, n (the bucket's size)."""
    pairs, before = None, None
    while True:
        salt = F.when(F.col("n") > block, F.pmod(F.xxhash64("node", "n"), F.ceil(F.col("n") * 1.25 / block)).cast("int")).otherwise(F.lit(-1))
        dealt = members.select("key", salt.alias("salt"), "node", "marks").repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
        found = materialize(arrow_map(dealt, _first_pairs, "key long, a long, b long"), "first-pairs")
        edges = found.where("b is not null").select("a", "b")
        pairs = edges if pairs is None else pairs.union(edges)
        on = found.where("b is null").select("key", F.col("a").alias("node"))
        going = on.count()
        # Leaders that hardly get fewer would go on for ever; what is between blocks is tried across classes later.
        if going == 0 or (before is not None and going > 0.5 * before):
            return pairs.distinct()
        before = going
        sizes = on.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        members = materialize(members.select("key", "node", "marks").join(on, ["key", "node"], "left_semi").join(sizes, "key"), "level")


def across(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) between nodes that share a bucket but not a class, enough of them to join all classes that a likely pair joins.

    buckets: key, node. A node of a bucket's largest class needs no pairs of its own: those of the others reach it.
    The others are cut into rows of blocks, all nodes into columns, and every row meets every column.
    """
    now = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = now.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    now = now.join(sizes.where("all > top.n").select("key", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / block).alias("rows"), F.ceil(F.col("all") / block).alias("columns")), "key")
    place = F.xxhash64("node", "key")
    others = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(F.lit(False).alias("probe"), r.alias("row"), F.pmod(place, F.col("columns")).alias("column")))
    probes = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.struct(F.lit(True).alias("probe"), F.pmod(place, F.col("rows")).alias("row"), c.alias("column")))
    sides = F.when(F.col("label") == F.col("top"), others).otherwise(F.concat(others, probes))
    dealt = now.join(nodes.select("node", "marks", "bands"), "node").select("key", F.explode(sides).alias("at"), "node", "label", "marks", "bands").select("key", "at.*", "node", "label", "marks", "bands")
    dealt = dealt.repartition(*_AT).sortWithinPartitions(*_AT)
    wanted = materialize(arrow_map(dealt, _wanted, "key long, row long, column long, probe boolean, node long"), "wanted")
    held = materialize(bags(wanted.select("node"), nodes, texts), "bags")
    known = nodes.select("node", "marks", "bands").join(labels, "node", "left").select("node", "marks", "bands", F.coalesce("label", "node").alias("label")).join(held, "node")
    rows = wanted.join(known, "node").repartition(*_AT).sortWithinPartitions(*_AT)
    return materialize(arrow_map(rows, _linked(least), "a long, b long"), "links")


def bags(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, code, weight (its shingles as ascending hashes, and how often it has them) of the nodes asked for, each once.

    Of rows that share the node's key, one with the node's own words counts.
    """

    def run(batches):
        for batch in batches:
            own, copies, ids = (batch.column(n).to_pylist() for n in ("text", "copy", "node"))
            for at, stop in _together(own):
                words, owners = words_of(own[at:stop])
                same = [x == y for x, y in zip(_digests(words, owners, stop - at), copies[at:stop])]
                code, text, weight = weighted(*shingles_of(words, owners, WORDS))
                cuts = np.searchsorted(text, np.arange(stop - at + 1)).tolist()
                rows = [(ids[at + i], code[cuts[i] : cuts[i + 1]].tobytes(), weight[cuts[i] : cuts[i + 1]].astype(np.uint32).tobytes()) for i, ok in enumerate(same) if ok]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))], ["node", "code", "weight"])

    asked = asked.distinct().join(nodes.select("node", "row", "copy"), "node")
    # Rows that repeat a node's key repeat its text, most often; one of each text is enough.
    rows = texts.select("row", "text").join(asked.hint("merge"), "row").select("node", "copy", "text")
    return arrow_map(rows, run, "node long, code binary, weight binary").groupBy("node").agg(F.first("code").alias("code"), F.first("weight").alias("weight"))


def verify(pairs: DataFrame, bags_: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least `least`."""

    def run(batches):
        for batch in batches:
            a, ca, wa, cb, wb = (batch.column(n).to_pylist() for n in ("a", "ca", "wa", "cb", "wb"))
            bag = lambda code, weight: (np.frombuffer(code, np.uint64), np.frombuffer(weight, np.uint32))
            good, now, own = [], None, None
            for i in range(batch.num_rows):
                if a[i] != now:
                    now, own = a[i], bag(ca[i], wa[i])
                good.append(similarity(own, bag(cb[i], wb[i])) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(good, pa.bool_())) for n in ("a", "b")], ["a", "b"])

    # The leader, a, may be that of very many pairs: it is joined last, so that Spark can split its pairs.
    rows = pairs.join(bags_.select(F.col("node").alias("b"), F.col("code").alias("cb"), F.col("weight").alias("wb")), "b")
    rows = rows.join(bags_.select(F.col("node").alias("a"), F.col("code").alias("ca"), F.col("weight").alias("wa")), "a")
    return arrow_map(rows.select("a", "b", "ca", "wa", "cb", "wb"), run, "a long, b long")


def _trees(round_: int):
    """Links (a, b) -> (node, root): the trees that up to LINKS of a task's links make at a time. Roots go by hash."""
    rank = lambda x: mix(x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (round_ + 1) & 0xFFFFFFFFFFFFFFFF))

    def joined(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        order = np.argsort(rank(names), kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        x, y = place[at[: len(a)]], place[at[len(a) :]]
        root = np.arange(len(names))
        while True:  # the larger root of each link takes the smaller, then all jump to the end
            p, q = root[x], root[y]
            apart = p != q
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while (root[root] != root).any():
                root = root[root]
        return pa.RecordBatch.from_arrays([pa.array(names[order]), pa.array(names[order][root])], ["node", "root"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, LINKS):
                held.append(tuple(batch.column(k).slice(at, LINKS).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "b")))
                n += len(held[-1][0])
                if n >= LINKS:
                    yield joined(*(np.concatenate(c) for c in zip(*held)))
                    held, n = [], 0
        if held:
            yield joined(*(np.concatenate(c) for c in zip(*held)))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: one name for all nodes of a class, for every node that has a link.

    Each task replaces its links by the trees they make. A node with several roots takes the first, and links between
    the roots are what is left for the next round, until none is. Links of a hot class shrink to its trees at once.
    """
    steps = []
    while True:
        tasks = -(-links.count() // LINKS)
        if not tasks:
            break
        trees = arrow_map(links.select("a", "b").repartition(tasks), _trees(len(steps)), "node long, root long")
        if tasks > 1:
            trees = trees.distinct().withColumn("first", F.min("root").over(W.partitionBy("node")))
        else:
            trees = trees.withColumn("first", F.col("root"))
        trees = materialize(trees, "trees")
        steps.append(trees.select("node", F.col("first").alias("label")).distinct())
        if tasks == 1:
            break
        links = trees.where("root <> first").select(F.col("root").alias("a"), F.col("first").alias("b")).distinct()
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[-1]
    for down in reversed(steps[:-1]):
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = down.join(further, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(labels, "labels") if len(steps) > 1 else labels


def near_duplicates(docs: DataFrame, least: float = 0.8, block: int = 8192, key: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (least doc_id of its class), kept (the row with it; the first by key if several).

    key: an integer column that tells rows apart, written with them; it is returned too, exactly one row of a class is kept,
    and rows without doc_id (last in a class) take part.
    """
    texts = _texts(docs, key or "doc_id")
    sketches = materialize(sketch(texts), "sketches")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "row"))
    nodes = sketches.where("copy is not null").groupBy("copy").agg(first.alias("first"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = materialize(nodes.select("copy", "first", "first.row", "bands", "marks", F.monotonically_increasing_id().alias("node")), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(rows.join(shared, "key").select("key", "node", "n"), "buckets")

    pairs = materialize(candidates(buckets.join(nodes.select("node", "marks"), "node"), block), "pairs")
    held = materialize(bags(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, texts), "bags")
    links = materialize(verify(pairs, held, least), "verified")
    labels = components(links)
    # The only pair of a bucket of two is tried by now. Multisets are larger than marks, so there are fewer to a block.
    more = across(buckets.where("n > 2").select("key", "node"), nodes, labels, texts, least, max(1, block // 4))
    if not more.isEmpty():
        labels = components(links.union(more))
    named = nodes.select("copy", "node", "first").join(labels, "node", "left").select("copy", "first", F.coalesce("label", "node").alias("label"))
    classes = named.groupBy("label").agg(F.min("first").alias("first"))
    table = named.select("copy", "label").join(classes, "label").select("copy", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # A digest may be that of a third of all documents, so the join carries a salt.
    every = sketches.select("doc_id", "row", "copy", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    every = every.join(table, ["copy", "salt"], "left")
    class_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("first.doc_id"), F.lit(NO_ID)))
    kept = F.col("first").isNull() | (F.col("first.row") == F.col("row"))
    return every.select("doc_id", class_id.alias("class_id"), kept.alias("kept"), *([F.col("row").alias(key)] if key else []))
