"""MinHash near-duplicates with tensored banding, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, marked
from .components import ALONE, components
from .pairblocks import blocked, meetings, spanning
from .textkernel import U, Words, mix, slices, tidy

#: Collisions in each of the two collections, and minhashes in each collision. With these
#: 2 * 12 * 2 minhashes give 144 tables of four minhashes each; a pair at similarity 0.8 is in no common
#: table with probability 2 * (1 - 0.8 ** 2) ** 12, about 1 in 100,000, and less above.
PARTS = 12
WIDTH = 2
#: Of the 48 minhashes so many must agree before a pair is a candidate: at similarity 0.8 fewer do
#: in less than 1 of 100,000 cases.
AGREE = 24
SHINGLE = 5
THRESHOLD = 80
_SEEDS = np.random.Generator(np.random.PCG64(4711)).integers(1, 2**64, (2, 2 * PARTS * WIDTH), dtype=U)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, runs of ``words`` words, the whole sequence of a
    shorter text as one, none without words."""
    w = Words(texts)
    h = w.hashes()
    s = mix(h + U(words))
    for k in range(1, words):
        s[: max(0, len(h) - k)] = mix(s[: max(0, len(h) - k)]) ^ h[k:]
        s = mix(s)
    for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        if n >= words:
            yield np.unique(s[a : a + n - words + 1])
        elif n:
            one = mix(h[a : a + 1] + U(1000 + n))
            for k in range(1, n):
                one = mix(one) ^ h[a + k : a + k + 1]
            yield mix(one)
        else:
            yield np.zeros(0, U)


def _minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minhashes per set; sets must not be empty."""
    every = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), _SEEDS.shape[1]), U)
    with np.errstate(over="ignore"):
        for k in range(_SEEDS.shape[1]):
            x = (every ^ _SEEDS[0, k]) * (_SEEDS[1, k] | U(1))
            out[:, k] = np.minimum.reduceat(x ^ (x >> U(31)), at)
    return out


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


_SKETCH = "n_shingles long, class binary, us array<long>, vs array<long>, signature binary"


def sketches(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, the size and digest of its shingle set, its collisions in both collections and a signature.

    The digest (128 bits of BLAKE2 over the whole sorted set) names the class of documents with equal
    sets; it is null for an empty set.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [*shingle_sets(batch.column(1), words)]
                full = [k for k, x in enumerate(sets) if len(x)]
                n = len(sets)
                us, vs, sig, name = [None] * n, [None] * n, [None] * n, [None] * n
                if full:
                    m = _minhashes([sets[k] for k in full])
                    low = (mix(m) & U(255)).astype(np.uint8)
                    with np.errstate(over="ignore"):
                        c = m.reshape(len(full), 2, PARTS, WIDTH)
                        key = np.broadcast_to(np.arange(1, 2 * PARTS + 1, dtype=U).reshape(1, 2, PARTS), c.shape[:3])
                        for k in range(WIDTH):
                            key = mix(key + c[..., k])
                    key = key.view(np.int64)
                    for r, k in enumerate(full):
                        us[k], vs[k], sig[k] = key[r, 0].tolist(), key[r, 1].tolist(), low[r].tobytes()
                        name[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), _binary(name), pa.array(us, pa.list_(pa.int64())), pa.array(vs, pa.list_(pa.int64())), _binary(sig)],
                    names=["doc_id", "n_shingles", "class", "us", "vs", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SKETCH}")


def _fixed(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """A binary column whose values are all ``width`` long, as rows of numbers."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(a), width // np.dtype(dtype).itemsize)


_EDGE = "a binary, b binary"


def _edges(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    name = table.column("class").combine_chunks()
    return pa.RecordBatch.from_arrays([name.take(pa.array(i)), name.take(pa.array(j))], names=["a", "b"])


def _candidates(batches, agree: int, percent: int):
    for t, edges in meetings(batches, ["key", "pair_a", "pair_b"]):
        sig, n = _fixed(t.column("signature"), np.uint8, 2 * PARTS * WIDTH), t.column("n_shingles").to_numpy()

        def fits(i, j, n=n):
            return 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])

        i, j = spanning(
            edges,
            lambda i, j, sig=sig, fits=fits: fits(i, j) & ((sig[i] == sig[j]).sum(1) >= agree),
            lambda x, rows, sig=sig, fits=fits: fits(x, rows) & ((sig[rows] == sig[x]).sum(1) >= agree),
        )
        if len(i):
            yield _edges(t, i, j)


def _confirmed(batches, percent: int):
    """Links between the sets of a group: each row outside the largest component so far is held against all others."""
    for t, edges in meetings(batches, ["root", "pair_a", "pair_b"]):
        sets = t.column("hashes").combine_chunks()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = b - a
            if n < 2:
                continue
            own = [np.frombuffer(sets[k].as_buffer(), U) for k in range(a, b)]
            size = np.array([len(x) for x in own])
            every, at = np.concatenate(own), np.cumsum([0, *size])[:-1]
            label = np.arange(n)
            todo = list(range(n))
            i, j = [], []
            while todo:
                count = np.bincount(label, minlength=n)
                largest = count.argmax()
                x = next((x for x in todo if label[x] != largest or count[largest] == 1), None)
                if x is None:
                    break
                todo.remove(x)
                s = own[x]
                pos = np.minimum(np.searchsorted(s, every), len(s) - 1)
                both = np.add.reduceat((s[pos] == every).astype(np.int64), at)
                hit = np.flatnonzero(100 * both >= percent * (size + len(s) - both))
                for y in hit[label[hit] != label[x]].tolist():
                    if label[y] != label[x]:
                        label[label == label[y]] = label[x]
                        i.append(a + x)
                        j.append(a + y)
            if i:
                yield _edges(t, np.array(i), np.array(j))


def classes(sketch: DataFrame) -> DataFrame:
    """One row per distinct shingle set: class, n_shingles, us, vs, signature."""
    cols = ("n_shingles", "us", "vs", "signature")
    return sketch.where("class IS NOT NULL").groupBy("class").agg(*[F.any_value(c).alias(c) for c in cols])


def candidate_links(kinds: DataFrame, agree: int = AGREE, percent: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) of classes that hold together all pairs which share a table and agree in enough minhashes.

    A collision that no other class has cannot become part of a shared table key, so only shared ones
    are combined into pairs. Every pair goes to its key in one shuffle; keys that stay alone there cost less than a
    second shuffle would to find them first. Table keys of very common passages are compared in blocks.
    """
    parts = kinds.select("class", F.posexplode(F.concat("us", "vs")).alias("at", "part"))
    shared = parts.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    parts = parts.join(shared, "part", "left_semi")
    lists = parts.groupBy("class").agg(*[F.collect_list(F.when(side, F.col("part"))).alias(name) for name, side in (("us", F.col("at") < PARTS), ("vs", F.col("at") >= PARTS))])
    lists = lists.where("size(us) > 0 AND size(vs) > 0")
    lists = cut(lists.join(kinds.select("class", "n_shingles", "signature"), "class"), "parts")
    rows = lists.select("class", "n_shingles", "signature", F.explode("us").alias("u"), "vs")
    rows = rows.select("class", "n_shingles", "signature", "u", F.explode("vs").alias("v"))
    rows = blocked(rows.select("class", "n_shingles", "signature", F.xxhash64("u", "v").alias("key")), "key", "class")
    rows = rows.repartition("key", "pair_a", "pair_b").sortWithinPartitions("key", "pair_a", "pair_b", "class")
    return rows.mapInArrow(lambda it: _candidates(it, agree, percent), _EDGE)


def confirm(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between classes in the same candidate component whose whole sets are similar enough.

    ``docs`` has a row number and a text, ``members`` class, root and the number of one row that has the set. Sets are
    computed again from those rows' texts. Rows may share a number: of their sets only those of ``members`` count, each
    once a task.
    """

    @tidy
    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [x.tobytes() for x in shingle_sets(batch.column(0), words)]
                own = []
                for k, (x, name) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)):
                    if name not in seen and hashlib.blake2b(x, digest_size=16).digest() == name:
                        seen.add(name)
                        own.append(k)
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), _binary([sets[k] for k in own])], names=["class", "root", "hashes"])

    # Only texts that may be needed are shuffled.
    some = marked(docs.select(F.col("row").alias("need"), "text"), "need", members.select("row")).where("marked")
    texts = some.join(members, F.col("need") == F.col("row")).select("text", "class", "root")
    sets = cut(texts.mapInArrow(run, "class binary, root binary, hashes binary"), "sets")
    if sets.agg(F.countDistinct("class")).first()[0] < members.count():
        raise RuntimeError("the documents were not the same when they were read again")
    rows = blocked(sets.withColumn("root", F.xxhash64("root")), "root", "class")
    rows = rows.repartition("root", "pair_a", "pair_b").sortWithinPartitions("root", "pair_a", "pair_b", "class")
    return rows.mapInArrow(lambda it: _confirmed(it, percent), _EDGE)


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): every row with a number of its own, written down so that it is the same wherever it is read."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "docs")


def _linked(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, root) of rows (row, doc); root is null for texts without words.

    Rows of one number are told apart by their sets, so that a hash of the row will do as its number."""
    texts = rows.select(F.struct("row", "doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    sketch = cut(sketches(texts, words), "sketch")
    kinds = classes(sketch.drop("doc_id"))
    first = components(candidate_links(kinds, percent=percent), alone=ALONE)
    first = cut(first.withColumnRenamed("node", "class"), "candidates")
    who = sketch.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id.row").alias("row"))
    members = cut(first.join(who, "class"), "members")
    links = components(confirm(rows.select("row", "doc.text"), members, words, percent), alone=ALONE)
    slim = sketch.select("doc_id.row", "doc_id.doc_id", "n_shingles", "class").join(links.withColumnRenamed("node", "class"), "class", "left")
    return slim.select("row", "doc_id", "n_shingles", F.coalesce("root", "class").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id and kept.

    Rows with 100 * intersection >= ``percent`` * union of their shingle sets are linked; a component is
    named by its smallest doc_id and keeps the row that has it. Texts without words and null texts have
    an empty set and stand alone. Rows with equal sets are one class and are never paired; a doc_id that
    comes back with other text is another member with the same id, a null doc_id never names a component
    unless all its members are null. An empty table gives no rows; other columns are not read. ``docs`` is read
    twice and not written down; if a text that is needed is not there again, it fails.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct("doc_id", "text").alias("doc"))
    slim = _linked(rows, words, percent)
    named = slim.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    out = slim.join(named.where("n > 1").drop("n"), "root", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """``docs`` with exactly one row of each component, one with its smallest doc_id; columns stay as they are.

    Decided by row: a repeated row or a null doc_id goes with its component, and a row with other text stays whatever
    its doc_id. Texts without words stay.
    """
    rows = _numbered(docs)
    slim = cut(_linked(rows, words, percent).where("root IS NOT NULL"), "linked")
    stay = slim.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("stay"), F.count("*").alias("n"))
    gone = cut(slim.join(stay.where("n > 1"), "root").where("row <> stay").select("row"), "gone")
    # Only rows that may go are shuffled; all others are in no doubt.
    rows = marked(rows, "row", gone)
    return rows.where("NOT marked").union(rows.where("marked").join(gone, "row", "left_anti").select(*rows.columns)).select("doc.*")
