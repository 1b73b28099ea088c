"""SimHash near-duplicates with pivot distance tables.

Fingerprint: A-Z lower-cased, words split at ASCII white space, all 3-word shingles with repeats; a bit is 1 if over half of the
shingles' XXH64 (seed 42) have it. Fewer words: the whole sequence is the one shingle. No words: fingerprint 0, linked like any other.

Links, at most RADIUS differing bits, between distinct fingerprints only (equal ones are one class):

* Dealing: 64 bits are six blocks. Two fingerprints within three bits agree on three whole blocks at least, so each fingerprint is
  dealt to the 20 keys that its block triples give, and every link meets in one of them.
* Hot keys: the fingerprints of a key are cut into parts of at most about PART, by hash; parts meet two by two, each pair of parts
  in a task of its own. So no task holds a whole hot key.
* Pivot tables: a task precomputes the Hamming distances of its fingerprints to PIVOTS reference fingerprints. By the triangle
  inequality |d(x,p) - d(y,p)| is at most d(x,y), so a pair with a coordinate difference over RADIUS is discarded.
  Fingerprints are ordered by the first coordinate, so only a window of each row is looked at; survivors are verified by their own
  distance. A task returns a spanning forest of its links, never all pairs.

Components: minimum-label propagation with pointer jumping over the links, written to the shared folder each round; the driver only
sees a count. A class's component is the smallest doc_id of its fingerprints.

Cases: a null text is the empty text; a null id never is the smallest where another id exists, and a component of null ids only has a
null component_id; repeated rows and equal texts share a class; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ADDRESS, addressed, discard, for_texts, join_hot, materialize, mix64, pick, slices, text_hashes

RADIUS = 3
SHINGLE = 3
SEED = 42
PIVOTS = 24
PART = 1500
#: Bits of the six blocks.
CUTS = (0, 11, 22, 33, 44, 54, 64)
TRIPLES = list(combinations(range(6), 3))

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIVOTS = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; counted in slices, so a long text needs no more memory."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        count += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: str | None) -> int:
    return majority(shingle_hashes((text or "").encode()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint_of(t) for _, _, texts in slices(b.column("text")) for t in texts), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(fp.view(np.int64))], [*(c for c in b.schema.names if c != "text"), "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp (the 64 bits as a long) beside the columns of docs other than text."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.mapInArrow(_fingerprints, f"{schema}, fp long")


def deal(fp: np.ndarray, triple: tuple[int, int, int]) -> np.ndarray:
    mask = 0
    for i in triple:
        mask |= (1 << CUTS[i + 1]) - (1 << CUTS[i])
    return fp & np.uint64(mask)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        for k, triple in enumerate(TRIPLES):
            key = mix64(deal(fp, triple) + np.uint64(k))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("fp")], ["key", "fp"])


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """The distances of each fingerprint to each pivot."""
    return np.bitwise_count(fp[:, None] ^ _PIVOTS[None, :]).astype(np.int8)


def within(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which pairs link: those whose coordinates differ by the radius at most, and then by their own distance."""
    near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius
    near[near] = np.bitwise_count(fp[i[near]] ^ fp[j[near]]) <= radius
    return near


def links_within(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by pivot distance tables."""
    n = len(fp)
    if n < 2:
        return []
    table = pivot_table(fp)
    if n <= 8:
        i, j = np.triu_indices(n, 1)
        near = within(fp, table, i, j, radius)
        return _forest(fp, i[near], j[near])
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
    left, right = [], []
    step = max(1, 2_000_000 // n)
    for i in range(0, n, step):
        j = min(n, i + step)
        hi = int(ends[j - 1])
        a, b = np.meshgrid(np.arange(i, j), np.arange(i, hi), indexing="ij")
        use = (b > a) & (b < ends[i:j, None])
        a, b = a[use], b[use]
        for p in range(1, PIVOTS):
            near = np.abs(table[a, p] - table[b, p]) <= radius
            if not near.all():
                a, b = a[near], b[near]
            if len(a) < 64:
                break
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        left.append(a[near])
        right.append(b[near])
    return _forest(fp, np.concatenate(left), np.concatenate(right))


def _forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Each linked fingerprint with the smallest one that it reaches: at most n - 1 links."""
    if not len(a):
        return []
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return list(zip(fp[moved].view(np.int64).tolist(), fp[label[moved]].view(np.int64).tolist()))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, p, q). Whole groups are linked one by one; only the unfinished last one is carried on."""
    carry = np.zeros((4, 0), np.int64)
    for b in itertools.chain(batches, [None]):
        rows = carry if b is None else np.concatenate([carry, np.stack([b.column(c).to_numpy() for c in ("key", "p", "q", "fp")])], axis=1)
        if not rows.shape[1]:
            continue
        new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        cut = np.concatenate([[0], new, [rows.shape[1]]])
        whole = len(cut) - (1 if b is None else 2)
        fp = rows[3].view(np.uint64)
        size = np.diff(cut)[:whole]
        two = cut[:whole][size == 2]  # most groups: one pair, all at once
        pair = fp[np.stack([two, two + 1], axis=1).ravel()]
        near = within(pair, pivot_table(pair), np.arange(0, len(pair), 2), np.arange(1, len(pair), 2))
        x, y = rows[3][two[near]].tolist(), rows[3][two[near] + 1].tolist()
        for i in np.flatnonzero(size > 2):
            for u, v in links_within(np.unique(fp[cut[i] : cut[i + 1]])):
                x.append(u)
                y.append(v)
        carry = rows[:, cut[whole] :].copy()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])


def find_links(distinct: DataFrame, part: int = PART) -> DataFrame:
    """x, y: links whose components are those of all pairs of fingerprints within RADIUS."""
    dealt = distinct.select("fp").mapInArrow(_dealt, "key long, fp long")  # made twice: 20 keys a fingerprint are cheaper to make than to write
    keys = materialize(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")  # a fingerprint alone at its key has no link there
    shared = join_hot(dealt, keys, "key", keys).withColumn("parts", F.ceil(F.col("n") / part).cast("long"))
    shared = shared.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "fp"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    shared = shared.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    return shared.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_meet, "x long, y long").where("x <> y").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node (as a signed long) that each linked node reaches.

    Every round writes its labels; the driver reads one number. A label never rises, and each round lowers one or is the last, so it ends.
    """
    both = links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).where("x <> y").distinct()
    edges = materialize(both, "simhash-edges")
    labels = materialize(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")), "simhash-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("low"))
        step = materialize(labels.join(near, "node").select("node", "root", F.least("root", "low").alias("low")), "simhash-step")
        # pointer jumping: take the label of the label too; a giant component's label is met by many nodes
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        met = step.groupBy("low").agg(F.count(F.lit(1)).alias("n"))
        least = F.least("low", "beyond")
        new = materialize(join_hot(step, jump, "low", met).select("node", least.alias("root"), (least < F.col("root")).alias("moved")), "simhash-labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        discard(step)
        labels = new
        if not moved:
            discard(edges)
            return labels.select("node", "root")


def _members(rows: DataFrame) -> DataFrame:
    """rows (with doc_id and fp) with root, a fingerprint of the row's component, and component_id."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = components(find_links(distinct))
    # one row for each distinct fingerprint, with its component's smallest doc_id
    rooted = materialize(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    members = join_hot(rooted.select("fp", "root"), least.drop("n"), "root", least.select("root", "n")).select("fp", "root", "component_id")
    return join_hot(rows, members, "fp", distinct.select("fp", "n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root (a fingerprint of the component) and component_id for each row of docs."""
    for_texts(docs.sparkSession)
    return _members(materialize(fingerprints(docs.select("doc_id", "text")), "simhash-rows")).select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with all its columns: of each component one row stays, that with the smallest doc_id; on ties the first by text hash, then by place.

    The texts are read once for the fingerprints, and once more to be met by the addresses of the rows that stay.
    """
    for_texts(docs.sparkSession)
    rows = addressed(docs)
    h1, h2 = text_hashes(F.coalesce(F.col("_row.text"), F.lit("")))
    narrow = rows.select(F.col("_row.doc_id").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), *ADDRESS, F.col("_row.text").alias("text"))
    found = _members(materialize(fingerprints(narrow), "simhash-rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2", *ADDRESS)).alias("t")
    keep = found.groupBy("root").agg(first).select(*[F.col(f"t.{c}").alias(c) for c in ADDRESS])
    return pick(rows, keep).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
