"""Line dedup: documents probe a sharded minimal perfect hash instead of joining lines.

1. Each document gives the 128-bit hashes of its distinct line keys; a map-side-combined count gives the documents of
   each key. Keys in at least min_docs documents are indexed.
2. The keys are cut into shards of bounded size. Each shard is one task's minimal perfect hash (bit arrays of
   several levels with ranks) that indexes two arrays: a 64-bit fingerprint (the half of the hash that the index is not built
   on) and the saturated count. A probe is a member exactly if the fingerprint at its slot agrees.
3. Documents are rewritten in one pass that probes the arrays. An index of at most BROADCAST_BYTES is broadcast. A larger one
   stays in its shards: probes are dealt to (shard, salt) pairs, with as many salts for a shard as its probes need to keep
   each task bounded (a line in a third of all documents gets many), and only hits travel back to their documents.

Cases: a null or empty text is one empty line; lines whose key is empty are never dropped; a line counts once for each row that
has it, so repeated rows count as rows; when all lines go, the kept text is empty; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ADDRESS, addressed, discard, for_texts, join_hot, materialize, mix64, pick, slices, text_hashes

MIN_DOCS = 10
SHARD_KEYS = 500_000
PROBES_PER_TASK = 1_000_000
BROADCAST_BYTES = 64 << 20


class MinimalPerfectHash:
    """Maps n distinct uint64 keys to 0..n-1. Level by level, keys alone at their bit keep it; the rest go on."""

    def __init__(self, keys: np.ndarray):
        self.n, self.bits, self.ranks, done = len(keys), [], [], 0
        level = 0
        while len(keys):
            size = max(64, 2 * len(keys))
            at = self._at(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            self.ranks.append((done + np.cumsum(alone) - 1).astype(np.int32))
            done += int(alone.sum())
            keys = keys[~alone[at]]
            level += 1

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys that aren't members get any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = self._at(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def __getstate__(self):
        return self.n, [(len(b), np.packbits(b)) for b in self.bits]

    def __setstate__(self, state):
        self.n, packed = state
        self.bits = [np.unpackbits(p, count=k).astype(bool) for k, p in packed]
        self.ranks, done = [], 0
        for b in self.bits:
            self.ranks.append((done + np.cumsum(b) - 1).astype(np.int32))
            done += int(b.sum())


class Shard:
    """A minimal perfect hash with its fingerprint and count arrays."""

    def __init__(self, a: np.ndarray, b: np.ndarray, count: np.ndarray):
        self.mph = MinimalPerfectHash(a)
        at = self.mph.slots(a)
        self.prints, self.counts = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint8)
        self.prints[at], self.counts[at] = b, np.minimum(count, 255)

    def docs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The (saturated) number of documents of each probe, 0 if it isn't in the index."""
        if not len(self.prints):
            return np.zeros(len(a), np.uint8)
        at = self.mph.slots(a)
        return np.where((at >= 0) & (self.prints[at] == b), self.counts[at], 0)


def keys_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and their keys: ASCII white space stripped, A-Z lower-cased."""
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, texts in slices(b.column("text")):
            found: list[bytes] = []
            for text in texts:
                own = set(keys_of(text)[1])
                own.discard(b"")
                found += own
            yield _pairs(found)


def _pairs(found: list[bytes]) -> pa.RecordBatch:
    a, b = hashes(found)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def count_keys(docs: DataFrame, min_docs: int) -> DataFrame:
    """a, b, n: keys in at least min_docs rows of docs."""
    return docs.select("text").mapInArrow(_distinct_keys, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)


def build_index(frequent: DataFrame, n_keys: int) -> tuple[int, DataFrame]:
    """The number of shards, and (shard, n_keys, index): one pickled Shard for each shard that has keys."""
    n_shards = max(1, -(-n_keys // SHARD_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[c].to_numpy().view(np.uint64) for c in "ab")
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n_keys": [len(pdf)], "index": [pickle.dumps(Shard(a, b, pdf["n"].to_numpy()), 5)]})

    return n_shards, frequent.withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, n_keys long, index binary")


def shard_of(a: np.ndarray, n_shards: int) -> np.ndarray:
    return np.mod(a.view(np.int64), n_shards)  # as pmod on the signed long


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of docs."""
    for_texts(docs.sparkSession)
    frequent = materialize(count_keys(docs, min_docs), "line-keys")
    n_keys = frequent.count()
    n_shards, index = build_index(frequent, n_keys)
    index = materialize(index, "line-index")
    size = index.agg(F.sum(F.octet_length("index"))).first()[0] or 0
    discard(frequent)
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string"
    if size > broadcast_bytes:
        return _through_shards(docs, index, n_shards, schema, min_docs)
    shared = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r["index"]) for r in index.collect()})  # of checked size
    discard(index)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: pickle.loads(v) for k, v in shared.value.items()}
        for batch in batches:
            for i, j, texts in slices(batch.column("text")):
                split = [keys_of(t) for t in texts]
                a, b = hashes([k for _, keys in split for k in keys])
                drop = np.zeros(len(a), bool)
                which = shard_of(a, n_shards)
                for k, s in shards.items():
                    own = np.flatnonzero(which == k)
                    drop[own] = s.docs(a[own], b[own]) > 0
                yield _kept(batch.column("doc_id")[i:j], split, drop)

    return docs.mapInArrow(rewrite, schema)


def _kept(ids: pa.Array, split: list[tuple[list[bytes], list[bytes]]], drop: np.ndarray) -> pa.RecordBatch:
    n_lines, n_dropped, texts, at = [], [], [], 0
    for lines, keys in split:
        flags = drop[at : at + len(lines)]
        at += len(lines)
        if flags.any():
            lines = [x for x, k, f in zip(lines, keys, flags) if not (f and k)]
        n_lines.append(len(keys))
        n_dropped.append(len(keys) - len(lines))
        texts.append(b"\n".join(lines))
    return pa.RecordBatch.from_arrays([ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def _through_shards(docs: DataFrame, index: DataFrame, n_shards: int, schema: str, min_docs: int) -> DataFrame:
    """The way for an index beyond the broadcast bound. Equal texts share their probes; rows get the hits of their text by their address."""
    rows = addressed(docs)
    h1, h2 = text_hashes(F.coalesce(F.col("_row.text"), F.lit("")))
    narrow = materialize(rows.select(*ADDRESS, h1.alias("h1"), h2.alias("h2")), "line-rows")
    first = narrow.groupBy("h1", "h2").agg(F.min(F.struct(*ADDRESS)).alias("a")).select("a.*", "h1", "h2")
    texts = pick(rows, first).select("h1", "h2", F.col("_row.text").alias("text"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                keys = keys_of(text)[1]
                a, b = hashes(keys)
                at = np.flatnonzero([bool(k) for k in keys])
                one = [pa.array(np.repeat(x, len(at))) for x in (batch.column("h1")[i : i + 1].to_numpy(), batch.column("h2")[i : i + 1].to_numpy())]
                yield pa.RecordBatch.from_arrays([*one, pa.array(at), *(pa.array(x[at].view(np.int64)) for x in (a, b)), pa.array(shard_of(a[at], n_shards).astype(np.int32))], ["h1", "h2", "pos", "a", "b", "shard"])

    p = materialize(texts.mapInArrow(probes, "h1 long, h2 long, pos long, a long, b long, shard int"), "line-probes")
    salts = p.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBES_PER_TASK).cast("int").alias("salts"))
    index = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "index")
    p = p.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.xxhash64("h1", "pos"), F.col("salts")).cast("int"))  # n_shards rows at most

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(left.num_rows, bool)
        if right.num_rows and left.num_rows:
            a, b = (left.column(c).to_numpy().view(np.uint64) for c in "ab")
            hit = pickle.loads(right.column("index")[0].as_py()).docs(a, b) > 0
        return left.select(["h1", "h2", "pos"]).filter(pa.array(hit))

    hits = p.select("h1", "h2", "pos", "a", "b", "shard", "salt").groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInArrow(look, "h1 long, h2 long, pos long")
    hits = hits.groupBy("h1", "h2").agg(F.collect_list("pos").alias("gone"))  # at most the lines of one text
    # the copies of a text may be a third of the rows; a clash of 64 bits gives two texts a key, told apart by the other half
    by_key = hits.groupBy("h1").agg(F.collect_list(F.struct("h2", "gone")).alias("texts"))
    met = join_hot(narrow, by_key, "h1", narrow.groupBy("h1").agg(F.count(F.lit(1)).alias("n"))).withColumn("own", F.filter("texts", lambda x: x["h2"] == F.col("h2")))
    met = met.where(F.size("own") > 0).select(*ADDRESS, F.col("own")[0]["gone"].alias("gone"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [keys_of(t) for t in batch.column("text").to_pylist()]
            drop = []
            for (lines, _), gone in zip(split, batch.column("gone").to_pylist()):
                flags = np.zeros(len(lines), bool)
                flags[gone or []] = True
                drop.append(flags)
            yield _kept(batch.column("doc_id"), split, np.concatenate(drop) if drop else np.zeros(0, bool))

    out = rows.join(met.hint("shuffle_hash"), ADDRESS, "left")
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "gone").mapInArrow(rewrite, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT r, doc_id, i, x[i] AS line,
         translate(trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents) t, unnest(range(1, len(x) + 1)) AS u(i)),
often AS (SELECT k FROM lines WHERE length(k) > 0 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM often)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM often)), '')) AS kept_sha256
FROM lines GROUP BY r, doc_id
"""
