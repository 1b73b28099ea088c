"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item (a shorter item that has words is one window). The k-grams (K words)
of every text are hashed, and the minimum of each run of WINDOW - K + 1 k-grams is kept as a fingerprint, the rightmost on
ties. Two texts that share WINDOW words share the whole run, hence its minimum: every shared window is met. Document fingerprints
that occur among the benchmark's are extended: the windows around a hit are looked up among the item windows and their words
compared. Items shorter than a window are met by the hashes of all their-length grams.

A benchmark of at most BROADCAST_BYTES is a stated query set that the tasks have whole, in blocks of bounded size; a worker
holds one block at a time. Nothing of the documents is shuffled then, and a passage in a third of them stays with its rows. The
fingerprints of a larger benchmark are joined with the documents' (join_prints), and hits are extended by joining windows.

Cases: null or empty texts have no words; an item without words has no window; items with equal ids count as one; a null item id is
the empty text; an empty benchmark hits nothing; ids and repeated rows pass through.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ADDRESS, addressed, for_texts, join_hot, materialize, mix64, pick, slices, word_hashes, words_of

WINDOW = 10
K = 5
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 21
#: A benchmark of so many bytes of text is broadcast, in blocks; a larger one is joined.
BROADCAST_BYTES = 64 << 20
#: A word, with A-Z.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: 0-9, a-z and all bytes from 0x80 belong to words; A-Z are lower-cased; the rest separates.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 | 1) for j in range(64)]
_NONE = np.uint64(2**64 - 1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position; as many as fit."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += h[j : j + m] * _STEP[j]
    return mix64(out)


def winnow(h: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all texts whose word hashes h stand one after another."""
    w = window - k + 1
    g = grams(h, k)
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:m].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + m], out=least)
    off = np.zeros(m, np.int8)
    for j in range(1, w):
        off[g[j : j + m] == least] = j
    at = (np.arange(m) + off)[doc[:m] == doc[window - 1 :]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at  # never falls: the rightmost minimum moves on
    return at, g[at]


class Block:
    """The fingerprints and windows of some items, as arrays: under 40 bytes a word beside the items' text."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.ids = [i for i, _ in items]
        start, end, which, buf = words_of([t.encode() for _, t in items], TABLE)
        h = word_hashes(start, end, buf)
        self.which, self.words = which.astype(np.int32), Words(start, end, buf)
        self.prints = np.unique(winnow(h, which, window, k)[1])
        size = np.minimum(np.bincount(which, minlength=len(items)), window)
        self.keys: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero((which[: len(h) - n + 1] == which[n - 1 :]) & (size[which[: len(h) - n + 1]] == n))
            g = grams(h, n)[at]
            order = np.argsort(g, kind="stable")
            self.keys[n], self.at[n] = g[order], at[order].astype(np.int32)

    def hits(self, h: np.ndarray, doc: np.ndarray, words: Callable[[], Words], prints: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, set]]:
        """(position, words, item ids) of each occurrence of a window of this block."""
        out = []
        for n, keys in self.keys.items():
            if n == self.window:
                at, fp = prints
                at = at[member(fp, self.prints)]
                begin = np.unique((at[:, None] - np.arange(n - self.k + 1)[None, :]).ravel())
                begin = begin[(begin >= 0) & (begin + n <= len(h))]
            else:
                begin = np.arange(max(0, len(h) - n + 1))
            begin = begin[doc[begin] == doc[begin + n - 1]]
            if not len(begin):
                continue
            g = np.zeros(len(begin), np.uint64)
            for j in range(n):
                g += h[begin + j] * _STEP[j]
            g = mix64(g)
            low, high = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            met: dict[bytes, set] = {}
            for i in np.flatnonzero(high > low).tolist():
                p = int(begin[i])
                shown = words().span(p, n)
                if shown not in met:
                    met[shown] = {self.ids[self.which[q]] for q in self.at[n][low[i] : high[i]].tolist() if self.words.span(q, n) == shown}
                if met[shown]:
                    out.append((p, n, met[shown]))
        return out


class Words:
    """Words one after another with a space between, so neighbours can be compared as one piece."""

    def __init__(self, start: np.ndarray, end: np.ndarray, buf: bytes):
        size = end - start
        self.buf = b" ".join(buf.split())
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def span(self, p: int, n: int) -> bytes:
        return self.buf[self.start[p] : self.end[p + n - 1]]


def member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


def scan(texts: list[bytes], blocks: list) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words, hit words and the sorted ids of the items met, for each text."""
    start, end, doc, buf = words_of(texts, TABLE)
    h = word_hashes(start, end, buf)
    n_words = np.bincount(doc, minlength=len(texts))
    edge = np.zeros(len(h) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    prints: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    words = cache(lambda: Words(start, end, buf))
    for load in blocks:
        block = load()
        key = (block.window, block.k)
        if key not in prints:
            prints[key] = winnow(h, doc, *key)
        for p, n, ids in block.hits(h, doc, words, prints[key]):
            edge[p] += 1
            edge[p + n] -= 1
            items[doc[p]] |= ids
    inside = np.cumsum(edge[:-1]) > 0
    return n_words, np.bincount(doc[inside], minlength=len(texts)), [sorted(s) for s in items]


def _loader(shared, alone: bool) -> Callable[[], Block]:
    """Of several blocks a worker holds one at a time: the broadcast's own copy of the value is given up."""

    def load() -> Block:
        block = shared.value
        if not alone and getattr(shared, "_path", None):
            vars(shared).pop("_value", None)
        return block

    return load


def share_benchmark(benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcast blocks of at most block_bytes of text (or one item)."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).toLocalIterator()
    blocks, items, size = [], [], 0
    for r in itertools.chain(rows, [None]):
        if items and (r is None or size + len(r[1]) > block_bytes):
            blocks.append(sc.broadcast(Block(items, window, k)))
            items, size = [], 0
        if r is not None:
            items.append((r[0], r[1]))
            size += len(r[1])
    return blocks


def is_large(benchmark: DataFrame, most: int) -> bool:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size > most


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (the ids of the items with occurring windows, sorted as strings)."""
    for_texts(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if is_large(benchmark, broadcast_bytes):
        rows = addressed(docs.select("doc_id", "text"))
        words = F.regexp_count(F.coalesce("_row.text", F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")
        narrow = rows.select(*ADDRESS, F.col("_row.doc_id").alias("doc_id"), words.alias("n_words"))
        found = join_prints(rows.select(*ADDRESS, F.col("_row.text").alias("text")), benchmark, window, k)
        out = narrow.join(found, ADDRESS, "left")
        return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    blocks = share_benchmark(benchmark, window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, items = scan_column(b.column("text"), blocks)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")


# --- a benchmark that is too large to broadcast ----------------------------------------------------------------------------------


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Callable[[], Words]]]:
    """Of each slice: its range of rows, and the hashes, owners and bytes of its words."""
    for i, j, texts in slices(column, CHUNK_BYTES):
        start, end, which, buf = words_of([(t or "").encode() for t in texts], TABLE)
        yield i, j, word_hashes(start, end, buf), which, cache(lambda start=start, end=end, buf=buf: Words(start, end, buf))


def _prints(h: np.ndarray, which: np.ndarray, lengths: list[int], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and print of the texts: fingerprints of windows, and all grams of the lengths of short items, told apart by their length."""
    at, fp = winnow(h, which, window, k)
    owner, prints = [which[at]], [fp]
    for n in lengths:
        begin = np.flatnonzero(which[: len(h) - n + 1] == which[n - 1 :]) if len(h) >= n else np.zeros(0, np.int64)
        owner.append(which[begin])
        prints.append(mix64(grams(h, n)[begin] + np.uint64(n)))
    return np.concatenate(owner), np.concatenate(prints)


def _pair(shown: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shown), "<i8").tolist())


def join_prints(texts: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """The addresses of the texts that hold a window of the benchmark, with n_hit and items.

    Fingerprints of texts and benchmark are joined; the windows around a text's hits are then joined by their 128-bit hash to the
    benchmark's windows. A print or window that many texts hold is dealt to several tasks.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, h, which, words in _texts(b.column("text")):
                size = np.bincount(which, minlength=1) if len(which) else np.zeros(0, np.int64)
                rows = []
                for p in range(len(h)):
                    n = min(window, int(size[which[p]]))
                    if p + n <= len(h) and which[p + n - 1] == which[p]:
                        rows.append((int(which[p]) + i, n, *_pair(words().span(p, n))))
                of, n, w1, w2 = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(of, pa.int64())), pa.array(n, pa.int32()), pa.array(w1, pa.int64()), pa.array(w2, pa.int64())], ["item", "n", "w1", "w2"])

    wins = materialize(items.mapInArrow(item_windows, "item string, n int, w1 long, w2 long").distinct(), "item-windows")
    short = sorted(r.n for r in wins.where(F.col("n") < window).select("n").distinct().collect())  # lengths below the window

    def prints(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, h, which, _ in _texts(b.column("text")):
                lengths = short
                owner, fp = _prints(h, which, lengths, window, k)
                if whole:  # of an item: its windows' prints, or that of all its words
                    size = np.bincount(which, minlength=1)
                    keep = np.ones(len(fp), bool)
                    at = len(winnow(h, which, window, k)[1])
                    tag = np.concatenate([np.zeros(at, np.int64), *(np.full(int((which[: max(0, len(h) - n + 1)] == which[n - 1 :]).sum()) if len(h) >= n else 0, n) for n in lengths)])
                    keep = (tag == 0) | (tag == size[owner]) if len(fp) else keep
                    owner, fp = owner[keep], fp[keep]
                both = np.unique(np.stack([owner.astype(np.uint64), fp]), axis=1) if len(fp) else np.zeros((2, 0), np.uint64)
                of = pa.array(both[0].astype(np.int64) + i)
                names = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in names), pa.array(both[1].view(np.int64))], [*names, "fp"])

    own = items.mapInArrow(lambda batches: prints(batches, True), "item string, fp long").select("fp").distinct()
    theirs = materialize(texts.mapInArrow(lambda batches: prints(batches, False), "_file long, _at long, fp long"), "doc-prints")
    met = materialize(theirs.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).join(own, "fp"), "met-prints")
    hits = join_hot(theirs, met.select("fp"), "fp", met).groupBy(*ADDRESS).agg(F.collect_list("fp").alias("met"))  # at most the prints of one text

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, which, words in _texts(b.column("text")):
                hit = [np.array(x, np.int64).view(np.uint64) for x in b.column("met")[i:j].to_pylist()]
                code = lambda owner, fp: mix64(fp + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys = np.sort(np.concatenate([code(np.full(len(x), o), x) for o, x in enumerate(hit)]))
                at, fp = winnow(h, which, window, k)
                at = at[member(code(which[at], fp), keys)]
                begin = np.unique((at[:, None] - np.arange(window - k + 1)[None, :]).ravel())
                begin = begin[(begin >= 0) & (begin + window <= len(h))]
                spots = [(int(p), window) for p in begin[which[begin] == which[begin + window - 1]].tolist()] if len(begin) else []
                for n in short:
                    if len(h) >= n:
                        p = np.flatnonzero(which[: len(h) - n + 1] == which[n - 1 :])
                        spots += [(int(x), n) for x in p[member(code(which[p], mix64(grams(h, n)[p] + np.uint64(n))), keys)].tolist()]
                rows = [(int(which[p]) + i, p, n, *_pair(words().span(p, n))) for p, n in spots]
                of, pos, n, w1, w2 = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in ADDRESS), pa.array(pos, pa.int64()), pa.array(n, pa.int32()), pa.array(w1, pa.int64()), pa.array(w2, pa.int64())], [*ADDRESS, "pos", "n", "w1", "w2"])

    spots = materialize(pick(texts, hits).mapInArrow(windows, "_file long, _at long, pos long, n int, w1 long, w2 long"), "doc-windows")
    counts = spots.groupBy("w1").agg(F.count(F.lit(1)).alias("n"))
    distinct = wins.select("w1", F.col("w2").alias("v2")).groupBy("w1").agg(F.collect_set("v2").alias("v2"))  # two for a clash of 64 bits
    occur = join_hot(spots.select(*ADDRESS, "pos", F.col("n").alias("width"), "w1", "w2"), distinct, "w1", counts).where(F.array_contains("v2", F.col("w2")))
    covered = occur.groupBy(*ADDRESS).agg(F.array_sort(F.collect_set(F.struct("pos", "width"))).alias("spans"))
    # the words under the spans, in order of position
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["pos"] + x["width"] - F.greatest(x["pos"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["pos"] + x["width"]).alias("to"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step, lambda acc: acc["n"])
    named = occur.select(*ADDRESS, "w1", "w2").distinct().join(wins.select("w1", "w2", "item"), ["w1", "w2"])
    ids = named.groupBy(*ADDRESS).agg(F.array_sort(F.collect_set("item")).alias("items"))  # at most the items that one text meets
    return covered.select(*ADDRESS, n_hit.alias("n_hit")).join(ids, ADDRESS)


def scan_column(column: pa.Array, blocks: list) -> tuple[list[int], list[int], list[list[str]]]:
    loads = [_loader(s, len(blocks) == 1) for s in blocks]
    n_words: list[int] = []
    n_hit: list[int] = []
    items: list[list[str]] = []
    for _, _, texts in slices(column, CHUNK_BYTES):
        w, x, s = scan([(t or "").encode() for t in texts], loads)
        n_words += w.tolist()
        n_hit += x.tolist()
        items += s
    return n_words, n_hit, items


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, with all its columns, without the rows whose text has an occurring window."""
    for_texts(docs.sparkSession)
    if is_large(benchmark, broadcast_bytes):
        rows = addressed(docs)
        found = join_prints(rows.select(*ADDRESS, F.col("_row.text").alias("text")), benchmark, window, k)
        return rows.join(found.select(*ADDRESS).hint("shuffle_hash"), ADDRESS, "left_anti").select("_row.*")
    blocks = share_benchmark(benchmark, window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, n_hit, _ = scan_column(b.column("text"), blocks)
            yield b.filter(pa.array([n == 0 for n in n_hit], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lower_items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM lower_items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM lower_docs, (SELECT DISTINCT m FROM iw) AS lens, unnest(range(1, len(w) - m + 2)) AS u(i)),
hit AS (SELECT doc_id, i, m, item FROM dw JOIN iw USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, i, m FROM hit) t, unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
