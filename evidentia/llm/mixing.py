"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources, in code-point order with null last, weigh 3, 1, 2, repeating, and share 150 % of all words. A target stops at
   twice its source's words; the excess is shared again by weight until none is above.
2. Blocks: each source's documents, however few, fall into 1024 blocks by a keyed hash, so a block is a random part of its source.
   The source's quota is a number of whole blocks out of its passes (a document can be taken twice, once in each pass) plus a part of
   one boundary, a run of blocks with SMALL documents or more (one block in a large source). The boundary is found level by level: the
   runs of the source, 1024 sub-blocks of a large boundary, then the documents of one sub-block, in random order, each taken if it
   still fits. No step orders more than a 2^-20 part of a large source.
3. Splitting tree: the whole-block quotas of all sources are the root. A node draws from a multivariate hypergeometric law how many
   of its blocks of each source go to its left half of the output shards; the right half gets the rest. The leaves are exact quotas
   of each shard, and they add up to the root.
4. Each shard draws its quota from the permuted block list of each source (disjoint ranges of one keyed permutation) and
   shuffles locally, by a keyed hash of the row.

The driver holds one row and the quotas of the shards for each source; block lists stay in the tasks, one source at a time.
Everything follows from the seed and the rows, so reruns agree.

Cases: a null text has size 0; documents of size 0 are taken with their block at no cost; a null source is a source of its own, last;
equal rows are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import ADDRESS, WORD, addressed, for_texts, materialize, pick, text_hashes

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = Fraction(3, 2)
MOST = 2
BLOCKS = 1024
#: The boundary block of a source is cut into parts from FEW x BLOCKS documents on.
FEW = 4096
#: Tables of one row a source are broadcast up to so many sources, and joined beyond.
BROADCAST_SOURCES = 1000
#: The law of the splitting tree is drawn for fewer blocks than this; beyond, sources get fewer blocks each.
MOST_BLOCKS = 1_000_000_000
#: Of a boundary's documents, so many of the smallest, with so many words, are chosen as near to the target as any choice can.
SMALL, SMALL_WORDS = 64, 2_000_000
OUTPUT_SHARDS = 16


def targets(sizes: list[int], weights: list[int], share: Fraction = TOTAL_SHARE, most: int = MOST) -> list[Fraction]:
    """Shares of share x sum(sizes) by weight, none above most x its size; exact."""
    out = [Fraction(0)] * len(sizes)
    free, left = list(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = {w: left * w / total for w in {weights[i] for i in free}}
        full = [i for i in free if over[weights[i]] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = over[weights[i]]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= most * sum(sizes[i] for i in full)
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def splitting_tree(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """[shard, source] block counts: each node splits its quotas between its halves of the shards."""
    if n_shards == 1:
        return quotas[None, :]
    left = n_shards // 2
    total = int(quotas.sum())
    draw = total * left // n_shards
    part = rng.multivariate_hypergeometric(quotas, draw, method="marginals") if total else np.zeros_like(quotas)
    return np.concatenate([splitting_tree(part, left, rng), splitting_tree(quotas - part, n_shards - left, rng)])


def _level(h: Column, level: int) -> Column:
    """The 10 bits of a hash for a level; levels 0 and 1."""
    return F.shiftrightunsigned(h, 54 - 10 * level).bitwiseAND(F.lit(BLOCKS - 1).cast("long")).cast("int")


def _boundary(sums: DataFrame, by: list[str], block: str) -> DataFrame:
    """Per source: the block in which the running total passes need, and what is left of need before it.

    sums: by, block, words, need. At most BLOCKS rows a source.
    """
    run = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = sums.withColumn("after", F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
    return r.where((F.col("before") <= F.col("need")) & (F.col("after") > F.col("need"))).select(*by, F.col(block).alias("edge"), (F.col("need") - F.col("before")).alias("rest"))


def near_subset(words: np.ndarray, rest: int) -> np.ndarray:
    """Which of the units, in their given random order, to take so that their words come near rest.

    First each that still fits; then single additions and exchanges, as long as one brings the sum nearer; last the best of all
    choices among the smallest units (SMALL of them, with SMALL_WORDS words at most), the others staying as they are.
    """
    took, gap = np.zeros(len(words), bool), rest
    for i, w in enumerate(words.tolist()):
        if w <= gap:
            took[i], gap = True, gap - w
    while gap:
        into, out = np.flatnonzero(~took), np.flatnonzero(took & (words > 0))
        if not len(into):
            break
        order = into[np.argsort(words[into], kind="stable")]
        gain = words[order]
        lose = np.concatenate([[0], words[out]])  # nothing, or one unit that is taken
        at = np.searchsorted(gain, gap + lose)
        below, above = np.maximum(at - 1, 0), np.minimum(at, len(gain) - 1)
        off = np.abs(gap + lose - gain[np.stack([below, above])])
        side, k = divmod(int(off.argmin()), len(lose))
        if off[side, k] >= abs(gap):  # each exchange brings the sum nearer, so this ends
            break
        j = (below, above)[side][k]
        took[order[j]] = True
        if k:
            took[out[k - 1]] = False
        gap = int(gap + lose[k] - gain[j])
    free = np.argsort(words, kind="stable")[:SMALL]
    free = free[np.cumsum(words[free]) <= SMALL_WORDS]
    left = gap + int(words[free][took[free]].sum())
    if gap and len(free) and left >= 0:
        took[free] = _nearest_subset(words[free], left)
    return took


def _nearest_subset(words: np.ndarray, rest: int) -> np.ndarray:
    """A subset of few units whose words come nearest to rest: all sums that can be reached, as bits of whole numbers."""
    top = rest + int(words.max(initial=0))
    reach = [1]
    for w in words.tolist():
        reach.append((reach[-1] | reach[-1] << w) & ((1 << (top + 1)) - 1))
    below = (reach[-1] & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> (rest + 1)
    goal = below
    if above and (up := rest + (above & -above).bit_length()) - rest < rest - below:
        goal = up
    took = np.zeros(len(words), bool)
    for i in range(len(words) - 1, -1, -1):
        if not reach[i] >> goal & 1:
            took[i], goal = True, goal - int(words[i])
    return took | (words == 0)


def _fill(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("h", kind="stable")
    return part.loc[near_subset(part["words"].to_numpy(np.int64), int(part["rest"].iloc[0])), ["k", "h"]]


def plan_mixture(docs: DataFrame, seed: int = 7, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, places (array of output shard and order for each copy), and the address of addressed rows."""
    spark = for_texts(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    where = [c for c in ADDRESS if c in docs.columns]
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    d = materialize(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", *text_hashes(text)).alias("h"), *where), "mix-rows")

    per = d.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toArrow()  # one row for each source
    per = sorted(zip(*(per.column(c).to_pylist() for c in ("source", "size", "n"))), key=lambda r: (r[0] is None, r[0] or ""))
    near = F.broadcast if len(per) <= BROADCAST_SOURCES else lambda t: t
    cut = _blocks_each([n for _, _, n in per])
    want = targets([size for _, size, _ in per], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))])
    rows = []
    for k, ((src, size, n), t) in enumerate(zip(per, want)):
        whole = min(MOST, int(t / size)) if size else 0
        runs = min(cut, 1 << max(0, (n // SMALL).bit_length() - 1))
        rows.append((src, k, size, float(t), whole, int(t - whole * size), cut // runs, n >= FEW * BLOCKS))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    names = ["src", "k", "source_size", "target", "whole", "need", "run_blocks", "deep"]
    source = _table(spark, rows, names, kinds, "src string, k int, source_size long, target double, whole int, need long, run_blocks int, deep boolean")
    d = d.join(near(source), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    d = d.withColumn("block", (_level(F.col("h"), 0) % cut).cast("int"))
    d = d.withColumn("run", F.floor(F.col("block") / F.col("run_blocks")).cast("int"))
    d = d.withColumn("part", F.when(F.col("deep"), _level(F.col("h"), 1)).otherwise(F.lit(0)))

    runs = d.groupBy("k", "run").agg(F.sum("size").alias("words"), F.first("need").alias("need"))  # at most BLOCKS rows a source
    edge = materialize(_boundary(runs, ["k"], "run"), "mix-edge")
    inner = d.join(near(edge), "k").where(F.col("run") == F.col("edge"))
    parts = inner.groupBy("k", "part").agg(F.sum("size").alias("words"), F.first("rest").alias("need"))
    edge2 = materialize(_boundary(parts, ["k"], "part").withColumnRenamed("edge", "edge2").withColumnRenamed("rest", "rest2"), "mix-edge2")
    last = inner.join(near(edge2), "k").where(F.col("part") == F.col("edge2"))
    # equal rows have one hash and are taken together; one sub-block of a source at a time
    units = last.groupBy("k", "h").agg(F.sum("size").alias("words"), F.first("rest2").alias("rest"))
    took = units.groupBy("k").applyInPandas(_fill, "k int, h long").withColumn("fit", F.lit(True))  # one part of a source at a time
    took = materialize(took, "mix-took")

    # passes: 0 .. whole-1 take every block; pass `whole` takes the runs before the edge, and the boundary's part
    marked = d.join(took, ["k", "h"], "left").join(near(edge2.select("k", "edge2")), "k", "left").join(near(edge.select("k", "edge")), "k", "left")
    before = F.col("edge").isNull() & (F.col("need") > 0) | (F.col("run") < F.col("edge"))
    inside = (F.col("run") == F.col("edge")) & ((F.col("part") < F.col("edge2")) | F.col("fit"))
    more = F.coalesce(F.when(before | inside, F.lit(1)), F.lit(0))
    marked = marked.withColumn("copies", F.least(F.col("whole") + more, F.lit(MOST)))
    marked = marked.join(_draw(marked, output_shards, seed, near), ["k", "block"], "left")
    order = lambda p: F.xxhash64(F.lit(seed + 1), p, F.col("h"))
    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: F.struct(F.coalesce(F.try_element_at("shards", p), F.raise_error(F.lit("a taken block was not drawn")).cast("int")).alias("out_shard"), order(p).alias("at")))).otherwise(F.array().cast("array<struct<out_shard:int,at:bigint>>"))
    return marked.select("doc_id", "source", "size", "source_size", "target", "copies", places.alias("places"), *where)


def _blocks_each(n_docs: list[int]) -> int:
    """Blocks of each source: BLOCKS, or fewer where all sources together would have too many that hold a document."""
    cut = BLOCKS
    while cut > 1 and MOST * sum(min(n, cut) for n in n_docs) >= MOST_BLOCKS:
        cut //= 2
    return cut


def _table(spark, rows: list[tuple], names: list[str], kinds: list, schema: str) -> DataFrame:
    columns = list(zip(*rows)) or [[]] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)}), schema)


def _draw(marked: DataFrame, output_shards: int, seed: int, near) -> DataFrame:
    """k, block, shards (output shard by pass) for every block that is taken, whole or in part."""
    taken = marked.where("copies > 0").groupBy("k", "block").agg(F.max("copies").alias("passes"))
    taken = materialize(taken, "mix-taken")  # at most BLOCKS rows a source
    sums = taken.groupBy("k").agg(F.sum("passes").alias("n")).orderBy("k").toArrow()  # one row for each source
    ks, quotas = sums.column("k").to_pylist(), sums.column("n").to_numpy().astype(np.int64)
    tree = splitting_tree(quotas, output_shards, np.random.default_rng(seed)) if len(ks) else np.zeros((output_shards, 0), np.int64)
    ends = np.cumsum(tree, axis=0).T.tolist()
    spark = marked.sparkSession
    shard = _table(spark, list(zip(ks, ends)), ["k", "ends"], [pa.int32(), pa.list_(pa.int64())], "k int, ends array<long>")
    lists = taken.select("k", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    # the permuted block list of each source: at most MOST x BLOCKS rows
    permuted = Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed + 2), "k", "pass", "block"), "pass", "block")
    lists = lists.withColumn("at", F.row_number().over(permuted)).join(near(shard), "k")
    lists = lists.withColumn("out_shard", F.size(F.filter("ends", lambda e: e < F.col("at"))))
    return lists.groupBy("k", "block").agg(F.map_from_entries(F.collect_list(F.struct("pass", "out_shard"))).alias("shards"))  # at most MOST entries each


def mix(docs: DataFrame, seed: int = 7, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """docs with all its columns, each row as often as the mix takes it; the drawn places are left to the caller's own sharding."""
    for_texts(docs.sparkSession)
    rows = addressed(docs)
    narrow = rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), F.col("_row.text").alias("text"), *ADDRESS)
    plan = plan_mixture(narrow, seed, output_shards).where("copies > 0").select(*ADDRESS, "copies")
    return pick(rows, plan).withColumn("_place", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    plan = plan_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).cast("long").alias("taken"), "source", "places")
