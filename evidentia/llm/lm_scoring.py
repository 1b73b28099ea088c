"""Language-model scoring with a hashed maximum-entropy model.

Tokens: A-Z lower-cased words split at ASCII white space, then one end token for each text. A token is known
by a 64-bit hash.

Corpus statistics cover every training document (crc32 of the id as text is not 0 modulo 10): the count of each token, and how often
each hashed context feature is followed by each class.

Model: a class-factored softmax over the whole vocabulary. A token's hash gives it a path of classes, of BRANCHES each: a class, a class
within it, and so on for 1 to LEVELS levels, as many as the number of distinct tokens asks for. Tokens that end in one class are told apart by
their smoothed counts. At each level P(class | context) is a softmax of

    log P(class) + sum over features f of weight[level, f, band] * strength[f, class]

with the hashed features of the context: the previous word, the word before it (skip) and the pair, each by the full hashes of its words,
so every word of the corpus counts as a token to be predicted and as context. Features come in two forms. Tables of 2^ROW_BITS hashed rows
a level (fewer for a small vocabulary) hold the counts of a feature with each class; the strength for a class is the logarithm of the
smoothed count over what the class's own share expects. The memory holds, for every context feature of the training texts, however rare it is, the class path
that followed it most (the greater path on ties) and how often; a class on that path has strength 1, the others 0. The weights, one for each level, feature and band of the row's count, are trained by distributed gradient
updates: the training texts are dealt to as many parts as there are rounds (ROUNDS), so each text is in one; in each round the tasks sum
the gradient and curvature of the next part, and the driver takes a Newton step. A token's own count is taken out of its rows while training, so rare features are
weighed by what they say about other texts. Scoring works on numpy batches and gathers only the rows that a batch's contexts have.

The memory grows with the corpus and is never in one place. Rows that stand together in a file make blocks of some megabytes of text. A block
counts its features with the paths that follow them and sends the counts, packed, to ranges of the features' hashes (48 bits; among n features
about n in 2^48 share one). A range adds up the counts of all blocks and answers each block with what its features recall. The answers are
written; training and scoring meet a block's texts with them.

Counts of tokens: the most frequent HEAD (a fixed number) are broadcast as two arrays. Other tokens of a text are joined to the counts
by their hash, and only their sums come back to the text's row.

Cases: a null or empty text is the end token alone; a null id is held out; an empty training set gives uniform smoothing
(N = V = 0); repeated rows count as rows; an empty table gives an empty result. Long texts are read whole, in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.tables import shuffles_dropped
from evidentia.llm.common import ADDRESS, LOWER_SPACE, addressed, discard, for_texts, held_out, materialize, mix64, slices, word_hashes, words_of

SMOOTH = 0.1
HEAD = 1 << 20
#: Classes at a node of a token's path, as bits; and the most levels.
BITS, LEVELS = 4, 4
BRANCHES = 1 << BITS
#: Rows of the feature table of a level, as bits: at least and at most.
LEAST_BITS, ROW_BITS = 10, 16
#: Bytes of text of a block, rows that stay together in one, and training tokens for each range of the memory.
BLOCK_BYTES, BLOCK_ROWS, RANGE_TOKENS = 8 << 20, 64, 2_000_000
#: Counted features that a range takes in at once.
MERGE_ROWS = 4_000_000
#: Counts that are added up by themselves; smaller ones are by repeating what they count.
LARGE_COUNT = 8
#: Bands of a row's count, by powers of two; each has weights of its own.
BANDS = 20
#: Pseudo-count of a class's own share in the strength of a feature.
KAPPA = 5.0
#: Training rounds, and the parts that all training texts are dealt to; each round uses the next part.
ROUNDS = 6
#: Pieces that the tables are added up in, and the most tasks that make them.
SLICES, MOST_TASKS = 32, 1 << 16
#: Tokens that a task counts, where there are more than the cores take.
TASK_TOKENS = 50_000_000
#: Pieces that a task adds up.
AT_A_TIME = 64
#: The hash of the end token; no word hashes to it in practice, as a word's hash is a mixed 64-bit value.
END = np.uint64(0xE4D0E4D0E4D0E4D1)
CHUNK_BYTES = 1 << 21


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts one after another, and the tokens of each text, its end included."""
    start, end, doc, buf = words_of(texts, LOWER_SPACE)
    size = np.bincount(doc, minlength=len(texts)) + 1 if len(texts) else np.zeros(0, np.int64)
    out = np.empty(len(start) + len(texts), np.uint64)
    out[np.arange(len(start)) + doc] = word_hashes(start, end, buf)
    out[np.cumsum(size) - 1] = END
    return out, size


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    for i, j, texts in slices(b.column("text"), CHUNK_BYTES):
        yield i, j, [(t or "").encode() for t in texts]


def _unique_counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count_tokens(train: DataFrame) -> DataFrame:
    """h, c: the count of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c = _unique_counts([tokens(t)[0] for _, _, t in _texts(b)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the most frequent tokens, all of those over some count: hashes in order, and counts."""
    band = F.floor(F.log2("c") * 16).cast("int")  # a few hundred bands whatever the counts
    low, total = None, 0
    for r in sorted(counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.band):
        if total + r.n > most:
            break
        low, total = r.band, total + r.n
    if low is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counts.where(band >= low).select("h", "c").toArrow()  # at most `most` rows
    h, c = t.column("h").to_numpy().view(np.uint64), t.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(z - shift), its sum in each row, and shift: 0 but for rows whose sum would leave the floats' range, which are shifted by their maximum."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = np.einsum("ij->i", e)
    shift = np.zeros(len(z), z.dtype)
    far = np.flatnonzero(~((total > 1e-30) & (total < 1e37)))
    if len(far):
        shift[far] = z[far].max(axis=1)
        e[far] = np.exp(z[far] - shift[far, None])
        total[far] = e[far].sum(axis=1)
    return e, total, shift


def log_sum(z: np.ndarray) -> np.ndarray:
    _, total, shift = exps(z)
    return np.log(total) + shift


_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: The features that a level's table has: 0 the previous word, 1 the word before it (2 is the pair). The memory has all three at each level.
USED = ((0, 1), (0,), (0,), (0,))
FEATURES = 3
#: Tokens that are scored at once.
AT_ONCE = 3000
#: The band of a memory's count, and that of its square.
_COUNTS = np.arange(1 << 16, dtype=np.float64)
BAND_OF, BAND_OF_SQUARE = (np.minimum(np.log2(x + 1), BANDS - 1).astype(np.int8) for x in (_COUNTS, _COUNTS * _COUNTS))


def levels_for(n_distinct: int) -> int:
    """As many levels as leave a few tokens to a class, LEVELS at most."""
    return min(LEVELS, max(1, math.ceil(math.log(max(2, n_distinct / 4), BRANCHES))))


def row_bits_for(n_distinct: int) -> int:
    return min(ROW_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, n_distinct)))))


def leaves(h: np.ndarray, levels: int) -> np.ndarray:
    """The path of a token's classes, as one number."""
    return (mix64(h ^ _K[2]) >> np.uint64(64 - BITS * levels)).astype(np.int64)


def context(h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The hashes of the context features of each token; before a text stands a token of its own."""
    one, two = np.full_like(h, 7), np.full_like(h, 7)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = np.cumsum(size) - size
    one[first] = two[first] = 7
    two[first[size > 1] + 1] = 7
    return [mix64(one * _K[0]), mix64(two * _K[1] + np.uint64(1)), mix64(one * _K[2] + mix64(two * _K[0]))]


class Grid:
    """The shape of a model: paths, and rows of the feature tables."""

    def __init__(self, levels: int, row_bits: int):
        self.levels, self.row_bits = levels, row_bits

    def step(self, leaf: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The node and the class within it that a path takes at a level."""
        return leaf >> (BITS * (self.levels - level)), (leaf >> (BITS * (self.levels - 1 - level))) & (BRANCHES - 1)

    def salt(self, level: int, node: np.ndarray) -> np.ndarray:
        return mix64(node.astype(np.uint64) * _K[1] + np.uint64(level + 1))

    def rows(self, feats: list[np.ndarray], level: int, node: np.ndarray) -> list[np.ndarray]:
        """The row of each feature of the level: a hash of the feature and the node."""
        at = self.salt(level, node) if len(node) < BRANCHES**level else self.salt(level, np.arange(BRANCHES**level)).take(node)
        return [(mix64(feats[f] ^ at) >> np.uint64(64 - self.row_bits)).view(np.int64) for f in USED[level]]

    def counts(self, h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Of each level, how often each row is followed by each class."""
        out = [np.zeros(BRANCHES << self.row_bits, np.uint32) for _ in range(self.levels)]
        self.count_into(out, h, size)
        return [x.astype(np.int64) for x in out]

    def count_into(self, total: list[np.ndarray], h: np.ndarray, size: np.ndarray) -> None:
        leaf, feats = leaves(h, self.levels), context(h, size)
        for level in range(self.levels):
            node, branch = self.step(leaf, level)
            for row in self.rows(feats, level, node):
                row <<= BITS
                row |= branch
                np.add.at(total[level], row, np.uint32(1))  # numpy is slow here if the kinds differ


class Memory:
    """A memory of fixed size in one process, for models of few texts; score_texts uses the whole one (see remember).

    For each hashed context feature its most frequent follower: a slot holds the feature's tag, the follower's leaf and their count.
    """

    def __init__(self, bits: int, keys: np.ndarray | None = None, n: np.ndarray | None = None):
        self.bits = bits
        self.keys = np.zeros((FEATURES, 1 << bits), np.uint32) if keys is None else keys
        self.n = np.zeros((FEATURES, 1 << bits), np.uint16) if n is None else n

    def slots(self, feat: np.ndarray) -> np.ndarray:
        return (feat >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, h: np.ndarray, size: np.ndarray, levels: int) -> None:
        leaf = leaves(h, levels).astype(np.uint64)
        for f, feat in enumerate(context(h, size)):
            pair = (feat >> np.uint64(64 - self.bits) << np.uint64(32)) | ((feat & np.uint64(0xFFFF)) << np.uint64(16)) | leaf
            pair, n = np.unique(pair, return_counts=True)
            slot = (pair >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((n, slot))
            last = order[np.flatnonzero(np.append(slot[order][1:] != slot[order][:-1], True))] if len(order) else order
            self.keys[f], self.n[f] = keep_larger(self.keys[f], self.n[f], slot[last], (pair[last] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[last])

    def look(self, f: int, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The follower's leaf, and the count (0 for a feature that has no slot)."""
        at = self.slots(feat)
        key = self.keys[f].take(at)
        return (key & np.uint32(0xFFFF)).astype(np.int64), np.where((key >> np.uint32(16)) == (feat & np.uint64(0xFFFF)), self.n[f].take(at), 0).astype(np.int64)


def keep_larger(keys: np.ndarray, n: np.ndarray, at: np.ndarray, key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots with new entries merged in: equal keys add up, of different ones the more frequent stays, the greater on ties."""
    own, have = keys[at], n[at].astype(np.int64)
    same = own == key
    take = ~same & ((more > have) | ((more == have) & (key > own)))
    keys[at] = np.where(take, key, own)
    n[at] = np.minimum(np.where(same, have + more, np.where(take, more, have)), 65535).astype(np.uint16)
    return keys, n


class Weights:
    """What training changes: a weight for each level, feature and band, of the tables and of the memory."""

    def __init__(self, levels: int):
        self.tables = [np.full((len(USED[level]), BANDS), 0.5) for level in range(levels)]
        self.recall = np.full((levels, FEATURES, BANDS), 0.5)

    def update(self, sums: np.ndarray) -> None:
        """A damped Newton step for each weight by itself; features overlap, so each goes half of its way."""
        step = np.clip(0.5 * sums[0] / (sums[1] + 10.0), -1.0, 1.0)
        for level, w in enumerate(self.tables):
            w += step[0, level, : len(w)]
        self.recall += step[1]


class MaxEnt:
    def __init__(self, grid: Grid, mass: np.ndarray, tables: list[np.ndarray], memory: Memory | None, weights: Weights | None = None):
        """mass: the smoothed count of each leaf; tables: for each level, the count of each row and class."""
        self.grid, self.mass, self.memory, self.weights = grid, mass, memory, weights or Weights(grid.levels)
        self.share = []
        for level in range(grid.levels):
            m = mass.reshape(BRANCHES**level, BRANCHES, -1).sum(axis=2)
            self.share.append((m / m.sum(axis=1, keepdims=True)).astype(np.float32))
        self.log_share = [np.log(x) for x in self.share]
        self.tables = [t.reshape(-1, BRANCHES).astype(np.float32, copy=False) for t in tables]
        # all levels in one array each, as numpy takes its time for every call: nodes stand after those of the levels before, and rows as well
        self._node = np.cumsum([0] + [BRANCHES**level for level in range(grid.levels)])[:-1, None]
        self._inverse, self._log_share = 1 / np.concatenate(self.share), np.concatenate(self.log_share)
        self._salt = np.concatenate([grid.salt(level, np.arange(BRANCHES**level)) for level in range(grid.levels)])
        self._counts = np.concatenate(self.tables)
        # the first level has one node, so the strengths of its rows are known beforehand
        first = self.tables[0] * self._inverse[0] + np.float32(KAPPA)
        self._rows = np.concatenate([np.log(first), *self.tables[1:]])
        # of a row's total, as it is and without the token itself
        total = self._counts.sum(axis=1)
        self._band = [np.minimum(np.log2(np.maximum(total - own, 0) + 1).astype(np.int64), BANDS - 1) for own in (0, 1)]
        self._dense = [(level, k, f) for level in range(grid.levels) for k, f in enumerate(USED[level])]

    def _parts(self, h: np.ndarray, size: np.ndarray, own: int, recalled: np.ndarray | None = None, strengths: bool = True):
        """Of each run of tokens and each level: place, class taken, classes' logits, and what the run as a whole has, at all levels.

        That is: logits, places of the classes taken in them, what the features of the tables give (strengths, places of the classes taken,
        weights' places), and those of the memory (places in the logits, whether the class was taken, weights' places). A strength lacks the
        logarithm of its row's total, which is the same for all classes.

        With own = 1 the counts of the token itself are left out. recalled: what the whole memory gives for each token, as recall gives it;
        its counts enter their bands by their squares, so that counts of one, two and three have weights of their own. Without strengths
        (with own = 0 only) what the tables give is left out, and the first level's strengths are weighed row by row, not token by token.
        """
        levels, bits = self.grid.levels, self.grid.row_bits
        leaf, feats = leaves(h, levels), context(h, size)
        weights = np.zeros((levels, FEATURES, BANDS), np.float32)
        for level, w in enumerate(self.weights.tables):
            weights[level, : len(w)] = w
        weights, recall_weights = weights.ravel(), self.weights.recall.astype(np.float32).ravel()
        down = np.arange(levels - 1, -1, -1)[:, None] * BITS
        at_level = [level for level, _, _ in self._dense]
        first_row = np.array(at_level)[:, None] << bits
        first_cell = np.array([(level * FEATURES + k) * BANDS for level, k, _ in self._dense])[:, None]
        alone = len(USED[0])  # the first level's features; each level after it has one
        bands = BAND_OF if recalled is None else BAND_OF_SQUARE
        if not strengths:
            first = slice(0, 1 << bits)
            ready = [weights.take(self._band[own][first] + k * BANDS)[:, None] * self._rows[first] for k in range(alone)]
            ready[0] += self._log_share[0]
        for i in range(0, len(h), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            target, some = leaf[part], [f[part] for f in feats]
            n = len(target)
            path = target >> down
            branch = path & (BRANCHES - 1)
            node = (path >> BITS) + self._node
            rows = mix64(np.stack([some[f] for _, _, f in self._dense]) ^ self._salt.take(node)[at_level]) >> np.uint64(64 - bits)
            rows = (rows.astype(np.int64) + first_row).ravel()
            taken = (np.arange(levels * n) * BRANCHES).reshape(levels, n) + branch
            dense_taken = ((np.arange(len(rows)) * BRANCHES).reshape(-1, n) + branch[at_level]).ravel() if strengths else None
            strength = self._rows.take(rows if strengths else rows[alone * n :], axis=0)
            flat, deeper = strength.reshape(-1), strength[alone * n :] if strengths else strength
            if own:
                there = dense_taken[alone * n :]
                flat[there] = np.maximum(flat[there] - 1, 0)
            # smoothed by the class's own share, so a row that was never met says nothing
            deeper *= self._inverse.take(node[1:].ravel(), axis=0)
            deeper += np.float32(KAPPA)
            np.log(deeper, out=deeper)
            if own:
                there = np.tile(branch[0], alone)
                less = np.maximum(self._counts.reshape(-1)[rows[: alone * n] * BRANCHES + there] - 1, 0)
                flat[dense_taken[: alone * n]] = np.log(less * self._inverse[0][there] + np.float32(KAPPA))
            if strengths:
                cell = (self._band[own].take(rows).reshape(-1, n) + first_cell).ravel()
                weighed = weights.take(cell)[:, None] * strength
                z = self._log_share.take(node.ravel(), axis=0)
                for k in range(alone):
                    z[:n] += weighed[k * n : (k + 1) * n]
                z[n:] += weighed[alone * n :]
            else:
                cell = (self._band[own].take(rows[alone * n :]).reshape(-1, n) + first_cell[alone:]).ravel()
                z = np.empty((levels * n, BRANCHES), np.float32)
                np.take(ready[0], rows[:n], axis=0, out=z[:n], mode="clip")
                for k in range(1, alone):
                    z[:n] += ready[k].take(rows[k * n : (k + 1) * n], axis=0)
                np.multiply(weights.take(cell)[:, None], deeper, out=z[n:])
                z[n:] += self._log_share.take(node[1:].ravel(), axis=0)
            # a follower counts at a level if it takes the token's classes at the levels before
            if recalled is None:
                after, count = (np.stack(x) for x in zip(*(self.memory.look(f, some[f]) for f in range(FEATURES))))
            else:
                after, count = recalled[:FEATURES, part], recalled[FEATURES:, part]
            if own:
                count = count - ((after == target) & (count > 0))
            at = np.flatnonzero(count)
            feature = np.repeat(np.arange(FEATURES), np.diff(np.searchsorted(at, np.arange(FEATURES + 1) * n)))
            after, memory_cell = after.ravel()[at].astype(np.int64), feature * BANDS + bands[count.ravel()[at]]
            at -= feature * n
            sparse = []
            for level in range(levels):
                to = (after >> down[level, 0]) & (BRANCHES - 1)
                hit = to == branch[level][at]
                sparse.append(((level * n + at) * BRANCHES + to, hit, memory_cell + level * FEATURES * BANDS))
                at, after, memory_cell = at[hit], after[hit], memory_cell[hit]
            sparse = [np.concatenate(x) for x in zip(*sparse)]
            np.add.at(z.reshape(-1), sparse[0], recall_weights.take(sparse[2]))
            for level in range(levels):
                yield part, level, branch[level], z[level * n : (level + 1) * n], (z, taken, strength, dense_taken, cell), sparse

    def log10(self, h: np.ndarray, size: np.ndarray, recalled: np.ndarray | None = None) -> np.ndarray:
        """log10 P(leaf | context) of each token; P(token | leaf) is its smoothed count over the leaf's mass."""
        out = np.zeros(len(h))
        for part, level, _, _, (z, taken, *_), _ in self._parts(h, size, 0, *(() if recalled is None else (recalled, False))):
            if level == 0:
                out[part] = (z.reshape(-1)[taken] - log_sum(z).reshape(taken.shape)).sum(axis=0, dtype=np.float64)
        return out / math.log(10)

    def gradient(self, h: np.ndarray, size: np.ndarray, recalled: np.ndarray | None = None) -> np.ndarray:
        """[2, tables or memory, level, feature, band]: gradient and curvature of the log probability of training tokens, their own counts left out."""
        shape = (self.grid.levels, FEATURES, BANDS)
        out = np.zeros((2, 2, *shape))

        def add(where: np.ndarray, cell: np.ndarray, x: np.ndarray) -> None:
            where += np.bincount(cell, x, math.prod(shape)).reshape(shape)

        for _, level, _, _, (z, _, strength, taken, cell), sparse in self._parts(h, size, 1, *(() if recalled is None else (recalled,))):
            if level:
                continue
            p, total, _ = exps(z)  # p is left times its total
            less = 1 / total
            n, alone = len(z) // self.grid.levels, len(USED[0])
            weighed = np.empty_like(strength)
            for k in range(alone):
                np.multiply(strength[k * n : (k + 1) * n], p[:n], out=weighed[k * n : (k + 1) * n])
            np.multiply(strength[alone * n :], p[n:], out=weighed[alone * n :])
            by = np.concatenate([less[:n]] * alone + [less[n:]])
            mean = np.einsum("ij->i", weighed) * by
            add(out[0, 0], cell, strength.reshape(-1)[taken] - mean)
            add(out[1, 0], cell, np.einsum("ij,ij->i", weighed, strength) * by - mean * mean)
            place, hit, cell = sparse
            q = p.reshape(-1)[place] * less[place >> BITS]
            add(out[0, 1], cell, hit - q)
            add(out[1, 1], cell, q * (1 - q))
        return out


def _pack(x: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counts as bytes, with the places and the rest of those over 254: most are small."""
    at = np.flatnonzero(x >= 255)
    return np.minimum(x, 255).astype(np.uint8).tobytes(), at.astype(np.int32).tobytes(), (x[at] - 255).astype(np.int64).tobytes()


def _unpack(low: bytes, at: bytes, more: bytes) -> np.ndarray:
    x = np.frombuffer(low, np.uint8).astype(np.int64)
    x[np.frombuffer(at, np.int32)] += np.frombuffer(more, np.int64)
    return x


_PACKED = ["low", "at", "more", "keys", "n"]


def _piece(groups: list[tuple[int, int]], rows: list[tuple[bytes, ...]]) -> pa.RecordBatch:
    """slice, group, and the packed tables and memory of each piece."""
    return pa.RecordBatch.from_arrays(
        [pa.array([g[0] for g in groups], pa.int32()), pa.array([g[1] for g in groups], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(len(_PACKED)))], ["slice", "group", *_PACKED]
    )


def _add_pieces(t: pa.Table) -> pa.Table:
    total, keys, n = 0, None, None
    for row in zip(*(t.column(c) for c in _PACKED)):
        low, at, more, k, c = (x.as_py() for x in row)
        total = total + _unpack(low, at, more)
        k, c = np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint16)
        keys, n = (k.copy(), c.copy()) if keys is None else keep_larger(keys, n, np.arange(len(k)), k, c.astype(np.int64))
    return pa.Table.from_batches([_piece([(t.column("slice")[0].as_py(), t.column("group")[0].as_py())], [(*_pack(total), keys.tobytes(), n.tobytes())])])


def count_features(train: DataFrame, grid: Grid, memory_bits: int | None = None, n_tokens: int = 0) -> tuple[list[np.ndarray], Memory | None]:
    """Of each level, the count of each row and class over all training texts, and a memory of fixed size if memory_bits are given.

    Each task hands on one set of tables of a fixed size, so there is one task for each core, or for TASK_TOKENS tokens if these are more
    (MOST_TASKS at most). Sets are cut into slices, and the pieces of a slice are added up, AT_A_TIME at a time.
    """
    tasks = min(MOST_TASKS, max(train.sparkSession.sparkContext.defaultParallelism, n_tokens // TASK_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, memory = None, Memory(memory_bits or 0)
        for b in batches:
            for _, _, texts in _texts(b):
                h, size = tokens(texts)
                total = total or [np.zeros(BRANCHES << grid.row_bits, np.uint32) for _ in range(grid.levels)]
                grid.count_into(total, h, size)
                if memory_bits is not None:
                    memory.add(h, size, grid.levels)
        if total is not None:
            group = TaskContext.get().partitionId()
            sums, keys, n = (np.array_split(x, SLICES, axis=-1) for x in (np.stack(total), memory.keys, memory.n))
            for k in range(SLICES):
                yield _piece([(k, group)], [(*_pack(sums[k].ravel()), keys[k].tobytes(), n[k].tobytes())])

    kind = "slice int, group int, low binary, at binary, more binary, keys binary, n binary"
    pieces = train.select("text").coalesce(tasks).mapInArrow(run, kind)
    while tasks > AT_A_TIME:
        pieces = pieces.withColumn("group", F.floor(F.col("group") / AT_A_TIME).cast("int")).groupBy("slice", "group").applyInArrow(_add_pieces, kind)
        tasks = -(-tasks // AT_A_TIME)
    rows = sorted(pieces.groupBy("slice").applyInArrow(_add_pieces, kind).collect(), key=lambda r: r["slice"])  # SLICES rows
    if not rows:
        return [np.zeros(BRANCHES << grid.row_bits, np.float32)] * grid.levels, None if memory_bits is None else Memory(memory_bits)
    sums = [_unpack(r["low"], r["at"], r["more"]).reshape(grid.levels, -1).astype(np.float32) for r in rows]
    if memory_bits is None:
        return list(np.concatenate(sums, axis=1)), None
    keys, n = ([np.frombuffer(r[c], kind).reshape(FEATURES, -1) for r in rows] for c, kind in (("keys", np.uint32), ("n", np.uint16)))
    return list(np.concatenate(sums, axis=1)), Memory(memory_bits, np.concatenate(keys, axis=1), np.concatenate(n, axis=1))


_LEAF = np.uint64(0xFFFF)


def _first(x: np.ndarray) -> np.ndarray:
    """Whether each item of a sorted array differs from the one before it."""
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, their second bytes and so on, compressed: planes of zeros take no room."""
    planes = np.zeros((x.itemsize, len(x)), np.uint8)
    most = int(x.max()) if len(x) else 0
    for k in range(-(-most.bit_length() // 8)):
        planes[k] = (x >> x.dtype.type(8 * k)).astype(np.uint8)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(x: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(x, decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    out = planes[0].astype(kind)
    for k in range(1, width):
        if planes[k].any():
            out |= planes[k].astype(kind) << kind(8 * k)
    return out


def _features(h: np.ndarray, size: np.ndarray, levels: int) -> np.ndarray:
    """The context features of each token: 48 bits of the hash, then the leaf that follows."""
    leaf = leaves(h, levels).astype(np.uint64)
    return np.concatenate([(feat & ~_LEAF) | leaf for feat in context(h, size)])


def _block_counts(block: int, e: np.ndarray, ranges: int) -> pa.RecordBatch:
    """What a block sends to each range: the features and followers of its training texts with their counts, or the features alone that its held-out texts ask for."""
    if block % 2:
        e = e & ~_LEAF
    e.sort()
    at = np.flatnonzero(_first(e))
    u, n = e[at], np.diff(np.append(at, len(e))).astype(np.uint32)
    cut = np.append(np.searchsorted(u, np.array([(i << 64) // ranges for i in range(ranges)], np.uint64) & ~_LEAF), len(u))
    some = [i for i in range(ranges) if cut[i] < cut[i + 1]]
    parts = [slice(cut[i], cut[i + 1]) for i in some]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some, pa.int32()),
            pa.array([block] * len(some), pa.int64()),
            pa.array([p.stop - p.start for p in parts], pa.int32()),
            pa.array([squeeze(np.diff(u[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
            pa.array([None if block % 2 else squeeze(n[p]) for p in parts], pa.binary()),
        ],
        ["range", "block", "size", "u", "n"],
    )


def _count_blocks(batches: Iterator[pa.RecordBatch], levels: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The counts of blocks from rows of block, text. A block whose rows do not come together is sent in parts."""
    waiting: dict[int, list[np.ndarray]] = {}
    for b in batches:
        block = b.column("block").to_numpy()
        now = np.unique(block).tolist()
        for x in [x for x in waiting if x not in now]:
            yield _block_counts(x, np.concatenate(waiting.pop(x)), ranges)
        for x in now:
            waiting.setdefault(x, []).extend(_features(*tokens(t), levels) for _, _, t in _texts(b.filter(pa.array(block == x))))
    for x, e in waiting.items():
        yield _block_counts(x, np.concatenate(e), ranges)


def _sum_counts(us: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each feature and follower once, in order, with the sum of its counts: a small count is so many places in the sorting, which sorts nothing else."""
    u, n = np.concatenate(us), np.concatenate(ns)
    more, large = np.flatnonzero((n > 1) & (n < LARGE_COUNT)), np.flatnonzero(n >= LARGE_COUNT)
    x = np.concatenate([u, np.repeat(u[more], n[more] - 1)])
    x.sort()
    at = np.flatnonzero(_first(x))
    total = np.diff(np.append(at, len(x)))
    x = x[at]
    np.add.at(total, np.searchsorted(x, u[large]), n[large] - 1)
    return x, total


def most_frequent(u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted features with followers and their counts: each feature, its most frequent follower (the greater on ties) and the count."""
    feat = u & ~_LEAF
    new = _first(feat)
    at = np.flatnonzero(new)
    top = np.maximum.reduceat(n, at) if len(at) else n
    group = np.cumsum(new) - 1
    best = np.flatnonzero(n == top[group])
    last = best[np.append(group[best][1:] != group[best][:-1], True)] if len(best) else best
    return feat[at], (u[last] & _LEAF).astype(np.uint16), top


def _range_answers(t: pa.Table) -> pa.Table:
    """The most frequent follower over all blocks, for each feature that a block has in the range, in the features' order."""
    rows = list(zip(*(t.column(c).to_pylist() for c in ("block", "size", "u", "n"))))
    us, ns, waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for i, (_, size, u, n) in enumerate(rows):
        if n is not None:
            us.append(np.cumsum(unsqueeze(u, size, np.uint64), dtype=np.uint64))
            ns.append(unsqueeze(n, size, np.uint32).astype(np.int64))
            waiting += size
        if waiting > MERGE_ROWS or i == len(rows) - 1:
            u, n = _sum_counts(us, ns)
            us, ns, waiting = [u], [n], 0
    feat, leaf, top = most_frequent(us[0], ns[0])
    top = np.minimum(top, 65535).astype(np.uint16)
    own: dict[int, list[np.ndarray]] = {}
    for block, size, u, _ in rows:
        x = np.cumsum(unsqueeze(u, size, np.uint64), dtype=np.uint64) & ~_LEAF
        own.setdefault(block, []).append(x[_first(x)])
    out = []
    for block, parts in own.items():
        x = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        if len(feat):
            at = np.minimum(np.searchsorted(feat, x), len(feat) - 1)
            known = feat[at] == x
            got, k = np.where(known, leaf[at], np.uint16(0)), np.where(known, top[at], np.uint16(0))
        else:
            got = k = np.zeros(len(x), np.uint16)
        out.append((block, len(x), squeeze(got), squeeze(k)))
    return pa.table(
        {
            "range": pa.array([t.column("range")[0].as_py()] * len(out), pa.int32()),
            "block": pa.array([r[0] for r in out], pa.int64()),
            "size": pa.array([r[1] for r in out], pa.int32()),
            "leaf": pa.array([r[2] for r in out], pa.binary()),
            "n": pa.array([r[3] for r in out], pa.binary()),
        }
    )


def in_order(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes, equal ones by place, and the hashes in it: numpy sorts numbers many times as fast as places, so the last bits give way to the place."""
    bits = np.uint64(max(1, (len(e) - 1).bit_length()))
    x = e >> bits
    x <<= bits
    x |= np.arange(len(e), dtype=np.uint64)
    x.sort()
    order = (x & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    ordered = e[order]
    back = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(back):  # few hashes differ in their last bits only
        x >>= bits
        for same in np.unique(x[1:][back]):
            run = slice(np.searchsorted(x, same), np.searchsorted(x, same, "right"))
            order[run] = order[run][np.argsort(ordered[run], kind="stable")]
            ordered[run] = e[order[run]]
    return order, ordered


def recall(docs: pa.Table, answers: pa.Table, levels: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a block's rows: the rows, their tokens, each text's number of tokens, and what each token's features recall: three followers, then their counts."""
    order = np.argsort(answers.column("range").to_numpy())
    sizes = answers.column("size").to_pylist()
    answer = np.empty((sum(sizes), 2), np.uint16)
    for k, c in enumerate(("leaf", "n")):
        x = answers.column(c).to_pylist()
        answer[:, k] = np.concatenate([unsqueeze(x[i], sizes[i], np.uint16) for i in order])
    answer = answer.view(np.uint32).ravel()  # both are placed at once
    runs = [(b.slice(i, j - i), *tokens(t)) for b in docs.to_batches() for i, j, t in _texts(b)]
    e = np.concatenate([_features(h, size, levels) for _, h, size in runs]) & ~_LEAF
    order, e = in_order(e)
    found = np.empty(len(e), np.uint32)
    found[order] = np.repeat(answer, np.diff(np.append(np.flatnonzero(_first(e)), len(e))))
    del e, order
    begin = 0
    for b, h, size in runs:
        own = found[begin : begin + FEATURES * len(h)]
        begin += FEATURES * len(h)
        yield b, h, size, np.concatenate(np.moveaxis(own.view(np.uint16).reshape(FEATURES, -1, 2), 2, 0))


def blocks_of(docs: DataFrame) -> DataFrame:
    """block, doc_id, held_out, text: the rows of docs in blocks of about BLOCK_BYTES, by their places in their files. Blocks of held-out rows have odd numbers."""
    own = addressed(docs).select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_file", F.floor(F.col("_at") / BLOCK_ROWS).alias("_at"))
    sizes = materialize(own.groupBy(*ADDRESS).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")), "lm-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = min(BLOCK_BYTES, total // docs.sparkSession.sparkContext.defaultParallelism + 1)
    number = F.floor(F.sum("n").over(Window.partitionBy("_file").orderBy("_at")) / size)
    block = F.xxhash64("_file", number).bitwiseAND(F.lit(-2))
    own = own.join(materialize(sizes.select(*ADDRESS, block.alias("block")), "lm-blocks"), ADDRESS).withColumn("held_out", held_out(10))
    return own.select(F.col("block").bitwiseOR(F.col("held_out").cast("long")).alias("block"), "doc_id", "held_out", "text")


def remember(blocks: DataFrame, levels: int, n_tokens: int) -> DataFrame:
    """block, range, size, leaf, n: of each block's features in a range, in their order, what the memory of the whole training texts gives."""
    ranges = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-n_tokens // RANGE_TOKENS))
    sent = blocks.select("block", "text").mapInArrow(lambda b: _count_blocks(b, levels, ranges), "range int, block long, size int, u binary, n binary")
    answers = sent.groupBy("range").applyInArrow(_range_answers, "range int, block long, size int, leaf binary, n binary")
    with shuffles_dropped(blocks.sparkSession):
        return materialize(answers, "lm-answers")


def train_weights(train: DataFrame, levels: int, fixed, rounds: int = ROUNDS, answers: DataFrame | None = None) -> Weights:
    """Weights from every training text, each in one round. fixed: a broadcast of a model's grid, masses, tables and memory.

    With answers, train is blocks of texts, and these are what the whole memory gives for them.
    """
    part = F.pmod(F.xxhash64(F.lit(9), "text" if answers is None else "block"), F.lit(rounds))
    weights = Weights(levels)
    for k in range(rounds):

        def sums(total: np.ndarray) -> pa.RecordBatch:
            from pyspark import TaskContext

            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["group", "sums"])

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            own, total = None, 0.0
            for b in batches:
                for _, _, texts in _texts(b):
                    own = own or MaxEnt(*fixed.value, weights)
                    total = total + own.gradient(*tokens(texts))
            if own is not None:
                yield sums(total)

        def run_block(docs: pa.Table, found: pa.Table) -> pa.Table:
            own = MaxEnt(*fixed.value, weights)
            return pa.Table.from_batches([sums(sum(own.gradient(h, size, recalled) for _, h, size, recalled in recall(docs, found, levels)))])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"sums": pa.array([sum(np.frombuffer(x.as_py()) for x in t.column("sums")).tobytes()], pa.binary())})

        if answers is None:
            made = train.where(part == k).select("text").mapInArrow(run, "group int, sums binary")
        else:
            made = train.where(part == k).select("block", "text").groupBy("block").cogroup(answers.where((part == k) & (F.col("block") % 2 == 0)).groupBy("block")).applyInArrow(run_block, "group int, sums binary")
        # one row of a few kilobytes for each task or block, added up in groups of tasks before the driver does
        with shuffles_dropped(train.sparkSession):
            summed = made.groupBy("group").applyInArrow(add, "sums binary").collect()
        if summed:
            weights.update(sum(np.frombuffer(r["sums"]) for r in summed).reshape(2, 2, levels, FEATURES, BANDS))
    return weights


def leaf_masses(counts: DataFrame, levels: int) -> np.ndarray:
    """The smoothed count of each leaf: its tokens', and one unknown token's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaves(b.column("h").to_numpy().view(np.uint64), levels)
            n = BRANCHES**levels
            c, k = np.bincount(leaf, b.column("c").to_numpy(), n), np.bincount(leaf, minlength=n)
            at = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at].astype(np.int64)), pa.array(k[at].astype(np.int64))], ["leaf", "c", "k"])

    t = counts.select("h", "c").mapInArrow(run, "leaf long, c long, k long").groupBy("leaf").agg(F.sum("c").alias("c"), F.sum("k").alias("k")).toArrow()  # BRANCHES^LEVELS rows at most
    out = np.full(BRANCHES**levels, SMOOTH)
    out[t.column("leaf").to_numpy()] += t.column("c").to_numpy() + SMOOTH * t.column("k").to_numpy()
    return out


def score_texts(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    sc = for_texts(docs.sparkSession).sparkContext
    train = docs.where(~held_out(10)).select("text")
    with shuffles_dropped(docs.sparkSession):
        counts = materialize(count_tokens(train), "lm-counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    grid = Grid(levels_for(v_all), row_bits_for(v_all))
    fixed = sc.broadcast((grid, leaf_masses(counts, grid.levels), *count_features(train, grid, n_tokens=n_all)))  # of fixed size
    blocks = blocks_of(docs)
    answers = remember(blocks, grid.levels, n_all)
    weights = train_weights(blocks.where(~F.col("held_out")), grid.levels, fixed, rounds, answers)
    log_all = math.log10(n_all + SMOOTH * (v_all + 1))
    shared = sc.broadcast(head_of(counts, head))  # at most `head` tokens

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        head_h, head_c = shared.value
        model = MaxEnt(*fixed.value, weights)
        log_c, log_mass = np.log10(head_c + SMOOTH), np.log10(model.mass)
        out = []
        for b, hs, size, recalled in recall(texts, found, model.grid.levels):
            n = b.num_rows
            doc = np.repeat(np.arange(n), size)
            if len(head_h):
                order, ordered = in_order(hs)
                at = np.flatnonzero(_first(ordered))  # in order, so the search is one way through the head
                k = np.empty(len(hs), np.int64)
                k[order] = np.repeat(np.minimum(np.searchsorted(head_h, ordered[at]), len(head_h) - 1), np.diff(np.append(at, len(hs))))
                inside = head_h[k] == hs
            else:
                k, inside = np.zeros(len(hs), np.int64), np.zeros(len(hs), bool)
            own = np.where(inside, log_c[k] if len(head_h) else 0.0, 0.0)
            base = np.bincount(doc, own, n)
            score = np.bincount(doc, model.log10(hs, size, recalled) + own - log_mass[leaves(hs, model.grid.levels)], n)
            tail_doc, tail_h = doc[~inside], hs[~inside].view(np.int64)
            cut = np.concatenate([[0], np.cumsum(np.bincount(tail_doc, minlength=n))]).astype(np.int32)
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        b.column("held_out"),
                        pa.array(size.astype(np.int64)),
                        pa.array(np.bincount(doc[inside], minlength=n).astype(np.int64)),
                        pa.array(base - size * log_all),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(tail_h)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_head", "base", "part", "tail"],
                )
            )
        return pa.Table.from_batches(out)

    schema = f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_head long, base double, part double, tail array<long>"
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
    with shuffles_dropped(docs.sparkSession):
        rows = materialize(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "lm-rows")
    discard(answers)
    # tokens outside the head: their counts by hash, then one sum for each row
    tail = rows.select("row", F.explode("tail").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("k"))
    known = tail.join(counts, "h", "left")
    logs = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    sums = known.groupBy("row").agg(F.sum(F.col("k") * logs).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("n_tail"))
    out = rows.drop("tail").join(sums, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("part") + more).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
