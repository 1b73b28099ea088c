import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from evidentia.llm import lm_scoring

SF = "/root/testdata/sf0.01"


def brute(rows):
    toks = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w] + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = toks(t)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = sorted(([*r][:7] for r in lm_scoring.score_texts(df, **kw).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    got.sort(key=lambda r: (repr(r[0]), r[5]))
    want.sort(key=lambda r: (repr(r[0]), r[5]))
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    return got


def test_base_matches_brute_force_with_a_small_head(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["The", "of", "and", f"w{r.randrange(400)}", "日本", "x" * 70]) for _ in range(r.randrange(0, 60)))) for k in range(150)]
    rows += [(None, "the of"), (500, None), (501, ""), (501, ""), (502, "\t\x0b of\nof "), (503, "a b " * 30000)]
    check(spark, rows, head=20, rounds=2)
    check(spark, [(k, t) for k, t in rows if k is None], rounds=1)  # nothing to train on


def small_model(seed=3, n_texts=60):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["a", "b", "the", "of", f"w{r.randrange(60)}"]) for _ in range(r.randrange(0, 30))).encode() for _ in range(n_texts)]
    h, size = lm_scoring.tokens(texts)
    u, c = np.unique(h, return_counts=True)
    levels = 2
    grid = lm_scoring.Grid(levels, 10)
    mass = np.full(lm_scoring.BRANCHES**levels, 0.1)
    np.add.at(mass, lm_scoring.leaves(u, levels), c + 0.1)
    memory = lm_scoring.Memory(11)
    memory.add(h, size, levels)
    return lm_scoring.MaxEnt(grid, mass, grid.counts(h, size), memory), h, size


def test_probabilities_of_all_classes_add_up():
    m, h, size = small_model()
    m.weights.update(m.gradient(h, size))
    width = lm_scoring.BRANCHES
    for text in ([b"the of a b"], [b"w1 unseen1 unseen2 w3 the"]):
        hs, n = lm_scoring.tokens(text)
        for part, level, _, z, _, _ in m._parts(hs, n, 0):
            assert z.shape == (len(hs), width) and np.allclose(np.exp(z - lm_scoring.log_sum(z)[:, None]).sum(axis=1), 1)


def brute_score(m, words):
    """log10 P(leaf | context) by plain loops over the definition."""
    code = lambda w: lm_scoring.END if w is None else int(lm_scoring.tokens([w])[0][0])
    path = lambda h: int(lm_scoring.leaves(np.array([h], np.uint64), m.grid.levels)[0])
    out = []
    seq = [7, 7, *map(code, words), code(None)]
    for i in range(2, len(seq)):
        feats = [int(x[-1]) for x in lm_scoring.context(np.array(seq[2 : i + 1], np.uint64), np.array([i - 1]))]
        leaf, total = path(seq[i]), 0.0
        for level in range(m.grid.levels):
            steps = [(leaf >> (4 * (m.grid.levels - 1 - x))) & 15 for x in range(m.grid.levels)]
            node = 0
            for x in steps[:level]:
                node = node * 16 + x
            z = [math.log(m.share[level][node][k]) for k in range(16)]
            for j, f in enumerate(lm_scoring.USED[level]):
                row = int(m.grid.rows([np.array([x], np.uint64) for x in feats], level, np.array([node]))[j][0])
                counts = m.tables[level][row]
                n = float(counts.sum())
                w = m.weights.tables[level][j][min(int(math.log2(n + 1)), lm_scoring.BANDS - 1)]
                for k in range(16):
                    z[k] += w * (math.log(counts[k] / m.share[level][node][k] + lm_scoring.KAPPA) - math.log(n + lm_scoring.KAPPA))
            for f in range(3):
                after, n = (int(x[0]) for x in m.memory.look(f, np.array([feats[f]], np.uint64)))
                if n and after >> (4 * (m.grid.levels - level)) == node:
                    z[(after >> (4 * (m.grid.levels - 1 - level))) & 15] += m.weights.recall[level, f, min(int(math.log2(n + 1)), lm_scoring.BANDS - 1)]
            total += z[steps[level]] - math.log(sum(map(math.exp, z)))
        out.append(total / math.log(10))
    return out


def test_scores_match_plain_loops():
    m, h, size = small_model()
    m.weights.update(m.gradient(h, size))
    for words in ([b"the", b"of", b"a", b"w5", b"never", b"the", b"of"], [], [b"b"]):
        hs, n = lm_scoring.tokens([b" ".join(words)])
        assert np.allclose(m.log10(hs, n), brute_score(m, words), atol=1e-4)


def test_gradient_is_that_of_the_probability():
    """Against differences, with no count left out; then one step raises the probability of the training texts."""
    m, h, size = small_model()
    old = m._parts
    m._parts = lambda h, size, own: old(h, size, 0)
    g = m.gradient(h, size)[0]
    at = lambda: m.log10(h, size).sum() * math.log(10)
    for w, want in ((m.weights.tables[0][0], g[0, 0, 0]), (m.weights.tables[1][0], g[0, 1, 0]), (m.weights.recall[0, 0], g[1, 0, 0]), (m.weights.recall[1, 2], g[1, 1, 2])):
        for band in (1, 2, 5):
            w[band] += 1e-2
            up = at()
            w[band] -= 2e-2
            down = at()
            w[band] += 1e-2
            assert abs((up - down) / 2e-2 - want[band]) < 0.02 * abs(want[band]) + 0.2
    before = at()
    m.weights.update(m.gradient(h, size))
    assert at() > before


def test_memory_keeps_the_more_frequent_follower():
    keys, n = np.zeros(4, np.uint32), np.zeros(4, np.uint16)
    for at, key, more in (([1, 2], [9, 8], [2, 1]), ([1, 2], [7, 8], [1, 5]), ([1], [7], [3])):
        keys, n = lm_scoring.keep_larger(keys, n, np.array(at), np.array(key, np.uint32), np.array(more))
    assert keys.tolist() == [0, 7, 8, 0] and n.tolist() == [0, 3, 6, 0]


def test_tables_are_the_same_by_one_task_or_many(spark, monkeypatch):
    """Pieces that are added in groups give the sums of plain counting."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(1, 20))) for _ in range(80)]
    grid = lm_scoring.Grid(2, 10)
    want = grid.counts(*lm_scoring.tokens([t.encode() for t in texts]))
    monkeypatch.setattr(lm_scoring, "AT_A_TIME", 2)
    tables, memory = lm_scoring.count_features(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), grid, 11)
    assert all((a == b).all() for a, b in zip(tables, want))
    assert memory.n.sum() > 0


def test_packed_counts():
    x = np.array([0, 1, 254, 255, 256, 10**9])
    assert (lm_scoring._unpack(*lm_scoring._pack(x)) == x).all()


def bigram(rows):
    """log10 a token of held-out texts by bigrams and counts, half and half."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    toks = [(i, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").split()] + [None]) for i, t in rows]
    c = Counter(w for i, t in toks if not held(i) for w in t)
    pair = Counter(p for i, t in toks if not held(i) for p in zip([0, *t], t))
    first = Counter(w for i, t in toks if not held(i) for w in [0, *t[:-1]])
    n, v = sum(c.values()), len(c)
    out = [math.log10(0.5 * (pair[a, b] / first[a] if first[a] else 0) + (0.5 if first[a] else 1) * (c[b] + 0.1) / (n + 0.1 * (v + 1))) for i, t in toks if held(i) for a, b in zip([0, *t], t)]
    return sum(out) / len(out)


def test_the_model_beats_counts_and_bigrams_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm_scoring.score_texts(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert rows.s / rows.n > rows.b / rows.n + 1
    assert rows.s / rows.n > bigram([(r.doc_id, r.text) for r in docs.collect()]) + 0.1
    assert lm_scoring.score_texts(docs.limit(0)).count() == 0


def test_weights_come_from_every_training_text(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "the", "of", f"w{r.randrange(60)}"]) for _ in range(r.randrange(1, 30))) for _ in range(60)]
    m, _, _ = small_model()
    want = lm_scoring.Weights(m.grid.levels)
    want.update(sum(m.gradient(*lm_scoring.tokens([t.encode()])) for t in texts))
    fixed = spark.sparkContext.broadcast((m.grid, m.mass, m.tables, m.memory))
    got = lm_scoring.train_weights(spark.createDataFrame([(t,) for t in texts], "text string"), m.grid.levels, fixed, rounds=1)
    assert all(np.allclose(a, b) for a, b in zip(got.tables, want.tables)) and np.allclose(got.recall, want.recall)


def recalled_by_plain_loops(rows, levels):
    """For each text, what the features of each token recall: the followers of the three features, then their counts."""
    followers = {}
    for i, t in rows:
        h, size = lm_scoring.tokens([(t or "").encode()])
        if zlib.crc32(str(i).encode()) % 10:
            for feat in lm_scoring.context(h, size):
                for x, leaf in zip(feat.tolist(), lm_scoring.leaves(h, levels).tolist()):
                    followers.setdefault(x >> 16, Counter())[leaf] += 1
    out = {}
    for i, t in rows:
        h, size = lm_scoring.tokens([(t or "").encode()])
        best = [[max(((n, leaf) for leaf, n in followers.get(x >> 16, {0: 0}).items())) for x in feat.tolist()] for feat in lm_scoring.context(h, size)]
        out[i] = [[leaf for _, leaf in f] for f in best] + [[n for n, _ in f] for f in best]
    return out


def test_every_context_of_the_training_texts_is_remembered(spark, monkeypatch):
    """Far-apart texts, several blocks and ranges, sums taken a few rows at a time."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm_scoring, "RANGE_TOKENS", 500)
    monkeypatch.setattr(lm_scoring, "MERGE_ROWS", 100)
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(["the", "of", f"w{r.randrange(40)}", f"v{r.randrange(10**6)}"]) for _ in range(r.randrange(0, 60)))) for k in range(200)]
    rows += [(k + 200, t) for k, t in rows[:30]] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm_scoring, "BLOCK_ROWS", 3)
    blocks = lm_scoring.blocks_of(docs)
    answers = lm_scoring.remember(blocks, 4, 6000)
    texts, answers, want = blocks.toArrow(), answers.toArrow(), recalled_by_plain_loops(rows, 4)
    ids, got = set(texts.column("block").to_pylist()), {}
    of = lambda t, x: t.filter(pa.array([b == x for b in t.column("block").to_pylist()]))
    for x in ids:
        for b, h, size, recalled in lm_scoring.recall(of(texts, x), of(answers, x), 4):
            cut = np.append(0, np.cumsum(size))
            got |= {i: recalled[:, cut[k] : cut[k + 1]].tolist() for k, i in enumerate(b.column("doc_id").to_pylist())}
    assert got == want and len(ids) > 5 and set(answers.column("block").to_pylist()) == ids


def test_blocks_in_parts_send_what_whole_ones_do():
    """Rows of two blocks that come in turns: the sums and the answers are those of rows in order."""
    texts = [" ".join(f"w{(k * 7 + i * i) % 23}" for i in range(20)) for k in range(40)]
    made = []
    for order in (range(40), [*range(0, 40, 2), *range(1, 40, 2)]):
        rows = [(2 * (k // 20), texts[k]) for k in order]
        batches = [pa.record_batch({"block": pa.array([b for b, _ in rows[i : i + 5]]), "text": [t for _, t in rows[i : i + 5]]}) for i in range(0, 40, 5)]
        sent = pa.Table.from_batches(lm_scoring._count_blocks(iter(batches), 4, 2))
        made.append(sorted(repr(r) for x in (0, 1) for r in lm_scoring._range_answers(sent.filter(pa.array([y == x for y in sent.column("range").to_pylist()]))).to_pylist()))
    assert made[0] == made[1]


def test_a_follower_is_remembered_however_many_contexts_there_are():
    """More contexts than 2^21 slots hold: all of them are told apart, in training texts that occur once."""
    n = 3_000_000
    h = lm_scoring.mix64(np.arange(n, dtype=np.uint64))
    leaf = lm_scoring.leaves(h, 4)
    feat = lm_scoring.context(h, np.array([n]))[2]
    e = np.sort((feat & ~lm_scoring._LEAF) | leaf.astype(np.uint64))
    key, after, count = lm_scoring.most_frequent(e, np.ones(n, np.int64))
    at = np.searchsorted(key, feat & ~lm_scoring._LEAF)
    assert (key[at] == feat & ~lm_scoring._LEAF).all() and (after[at] == leaf).mean() > 0.999 and len(count) > 0.999 * n


def test_no_feature_of_a_block_or_range_is_sorted_by_places(monkeypatch):
    """Sorting places takes many times as long as sorting numbers; all but a few hashes are sorted as numbers."""
    plain, longest = np.argsort, [0]

    def argsort(x, *a, **kw):
        longest[0] = max(longest[0], len(x))
        return plain(x, *a, **kw)

    monkeypatch.setattr(np, "argsort", argsort)
    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(50)) for _ in range(100)]
    docs = pa.table({"block": pa.array([0] * 100, pa.int64()), "text": texts})
    sent = pa.Table.from_batches(lm_scoring._count_blocks(iter(docs.to_batches()), 4, 2))
    answers = pa.concat_tables(lm_scoring._range_answers(sent.filter(pa.array([y == x for y in sent.column("range").to_pylist()]))) for x in (0, 1))
    got = np.concatenate([x for *_, x in lm_scoring.recall(docs, answers, 4)], axis=1)
    want = recalled_by_plain_loops([(k, t) for k, t in zip([i for i in range(1000) if zlib.crc32(str(i).encode()) % 10], texts)], 4)
    assert got.tolist() == [sum(x, []) for x in zip(*want.values())]
    assert longest[0] < 100


def test_order_of_hashes_that_differ_in_their_last_bits_only():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        for mask in (2**64 - 1, 0xFF, 0xFF00000000FF, 0xFF << 56):
            e = r.integers(0, 2**64, n, np.uint64) & np.uint64(mask)
            order, ordered = lm_scoring.in_order(e)
            assert (order == np.argsort(e, kind="stable")).all() and (ordered == np.sort(e)).all()


def test_scores_are_the_same_without_the_strengths():
    m, h, size = small_model()
    m.weights.update(m.gradient(h, size))
    r = np.random.default_rng(3)
    recalled = np.concatenate([r.integers(0, 256, (3, len(h))), r.integers(0, 4, (3, len(h)))]).astype(np.uint16)
    made = [np.concatenate([z for *_, z, _, _ in m._parts(h, size, 0, recalled, x)]) for x in (True, False)]
    assert np.allclose(*made, atol=1e-5)


def test_sums_of_small_and_large_counts():
    r = random.Random(8)
    parts = [sorted(r.sample(range(200), 60)) for _ in range(6)]
    counts = [[r.choice([1, 1, 2, 7, 8, 9, 10**6]) for _ in p] for p in parts]
    want = Counter()
    for p, c in zip(parts, counts):
        want.update(dict(zip(p, c)))
    u, n = lm_scoring._sum_counts([np.array(p, np.uint64) for p in parts], [np.array(c) for c in counts])
    assert list(zip(u.tolist(), n.tolist())) == sorted(want.items())
    assert all(len(x) == 0 for x in lm_scoring._sum_counts([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]))


def test_numbers_come_back_from_planes():
    for kind in (np.uint16, np.uint32, np.uint64):
        for x in ([], [0, 0], [1, 255, 256], [np.iinfo(kind).max, 0, 65535]):
            x = np.array(x, kind)
            got = lm_scoring.unsqueeze(lm_scoring.squeeze(x), len(x), kind)
            assert got.dtype == x.dtype and (got == x).all()


def test_logits_out_of_range_of_floats():
    z = np.array([[0.5, 1, -2], [300, 299, 0], [-400, -401, -500], [80, 80, 80]], np.float32)
    e, total, _ = lm_scoring.exps(z)
    want = np.exp(z.astype(float) - z.max(axis=1)[:, None])
    assert np.allclose(e / total[:, None], want / want.sum(axis=1)[:, None], atol=1e-6)
    assert np.allclose(lm_scoring.log_sum(z), np.log(want.sum(axis=1)) + z.max(axis=1), rtol=1e-6)
