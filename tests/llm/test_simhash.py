import random
from collections import defaultdict

import xxhash

from evidentia.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string"


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = t.encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(n):
        least[find(i)].append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((rows[i][0], f"{fps[i]:016x}", low[find(i)]) for i in range(n)), key=repr)


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeß日") for _ in range(r.randrange(1, 7)))
    rows = []
    for i in range(40):
        base = [word() for _ in range(r.choice([0, 1, 2, 3, 30, 300]))]
        for k in range(r.randrange(1, 5)):
            own = list(base)
            if own and k:
                own[r.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own).upper() if k == 2 else "\n".join(own)))
    return [*rows, (900, None), (None, ""), (None, "x y z w"), (901, " \t "), (901, " \t "), (902, "a b c " * 3000)]


def test_matches_brute_force(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", None, 1, "clash", "clash") for i, t in rows], SCHEMA)
    found = simhash.near_duplicates(df)
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found.collect()), key=repr)
    assert got == brute(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted({c for _, _, c in brute(rows)}, key=repr)


def test_hot_keys_are_split_without_losing_links(spark):
    """A dense cluster within few bits of one centre, in parts of ten."""
    r = random.Random(5)
    fps = sorted({0x123456789ABCDEF0 ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for _ in range(120)} | {r.getrandbits(64) for _ in range(80)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = {}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    labels = simhash.components(simhash.find_links(df, part=10)).collect()
    got = {}
    for x in labels:
        got.setdefault(x.root, set()).add(x.node & (2**64 - 1))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
