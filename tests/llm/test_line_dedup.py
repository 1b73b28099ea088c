import hashlib
import random
from collections import defaultdict

import numpy as np

from evidentia.llm import line_dedup as L

SCHEMA = "doc_id long, text string, a string, h1 string, pos int"


def fixture():
    r = random.Random(1)
    common = ["Shared LINE", " shared line\t", "\x0bPAGE 1\x0c", "éÉ", "x" * 500]
    rows = []
    for k in range(60):
        lines = [r.choice(common) if r.random() < 0.5 else f"own {r.randrange(200)}" for _ in range(r.randrange(0, 12))]
        rows.append((k, "\n".join(lines) if k % 7 else "\r\n".join(lines)))
    return [*rows, (None, "Shared line"), (None, None), (3, ""), (3, ""), (70, "\n\n"), (71, "shared line\n" * 4000), (72, "shared line"), (72, "shared line")]


def brute(rows, most):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for n, (_, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            docs[low(x)].add(n)
    gone = {k for k, v in docs.items() if k and len(v) >= most}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_both_ways_match_brute_force(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in rows], SCHEMA)
    want = brute(rows, 10)
    assert sorted((tuple(r) for r in L.dedup_lines(df).collect()), key=repr) == want
    monkeypatch.setattr(L, "PROBES_PER_TASK", 50)  # hot shards in many salts
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    assert sorted((tuple(r) for r in L.dedup_lines(df, broadcast_bytes=0).collect()), key=repr) == want
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64))
    shard = L.Shard(keys, keys ^ np.uint64(7), np.arange(len(keys)) % 300)
    assert sorted(shard.mph.slots(keys)) == list(range(len(keys)))
    import pickle

    shard = pickle.loads(pickle.dumps(shard))
    assert (shard.docs(keys, keys ^ np.uint64(7)) == np.minimum(np.arange(len(keys)) % 300, 255)).all()
    other = keys + np.uint64(1)
    assert shard.docs(other, other).sum() == 0
    assert L.Shard(keys[:0], keys[:0], keys[:0]).docs(keys, keys).sum() == 0


def test_query_digest(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame([(i, t, "x", "x", 1) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in L.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 10)), key=repr)
