import random

from evidentia.llm import decontamination as D


def words(t):
    out, cur = [], ""
    for c in (t or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[p : p + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids |= wins[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def fixture():
    r = random.Random(6)
    vocab = ["The", "a", "of", "né", "日本", "x1", "Word", "y" * 90, "w7", "zeta"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 8, 10, 11, 14, 40]) if k % 5 == 0 else r.choice([10, 12, 30]))) for k in range(40)]
    items = [x for x in items if len(words(x[1])) not in (1, 2, 3)] + [(100, None), (7, "same id other text one two three four five six"), (None, "a null id has a window of its own here ok"), (9, "... !!"), (101, "a a a a a a a a a a a a")]
    docs = []
    for k in range(150):
        t = text(r.randrange(0, 40))
        if k % 3 == 0:
            t += " " + (r.choice(items)[1] or "")[r.choice([0, 0, 9]) :] + " " + text(5)
        docs.append((k, t))
    return [*docs, (None, "The a of"), (5, None), (5, ""), (5, ""), (800, "a " * 20000), (801, "né " * 9)], items


def test_matches_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert sum(bool(x[2]) for x in want) > 20
    assert sorted((tuple(r) for r in D.find_contamination(d, b).collect()), key=repr) == want
    share = D.share_benchmark
    monkeypatch.setattr(D, "share_benchmark", lambda x, w, k: share(x, w, k, 200))
    assert sorted((tuple(r) for r in D.find_contamination(d, b).collect()), key=repr) == want
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(x[0]) for x in want if not x[2])
    assert D.find_contamination(d.limit(0), b).count() == 0
    assert all(r.n_hit == 0 for r in D.find_contamination(d, b.limit(0)).collect())


def test_a_benchmark_that_is_joined(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in D.find_contamination(d, b, broadcast_bytes=10).collect()), key=repr) == want
    kept = D.drop_contaminated(d, b, broadcast_bytes=10)
    assert kept.columns == d.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(x[0]) for x in want if not x[2])
    assert D.find_contamination(d.limit(0), b, broadcast_bytes=10).count() == 0
