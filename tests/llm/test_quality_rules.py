from collections import Counter

from evidentia.llm import quality_rules as Q


def brute(text):
    t = text or ""
    space = " \t\n\x0b\x0c\r"
    words, cur = [], ""
    for c in t + " ":
        if c in space:
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    lines = [x for x in t.split("\n") if any(c not in space for c in x)]
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    bare = [x.strip(space) for x in lines]
    more = sum(c in "0123456789" for c in t), sum("A" <= c <= "Z" for c in t), sum(x[0] in "-*\u2022" for x in bare), sum(x.endswith(("...", "\u2026")) for x in bare)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit), *more


TEXTS = ["", None, " \t\n", "a", "a b c", "a b c a b c", "the cat sat. " * 30, "x " * 100000, "#*$ é日\x0bß\x85z|<> &", "one\none\n\none \nTwo", "a\xa0b c", "w " * 60 + "z", "- one\n * two...\n\u2022 three \u2026\n1 2 3 A\n", "*\n-\n...\n", " ".join(f"word{i}" for i in range(200))]


def test_measurements(monkeypatch):
    for most in (Q.MOST_PACKED, 2):  # many distinct words, in the other form
        monkeypatch.setattr(Q, "MOST_PACKED", most)
        for t in TEXTS:
            assert Q.measure(t) == brute(t), t


def test_ledger_policies_and_ablations(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, "a b", 1), (0, "", 1)], "doc_id long, text string, fail_bits int")
    ledger = Q.evaluate_rules(df)
    rows = ledger.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = 0
        for k, rule in enumerate(Q.RULES.values()):
            want |= int(eval(rule.replace("AND", "and"), {f: r[f] for f in Q.FIELDS})) << k  # the rules read the same in Python
        assert r.fail_bits == want
    kept = {r.doc_id for r in ledger.where(Q.passes()).collect()}
    assert kept == {len(TEXTS) - 1}
    assert Q.mask(Q.POLICIES["v1"]) == 3
    for version in Q.POLICIES:
        m = Q.mask(Q.POLICIES[version])
        got = {r.rule: (r.n_failed, r.n_only) for r in Q.ablations(ledger, version).collect()}
        for name in Q.POLICIES[version]:
            bit = Q.mask([name])
            assert got[name] == (sum(bool(r.fail_bits & m & bit) for r in rows), sum(r.fail_bits & m == bit for r in rows))
    assert Q.evaluate_rules(df.limit(0)).count() == 0
