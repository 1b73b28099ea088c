"""Each stage of the pipeline against a brute-force version over its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from evidentia.llm import language_id, mixing
from tests.llm.test_decontamination import brute as windows
from tests.llm.test_simhash import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    rows = docs.collect()
    extra = [(-1, None, "en", "src0", 0), (-2, "12 34 !", "en", "src1", 7), (rows[0].doc_id, rows[0].text, rows[0].lang, rows[0].source, rows[0].n_chars), (None, rows[1].text, "en", None, 5)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).cache()
    columns = docs.columns
    frames = [docs]
    for name, stage in P.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
        if name != P.STAGES[-1][0]:
            assert frames[-1].columns == columns
    ins = [f.collect() for f in frames]

    langs = language_id.fit(docs)
    keep = [r for r, x, s in zip(ins[0], *langs.predict([r.text for r in ins[0]])) if x != "und" and s >= language_id.MIN_SCORE]
    assert sorted(map(repr, ins[1])) == sorted(map(repr, keep))
    assert len(keep) == len(ins[0]) - 2  # clean documents stay

    want = Counter(c for c in {c for _, _, c in groups([(r.doc_id, r.text) for r in ins[1]])})
    assert Counter(r.doc_id for r in ins[2]) == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, n, _ in windows([(r.doc_id, r.text) for r in ins[2]], items) if not n}
    assert sorted(r.doc_id for r in ins[3]) == sorted(clean)

    size, got = defaultdict(int), defaultdict(int)
    for r in ins[3]:
        size[r.source] += len(r.text.split())
    times = Counter(repr(r) for r in ins[4])
    assert max(times.values()) <= 2 and set(times) <= {repr(r) for r in ins[3]}
    for r in ins[4]:
        got[r.source] += len(r.text.split())
    names = sorted(size, key=lambda x: (x is None, x or ""))
    for s, t in zip(names, mixing.targets([size[x] for x in names], [(3, 1, 2)[k % 3] for k in range(len(names))])):
        assert abs(got[s] - t) <= max(60, 0.02 * t, 0.5 * max(len(r.text.split()) for r in ins[3] if r.source == s))

    assert ins[5] and frames[5].columns == [*columns, "shard", "slot"]
    assert sorted(repr(tuple(r)[:5]) for r in ins[5]) == sorted(repr(tuple(r)) for r in ins[4])
    home, slots = defaultdict(set), defaultdict(list)
    for r in ins[5]:
        home[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in home.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_extra_columns_with_clashing_names(spark):
    """Columns named as those that the operators use inside pass through every stage."""
    from pyspark.sql import functions as F

    odd = ["_file", "_at", "fp", "h1", "root", "shard", "copies", "_metadata", "_row", "n_hit"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in odd])
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == odd and docs.where(" AND ".join(f"`{c}` = concat('{c} ', doc_id)" for c in odd)).count() == docs.count() > 0, name
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"] and last.count() == docs.count()


def test_run_and_empty(spark, tmp_path):
    assert P.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
