"""Rows by address, joins with hot keys, and batches for texts."""

from collections import Counter

from pyspark.sql import functions as F

from evidentia.llm import common


def test_hot_keys_are_dealt_and_nothing_is_lost_or_doubled(spark):
    rows = [(k % 7 if k % 3 else 0, k) for k in range(600)]
    big = spark.createDataFrame(rows, "key long, v long").repartition(5)
    small = spark.createDataFrame([(k, f"n{k}") for k in range(0, 9) if k != 4], "key long, name string")
    counts = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    want = Counter((k, v, f"n{k}") for k, v in rows if k != 4)
    for hot in (10**6, 100, 7, 1):
        assert Counter(tuple(r) for r in common.join_hot(big, small, "key", counts, hot).select("key", "v", "name").collect()) == want


def test_addresses_tell_equal_rows_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "same")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    path = f"{tmp_path}/t"
    df.repartition(4).write.parquet(path)
    read = spark.read.parquet(path)
    for rows in (read, df, read.where("doc_id = 1").union(df), read.withColumn("_metadata", F.lit("x")), spark.read.parquet(path, path)):
        n = rows.count()
        found = common.addressed(rows)
        places = [(r._file, r._at) for r in found.select("_file", "_at").collect()]
        assert len(set(places)) == n
        assert sorted(map(repr, found.select("_row.*").collect())) == sorted(map(repr, rows.collect()))
        half = found.select("_file", "_at").orderBy("_file", "_at").limit(n // 2)
        assert common.pick(found, half).count() == n // 2
    assert common._plain_scan(read) and not common._plain_scan(df) and not common._plain_scan(read.where("doc_id = 1"))


def test_the_owner_of_the_session_sets_the_batches(spark):
    own = spark.newSession()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own.conf.set(key, "77")
    common.for_texts(own)
    assert own.conf.get(key) == "77" and own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == common.BATCHES["spark.sql.parquet.columnarReaderBatchSize"]


def test_word_hashes_by_plain_loops():
    """Eight bytes after eight, from the word's length; over 64 bytes XXH64."""
    import random

    import numpy as np
    import xxhash

    from evidentia.functions import hashes

    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * int(hashes._M2)) & mask
        x = ((x ^ (x >> 27)) * int(hashes._M3)) & mask
        return x ^ (x >> 31)

    def plain(w):
        if len(w) > 64:
            return xxhash.xxh64_intdigest(w, 1)
        h = len(w) * int(hashes._M1) & mask
        for i in range(0, len(w), 8):
            h = mix(((h ^ int.from_bytes(w[i : i + 8], "little")) + int(hashes._M1)) & mask)
        return h

    r = random.Random(1)
    words = [bytes(r.choice(b"abz\xc3\xa9-09") for _ in range(n)) for n in [*range(1, 70), 200, *[r.randrange(1, 20) for _ in range(300)]]]
    r.shuffle(words)
    start, end, doc, buf = hashes.words_of([b" ".join(words[:100]), b"", b" ".join(words[100:])], bytes(range(256)))
    assert hashes.word_hashes(start, end, buf).tolist() == [plain(w) for w in words] and set(doc.tolist()) == {0, 2}
    assert len(hashes.word_hashes(np.zeros(0, np.int64), np.zeros(0, np.int64), b" ")) == 0
