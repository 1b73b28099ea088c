import random

import public_tokenizers
from tokenizers import Tokenizer

from evidentia.llm import token_counts as C

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_parts_add_up_to_the_whole():
    tok = Tokenizer.from_file(PATH)
    r = random.Random(1)
    pieces = ["a", "b ", " ", "\n", "\t", "\xa0", "é", "1", "'s", "<|endoftext|>", "　", "!", "​", "日本", "\r\n", "\x1c", "\x85", " ", "  ", "'", "word ", "Ünï "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 40))) for _ in range(8000)] + ["x" * 30000, "ab cd " * 20000]
    assert C.counter(PATH)(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_query_and_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "CACHE_PARTS", 50)
    rows = [(k, f"some words {k} and more é " * (k % 7)) for k in range(100)] + [(None, "x y"), (1, None), (2, ""), (2, ""), (3, "long text " * 3000)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted((tuple(r) for r in C.query(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    assert C.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_parts_are_not_kept():
    count = C.counter(PATH)
    texts = ["y" * 5000 + " short " + "z" * 4000, "short " + "z" * 4000]
    once = count(texts)
    assert count(texts) == once
    assert all(len(p) <= C.CACHED_LENGTH for cache in C._state[PATH][1:] for p in cache)
