"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries: a single space between two characters that are not white space. The byte-level
pre-tokenizer always begins a new piece there, so the counts of the parts add up to the count of the whole text. Parts
that this worker has not met lately are encoded in batches balanced by bytes; only lengths are kept, and of long parts nothing.

Cases: a null or empty text has 0 bytes and 0 tokens; a text without a safe boundary is encoded whole; ids and repeated
rows pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evidentia.llm.common import chunks_by_bytes, for_texts, slices

#: White space other than space and newline, with characters that some Unicode versions count as white space.
ODD = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_odd = re.compile(f"[{ODD}]|  |\n | \n|^ | $")
_safe = re.compile(f"(?<=[^ \n{ODD}]) (?=[^ \n{ODD}])")
BATCH_BYTES = 1 << 18
#: A worker keeps the lengths of at most so many parts; longer parts (in bytes of UTF-8 at most four times as long) are not kept.
CACHE_PARTS, CACHED_LENGTH = 500_000, 64

_state: dict[str, tuple[object, dict, dict]] = {}


def parts_of(text: str) -> list[str]:
    """The parts between safe boundaries; the boundary's space belongs to the part after it, and is left out here."""
    return _safe.split(text) if _odd.search(text) else text.split(" ")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_lengths(tok, parts: list[str]) -> list[int]:
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    out: list[int] = []
    for i, j in chunks_by_bytes([len(p.encode()) for p in parts], BATCH_BYTES):
        out += [len(e) for e in encode(parts[i:j], add_special_tokens=False)]
    return out


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts for a batch of texts; the parts' lengths are kept from batch to batch up to a bound."""
    if path not in _state:
        _state[path] = (_tokenizer(path), {}, {})
    tok, first, later = _state[path]

    def learn(cache: dict, parts: set[str], lead: str) -> list[str]:
        """Puts the parts' lengths into the cache; returns those that are to go after the batch."""
        new = [p for p in parts if p not in cache]
        if len(cache) + len(new) > CACHE_PARTS:
            cache.clear()
            new = list(parts)
        cache.update(zip(new, encode_lengths(tok, [lead + p for p in new])))
        return [p for p in new if len(p) > CACHED_LENGTH]

    def count(texts: list[str]) -> list[int]:
        split = [parts_of(t) for t in texts]
        long = [(c, learn(c, parts, lead)) for c, parts, lead in ((first, {s[0] for s in split}, ""), (later, set().union(*(s[1:] for s in split)), " "))]
        look = later.__getitem__
        out = [first[s[0]] + sum(map(look, s[1:])) for s in split]
        for cache, parts in long:
            for p in parts:
                del cache[p]
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each whole text."""
    for_texts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        count = counter(tokenizer_path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0)
            n: list[int] = []
            for _, _, texts in slices(b.column("text")):
                n += count([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes.cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit")
