"""Documents to citable chunks: structure first, then paragraphs, sentences and windows.

Chunking is a walk over the units of a text, each step of which depends on the one before, so it runs as one linear function over
Arrow batches beside the scan: no shuffle, and no array is copied step by step. Texts are read in slices of bounded bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V
from evidentia.functions import text as T
from evidentia.functions.arrow import slices

_heading = re.compile(rf"^(?:{V.HEADING_LINE})$", re.M)
_blank = re.compile(r"\n\s*\n")
_end = re.compile(r"(?<=[.!?])\s+")
_many = re.compile(r"\n{3,}")


def normalize_newlines(text: str) -> str:
    """CRLF and CR as LF, lines without white space at their ends, none at the text's ends."""
    return "\n".join(x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip()


def compact(text: str) -> str:
    """Lines stripped, runs of blank lines as one, none at the ends."""
    return _many.sub("\n\n", "\n".join(x.strip() for x in text.splitlines())).strip()


def blocks(text: str) -> list[str]:
    """Paragraphs: split at blank lines."""
    return [p for p in map(str.strip, _blank.split(text)) if p]


def sentences(text: str) -> list[str]:
    """Split after an end mark, over the collapsed text."""
    return [s for s in _end.split(" ".join(text.split())) if s]


def sections(text: str) -> list[str]:
    """A section begins at each structural heading; text before the first gives paragraphs."""
    flat = normalize_newlines(text)
    at = [m.start() for m in _heading.finditer(flat)] + [len(flat)]
    return blocks(flat[: at[0]]) + [s for s in (flat[i:j].strip() for i, j in zip(at, at[1:])) if s]


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of size characters over the collapsed text, each overlapping the one before."""
    flat = " ".join(text.split())
    stride = size - overlap
    last = max(0, -(-(len(flat) - size) // stride))
    return [w for w in (flat[i * stride : i * stride + size].strip() for i in range(last + 1)) if w]


def last_units(units: list[str], most: int) -> list[str]:
    """The last units, up to most characters, but one at least."""
    total, at = 0, len(units)
    while at and (at == len(units) or total + len(units[at - 1]) <= most):
        at -= 1
        total += len(units[at])
    return units[at:]


def pack(units: list[str], size: int, overlap: int, deeper: Callable[[str], list[str]]) -> list[str]:
    """Units in order into chunks of at most size where they fit; larger units are split by themselves."""
    out: list[str] = []
    own: list[str] = []
    length = 0
    for u in units:
        if len(u) > size:
            if own:
                out.append("\n\n".join(own))
            out += deeper(u)
            own, length = [], 0
            continue
        gap = 2 if own else 0
        if own and length + gap + len(u) > size:
            out.append("\n\n".join(own))
            own = last_units(own, overlap)
            length = sum(map(len, own)) + 2 * (len(own) - 1)
        own.append(u)
        length += gap + len(u)
    if own:
        out.append("\n\n".join(own))
    return out


def split_long(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs if there are several, else sentences if there are several, else windows."""
    by_window = lambda t: windows(t, size, overlap)

    def by_sentence(t: str) -> list[str]:
        found = sentences(t)
        return pack(found, size, overlap, by_window) if len(found) > 1 else by_window(t)

    parts = blocks(text)
    return pack(parts, size, overlap, by_sentence) if len(parts) > 1 else by_sentence(text)


def merge_short(chunks: list[str], size: int) -> list[str]:
    """A chunk under 35 % of size takes the next one if both fit."""
    out: list[str] = []
    for c in chunks:
        if out and len(out[-1]) < size * 0.35 and len(out[-1]) + len(c) + 2 <= size:
            out[-1] = f"{out[-1]}\n\n{c}"
        else:
            out.append(c)
    return out


def chunk_text(text: str | None, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> list[str]:
    parts: list[str] = []
    for s in filter(None, map(compact, sections(text or ""))):
        parts += [s] if len(s) <= size else split_long(s, size, overlap)
    return merge_short(parts, size)


def hard_split(c: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """windows() as a column expression."""
    stride = size - overlap

    def cut(flat: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(flat) - size) / stride)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: T.strip(F.substring(flat, i * stride + 1, F.lit(size))))

    return F.filter(T.let(T.collapse(c), cut), lambda s: s != "")


def split_documents(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """docs: doc_ord, source, page, text. One row for each chunk; chunk_index restarts in each document (page)."""
    keys = ["doc_ord", "source", "page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in slices(b.column("text")):
                chunks = [chunk_text(t, size, overlap) for t in texts]
                of = pa.array([i + k for k, own in enumerate(chunks) for _ in own], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(of) for c in keys), pa.array([n for own in chunks for n in range(len(own))], pa.int32()), pa.array([c for own in chunks for c in own], pa.string())],
                    [*keys, "chunk_index", "text"],
                )

    d = docs.select(*keys, "text")
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in keys)
    out = d.mapInArrow(run, f"{kinds}, chunk_index int, text string")
    key = F.concat_ws(":", F.col("source"), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.col("chunk_index").cast("string"), F.substring("text", 1, 80))
    return out.select(F.substring(F.sha1(key.cast("binary")), 1, 16).alias("chunk_id"), *keys, "chunk_index", "text")
