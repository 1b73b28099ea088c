"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once for each document. The ledger stores the measurements and one bit for each failed
rule. Policies are versioned sets of rules: applying one, comparing versions and computing ablations are bitwise
operations over the stored masks and never read a text again.

All rules compare whole numbers, so the masks are exact and the same in every engine.

Cases: a null or empty text has no words and fails few_words; a text with fewer than three words has no window; repeated rows are
rows of their own; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import for_texts, slices

#: Rule name -> SQL condition under which a document fails, over the measurements. The position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "digits": "100 * n_digits > 50 * word_chars",
    "bullets": "100 * n_bullet_lines > 90 * n_lines AND n_lines > 3",
    "ellipses": "100 * n_ellipsis_lines > 30 * n_lines AND n_lines > 3",
    "upper_case": "100 * n_upper > 60 * word_chars",
}
BASE = ("few_words", "repeated_words")
#: Policies by version; each names the rules that it enforces.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "short_words", "long_words", "symbols", "repeated_lines"),
    "v3": (*BASE, "short_words", "long_words", "symbols", "repeated_lines", "digits", "bullets", "ellipses"),
}
CURRENT = "v3"
_SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.array([int(c in _SYMBOLS) for c in range(256)], np.uint8)
_HEAD = np.array([int(c & 0xC0 != 0x80) for c in range(256)], np.uint8)  # bytes that begin a code point
_KEEP_CASE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_DIGIT = np.array([int(48 <= c <= 57) for c in range(256)], np.uint8)
_UPPER = np.array([int(65 <= c <= 90) for c in range(256)], np.uint8)
_BULLETS = (b"-", b"*", "\u2022".encode())
_ELLIPSES = (b"...", "\u2026".encode())
FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits", "n_upper", "n_bullet_lines", "n_ellipsis_lines")


#: Distinct words whose triples are packed into 64 bits; pairs of more are numbered first.
MOST_PACKED = 2_000_000


def repeated(words: list[bytes]) -> int:
    """Words inside a window of three that occurs twice or more in the text, its first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids)
    if k == n:
        return 0
    pair = at[:-1] * k + at[1:]
    if k < MOST_PACKED:
        code = pair[:-1] * k + at[2:]
    else:  # the packed code would not fit 64 bits
        _, pair = np.unique(pair, return_inverse=True)
        code = pair[:-1] * k + at[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : shift + n - 2] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.translate(_KEEP_CASE).split()
    codes = np.frombuffer(raw, np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bare = [x.strip() for x in lines]
    spaces = np.count_nonzero(np.frombuffer(raw.translate(_KEEP_CASE), np.uint8) == 32)
    count = lambda table: int(table[codes].sum(dtype=np.int64))
    return (
        len(words),
        count(_HEAD) - int(spaces),
        count(_SYMBOL),
        len(lines),
        len(lines) - len(set(lines)),
        repeated(words),
        count(_DIGIT),
        count(_UPPER),
        sum(x.startswith(_BULLETS) for x in bare),
        sum(x.endswith(_ELLIPSES) for x in bare),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for _, _, texts in slices(b.column("text")) for t in texts]
        columns = list(zip(*rows)) if rows else [[]] * len(FIELDS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *FIELDS])


def mask(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def evaluate_rules(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, the measurements, and fail_bits."""
    for_texts(docs.sparkSession)
    d = docs.select("doc_id", "text")
    measured = d.mapInArrow(_measure, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{f} long" for f in FIELDS))
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(RULES.values())]
    fail = bits[0]
    for b in bits[1:]:
        fail = fail.bitwiseOR(b)
    return measured.withColumn("fail_bits", fail)


def passes(version: str = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablations(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it removes. One bitwise aggregation."""
    within = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    rules = POLICIES[version]
    sums = []
    for name in rules:
        bit = F.lit(mask([name])).cast("long")
        sums += [F.count_if(within.bitwiseAND(bit) != 0).alias(f"f_{name}"), F.count_if(within == bit).alias(f"o_{name}")]
    one = ledger.agg(*sums)
    stack = ", ".join(f"'{n}', f_{n}, o_{n}" for n in rules)
    return one.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, n_failed, n_only)")


def query(spark, sf_dir: str) -> DataFrame:
    ledger = evaluate_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes().alias("kept"), "fail_bits")


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """What each rule of the current policy removes, and what it alone removes."""
    return ablations(evaluate_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_LEDGER = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM win, (VALUES (0), (1), (2)) AS s(o) WHERE c > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^0-9]+', '', 'g'))::BIGINT AS n_digits, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN rep USING (r)),
f AS (SELECT *, """ + " + ".join(f"{1 << k} * ({rule})::BIGINT" for k, rule in enumerate(RULES.values())) + " AS fail_bits FROM m)\n"
ORACLE = _LEDGER + f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask(BASE)} <> 0 AS base_failed, fail_bits & {mask(POLICIES[CURRENT])} = 0 AS kept, fail_bits FROM f"
ABLATION_ORACLE = _LEDGER + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE fail_bits & {mask([n])} <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & {mask(POLICIES[CURRENT])} = {mask([n])}) AS n_only FROM f" for n in POLICIES[CURRENT]
)
