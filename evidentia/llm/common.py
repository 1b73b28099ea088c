"""Shared helpers of the training-data operators.

Conventions that hold for all operators here:

* a null text counts as the empty text unless an operator says otherwise;
* a null id is carried through as null, and its text form is the empty text;
* operators select only the columns they need, so extra input columns, whatever their names, never clash;
* whole texts are read, never prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.arrow import chunks_by_bytes, slices  # noqa: F401  for the operators here
from evidentia.functions.hashes import mix64, word_hashes, words_of  # noqa: F401  for the operators here
from evidentia.functions.tables import discard, materialize, shared_dir  # noqa: F401  for the operators here

#: A word, for the contracts that split at ASCII white space. bytes.split() splits at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows at once, for texts of some kilobytes: Spark's own batches of 4096 and 10,000 rows hold tens of megabytes of text for each task, and
#: the executors' heaps grow by them.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Rows of one key that a task may get in a join.
HOT_ROWS = 1_000_000


def for_texts(spark: SparkSession) -> SparkSession:
    """The session with batches for long texts, where its owner has not set them."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def id_text(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo mod, is 0 (a null id counts as the empty text, crc32 0)."""
    return (F.crc32(id_text(col).cast("binary")) % mod) == 0


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together a 128-bit identity of the text."""
    return F.xxhash64(F.lit(11), text), F.xxhash64(F.lit(23), text)


def _plain_scan(df: DataFrame) -> bool:
    """Whether df reads Parquet files and does nothing else, each file once."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = [x.rstrip("/") + "/" for x in plan.relation().location().rootPaths().mkString("\n").split("\n")]
    apart = all(not y.startswith(x) for i, x in enumerate(sorted(roots)) for y in sorted(roots)[i + 1 : i + 2])
    return apart and "parquet" in plan.relation().fileFormat().toString().lower() and "_metadata" not in (c.lower() for c in df.columns)


def addressed(df: DataFrame) -> DataFrame:
    """_row (all columns of df, as a struct), and _file and _at, the address of the row in its file.

    Decisions about rows are made on narrow tables that carry the address; the rows' texts are then met once, by the
    address, which no two rows share, so no key is hot whatever the rows hold. df is written first if it is not a plain scan.
    """
    row = df.select(F.struct("*").alias("_row"), *_address()) if _plain_scan(df) else materialize(df.select(F.struct("*").alias("_row")), "rows").select("_row", *_address())
    return row


def _address() -> list[Column]:
    return [F.xxhash64(F.lit(1), F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_at")]


ADDRESS = ["_file", "_at"]


def pick(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The addressed rows that have decisions, with the columns of these. The narrow side is hashed, so no text is sorted."""
    return rows.join(decisions.hint("shuffle_hash"), ADDRESS)


def join_hot(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined to small (one row a key). counts: key, n, the rows of each key in big. A key with over hot_rows rows is dealt to as many
    tasks as it needs, and its row of small is repeated for each; there are at most rows / hot_rows of them."""
    hot = counts.where(F.col("n") > hot_rows).select(key, F.ceil(F.col("n") / hot_rows).cast("int").alias("_parts"))
    if not hot.head(1):
        return big.join(small, key)
    hot = F.broadcast(hot)
    part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0)).cast("int")
    left = big.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = small.join(hot, key, "left").withColumn("_part", every).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


#: For words split at ASCII white space, with A-Z lower-cased.
LOWER_SPACE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
