"""External models behind an interface, with an offline stand-in. Calls run in Arrow batches next to the data."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V
from evidentia.functions.tables import materialize, small_side
from evidentia.operators import corpus, evidence, guard, retrieval

BLOCK_BYTES = 16 << 20


class Embedder(Protocol):
    name: str
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    name: str

    def generate(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Offline: signed hashing of lower-cased words to a fixed width. The same text always gets the same vector."""

    name, model = "offline", "hash-64"

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in t.lower().split():
                d = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "little") % self.width] += 1.0 if d[4] & 1 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class EchoGenerator:
    """Offline: gives back a fixed reply for each prompt, for tests."""

    name = "offline"

    def __init__(self, reply: str = ""):
        self.reply = reply

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.reply for _ in prompts]


def safe_error(e: BaseException) -> str:
    """A message of at most 500 characters; the error's name if it has none. Of a worker's traceback, its last error."""
    text = str(e).strip()
    raised = re.findall(r"^(?:\w+\.)*\w+(?:Error|Exception): (.+)$", text, re.M) if "Traceback" in text else []
    return (raised[-1] if raised else text or type(e).__name__)[:500]


def embed(df: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """key, embedding. A failing call fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(embedder.embed(b.column(1).to_pylist()), pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def generate(df: DataFrame, key: str, prompt: str, generator: Generator) -> DataFrame:
    """key, reply, error: a failing batch gives a null reply and its message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                replies, errors = generator.generate(b.column(1).to_pylist()), [None] * b.num_rows
            except Exception as e:  # the local answer takes over
                replies, errors = [None] * b.num_rows, [safe_error(e)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], [key, "reply", "error"])

    return df.select(key, prompt).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, reply string, error string")


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids: list = []
    rows: list = []
    for r in queries.select("qid", "embedding").toLocalIterator():
        ids.append(r.qid)
        rows.append(r.embedding)
        if 8 * len(rows) * max(1, len(r.embedding)) >= BLOCK_BYTES:
            yield ids, np.array(rows, float)
            ids, rows = [], []
    if rows:
        yield ids, np.array(rows, float)


def _best(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id."""
    rank = np.searchsorted(np.unique(own), own)
    order = np.lexsort((rank, -np.round(score, 9)), axis=1)[:, :k]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(own, order, axis=1)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors: id, embedding; queries: qid, embedding. qid, rank, id, score: the k best positive cosines, ties to the smaller id.

    A stated query set against all vectors, in blocks: one block of queries, of at most BLOCK_BYTES, is broadcast at a time and given up
    when its results are written. A task scores its vectors by matrix products and hands on its k best for each query.
    """
    spark = vectors.sparkSession
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], kinds).select("qid", F.lit(0).alias("rank"), "id", "score")
    for block in _query_blocks(queries):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            qn = np.linalg.norm(q, axis=1)[:, None]
            step = max(1, 4_000_000 // len(q))
            score = ids = None
            for b in batches:
                for i in range(0, b.num_rows, step):
                    own = b.column("id")[i : i + step].to_numpy(zero_copy_only=False)
                    v = np.stack([np.asarray(x, float) for x in b.column("embedding")[i : i + step].to_pylist()])
                    with np.errstate(invalid="ignore", divide="ignore"):
                        s = np.nan_to_num((q @ v.T) / (qn * np.linalg.norm(v, axis=1)[None, :]))
                    own = np.broadcast_to(own, s.shape)
                    score, ids = _best(s, own, k) if score is None else _best(np.concatenate([score, s], axis=1), np.concatenate([ids, own], axis=1), k)
            if score is not None:
                use = score > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qids), score.shape[1]).reshape(score.shape)[use]), pa.array(ids[use]), pa.array(score[use])], ["qid", "id", "score"])

        found = vectors.select("id", "embedding").mapInArrow(run, kinds)
        w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")
        out = out.unionByName(materialize(found, "dense-hits"))
        shared.destroy()
    return out


def build_index(chunks: DataFrame, embedder: Embedder | None = None) -> tuple[retrieval.Index | DataFrame, str, str | None]:
    """The index, its backend and why it fell back: dense (chunk_id, embedding) with an embedder, TF-IDF without or if it fails.

    The embeddings are made and written here and now, as a lazy failure would escape.
    """
    if embedder is not None:
        try:
            return materialize(embed(chunks, "chunk_id", "text", embedder), "embeddings"), f"{embedder.name} embeddings", None
        except Exception as e:
            return retrieval.build_index(chunks, write=True), "Local TF-IDF", safe_error(e)
    return retrieval.build_index(chunks, write=True), "Local TF-IDF", None


def search_dense_index(dense: DataFrame, chunks: DataFrame, queries: DataFrame, embedder: Embedder, k: int) -> DataFrame:
    """As retrieval.search, over an index of embeddings."""
    q = embed(queries.select("qid", "question"), "qid", "question", embedder)
    found = small_side(dense_search(dense.withColumnRenamed("chunk_id", "id"), q, k).withColumnRenamed("id", "chunk_id"), retrieval.SMALL_SIDE)
    return chunks.join(found, "chunk_id").select("qid", "rank", *retrieval.CHUNK, "score")


_attack_vectors: dict[tuple[str, str], list[list[float]]] = {}


def attack_vectors(embedder: Embedder) -> list[list[float]]:
    """The embeddings of the example attacks, made once for each provider and model."""
    key = (embedder.name, embedder.model)
    if key not in _attack_vectors:
        _attack_vectors[key] = embedder.embed(list(V.ATTACKS))
    return _attack_vectors[key]


def embedded_similarity(records: DataFrame, embedder: Embedder) -> DataFrame:
    """records: qid, ord, text. qid, ord, sim, example: the best cosine to an example attack (the first on ties), by a provider's embeddings."""
    attacks = np.array(attack_vectors(embedder), float)
    norms = np.linalg.norm(attacks, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(embedder.embed(b.column("text").to_pylist()), float)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.nan_to_num((v @ attacks.T) / (np.linalg.norm(v, axis=1)[:, None] * norms[None, :]))
            best = np.round(s, 9).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("ord"), pa.array(s[np.arange(len(s)), best]), pa.array([V.ATTACKS[i] for i in best], pa.string())], ["qid", "ord", "sim", "example"])

    kind = lambda c: records.schema[c].dataType.simpleString()
    return records.select("qid", "ord", "text").mapInArrow(run, f"qid {kind('qid')}, ord {kind('ord')}, sim double, example string")


def guard_likeness(embedder: Embedder) -> guard.Likeness:
    """The guard's likeness by embeddings; by its own terms where the provider fails. Made and written at once, as a lazy failure would escape."""

    def likeness(records: DataFrame) -> DataFrame:
        try:
            found = materialize(embedded_similarity(records, embedder), "guard-embeddings")
        except Exception:
            return guard.by_terms(records)
        return found.where(F.col("sim") >= V.EMBEDDING_THRESHOLD).withColumn("detector", F.lit(getattr(embedder, "detector", embedder.name)))

    return likeness


# --- prompts --------------------------------------------------------------------------------------------------------------------


def answer_prompt(question: Column, mode: Column, context: Column) -> Column:
    modes = F.create_map(*[F.lit(x) for kv in V.ANSWER_MODES.items() for x in kv])
    ask = F.coalesce(F.try_element_at(modes, mode), F.lit(V.ANSWER_MODES["Simple Answer"]))
    return F.concat(
        F.lit(f"{V.UNTRUSTED}\n\nAnswer from the evidence only; say what is missing if it does not suffice. Put the answer first, make key values bold, and cite by number, as in [1].\n\nQuestion:\n"),
        question,
        F.lit("\n\nForm: "),
        ask,
        F.lit("\n\nEvidence:\n"),
        context,
    )


def conflict_prompt(question: Column, context: Column) -> Column:
    shape = '{"conflicts": [{"claim_a": "", "source_a": "", "claim_b": "", "source_b": "", "why_conflict": "", "severity": "low|medium|high"}], "no_conflict_reason": ""}'
    return F.concat(F.lit(f"{V.UNTRUSTED}\n\nName real contradictions between the pieces of evidence, none that conditions, scope or dates explain. Reply as JSON like {shape}\n\nQuestion:\n"), question, F.lit("\n\nEvidence:\n"), context)


def rewrite_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(f"{V.UNTRUSTED}\n\nRewrite the question as one clear search query; resolve vague words by the documents; do not answer it.\n\nQuestion:\n"), question, F.lit("\n\nDocuments:\n"), context)


def suggestion_prompt(context: Column, most: int) -> Column:
    return F.concat(F.lit(f'{V.UNTRUSTED}\n\nWrite {most} specific questions that these documents answer. Reply as JSON like {{"questions": [""]}}\n\nDocuments:\n'), context)


def generated_answers(queries: DataFrame, compressed: DataFrame, local: DataFrame, generator: Generator) -> DataFrame:
    """qid, answer: the provider's, or the local answer with a note where the call failed."""
    prompts = queries.join(evidence.context(compressed), "qid", "left").select("qid", answer_prompt(F.col("question"), F.col("mode"), F.coalesce("context", F.lit(""))).alias("prompt"))
    out = generate(prompts, "qid", "prompt", generator).join(local, "qid", "left")
    note = F.concat("answer", F.lit(f"\n\nNote: {generator.name} generation failed, so a local extractive answer was used. Error: "), F.col("error"))
    return out.select("qid", F.when(F.col("error").isNull(), F.coalesce("reply", F.lit(""))).otherwise(note).alias("answer"))


def judged_conflicts(queries: DataFrame, evidence_rows: DataFrame, generator: Generator) -> DataFrame:
    """qid, conflict_warnings by a provider over compressed evidence; the word-pair check where it fails or gives no JSON."""
    short = evidence.compress(evidence_rows, queries.withColumn("mode", F.lit("Conflict Analysis"))).where("rank <= 6")
    prompts = queries.join(evidence.context(short), "qid").select("qid", conflict_prompt(F.col("question"), F.col("context")).alias("prompt"))
    replies = generate(prompts, "qid", "prompt", generator).withColumn("json", corpus.extract_json(F.col("reply")))
    plain = evidence.conflicts(evidence_rows).withColumnRenamed("conflict_warnings", "plain")
    out = replies.join(plain, "qid", "left")
    return out.select("qid", F.when(F.col("json").isNull(), F.col("plain")).otherwise(corpus.parse_conflicts(F.col("reply"))).alias("conflict_warnings")).where(F.size("conflict_warnings") > 0)


def rewritten_by(queries: DataFrame, chunks: DataFrame, generator: Generator) -> DataFrame:
    """qid, rewritten: a provider's rewrite of vague questions; the local one where it fails or is unusable."""
    from evidentia.functions import text as T

    first = chunks.orderBy("doc_ord", "chunk_index").limit(8)
    item = F.concat(F.lit("- "), evidence.cite(), F.lit(": "), T.shorten(F.col("text"), 260))
    context = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "chunk_index", item.alias("v")))), lambda x: x["v"]), "\n").alias("context"))
    vague = queries.where(corpus.looks_vague(T.collapse(F.col("question")))).crossJoin(F.broadcast(context))  # one row
    replies = generate(vague.select("qid", rewrite_prompt(T.collapse(F.col("question")), F.col("context")).alias("prompt")), "qid", "prompt", generator)
    out = corpus.rewrite(queries, chunks).join(queries.select("qid", T.collapse(F.col("question")).alias("question")), "qid").join(replies.where("error IS NULL"), "qid", "left")
    return out.select("qid", F.when(F.coalesce("reply", F.lit("")) == "", F.col("rewritten")).otherwise(corpus.clean_rewrite(F.col("reply"), F.col("question"))).alias("rewritten"))


def suggested_by(chunks: DataFrame, generator: Generator, most: int = 5) -> DataFrame:
    """pos, question: a provider's suggestions, or the local ones."""
    from evidentia.functions import text as T

    item = F.concat(evidence.cite(), F.lit("\n"), T.shorten(F.col("text"), 700))
    first = chunks.orderBy("doc_ord", "chunk_index").limit(10)
    prompt = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "chunk_index", item.alias("v")))), lambda x: x["v"]), "\n\n").alias("c")).select(F.lit(0).alias("qid"), suggestion_prompt(F.col("c"), most).alias("prompt"))
    reply = generate(prompt, "qid", "prompt", generator).first()  # one row
    if reply is None or reply.error or not reply.reply:
        return corpus.suggestions(chunks, most)
    own = chunks.sparkSession.createDataFrame([(reply.reply,)], "reply string").select(F.posexplode(F.slice(corpus.parse_questions(F.col("reply")), 1, most)).alias("pos", "question"))
    return own if own.head(1) else corpus.suggestions(chunks, most)
