"""The whole way of a question: guard, rewrite, retrieve, expand, rerank, select, sanitise, answer, conflicts, trust."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V
from evidentia.functions import text as T
from evidentia.functions.tables import materialize
from evidentia.operators import chunking, corpus, evidence, graph, guard, providers, retrieval
from evidentia.settings import Settings


@dataclass
class KnowledgeBase:
    docs: DataFrame
    chunks: DataFrame
    index: retrieval.Index | DataFrame
    graph: graph.Graph | None
    backend: str = "Local TF-IDF"
    fallback_reason: str | None = None
    embedder: providers.Embedder | None = None


def build(docs: DataFrame, settings: Settings = Settings(), with_graph: bool = True, embedder: providers.Embedder | None = None) -> KnowledgeBase:
    """docs: doc_ord, source, page, text. Chunks, index and graph are written tables that every later query reads.

    With an embedder the index is dense; if it fails, the index is TF-IDF, and fallback_reason says why.
    """
    chunks = materialize(chunking.split_documents(docs, settings.chunk_size, settings.chunk_overlap), "chunks", compact=True)
    index, backend, why = providers.build_index(chunks, embedder)
    return KnowledgeBase(docs, chunks, index, graph.build_graph(chunks, write=True) if with_graph else None, backend, why, embedder if embedder is not None and why is None else None)


def search(kb: KnowledgeBase, queries: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each question, by the knowledge base's own index."""
    return providers.search_dense_index(kb.index, kb.chunks, queries, kb.embedder, k) if kb.embedder is not None else retrieval.search(kb.index, queries, k)


def with_defaults(queries: DataFrame) -> DataFrame:
    """qid, question, mode, retrieval_mode, conflict_mode."""
    for name, value in (("mode", "Simple Answer"), ("retrieval_mode", "Vector RAG"), ("conflict_mode", "Fast heuristic")):
        queries = queries.withColumn(name, F.coalesce(name, F.lit(value)) if name in queries.columns else F.lit(value))
    return queries.select("qid", "question", "mode", "retrieval_mode", "conflict_mode")


def compare(queries: DataFrame) -> DataFrame:
    """Queries that compare documents: a fixed prefix, in the detailed mode."""
    return with_defaults(queries).withColumn("question", F.concat(F.lit(V.COMPARE_PREFIX), "question")).withColumn("mode", F.lit("Detailed Explanation"))


def answer(queries: DataFrame, kb: KnowledgeBase, settings: Settings = Settings(), rewrite: bool = True, expand: bool = False, generator: providers.Generator | None = None, judge: providers.Generator | None = None, strict_headings: bool = False, guard_embedder: providers.Embedder | None = None) -> DataFrame:
    """Stages are written tables; each reads what the one before has kept. One row for each query: qid, mode, answer, rewritten_query, evidence (array), warnings (array) and the trust columns.

    expand: whether any query may ask for graph-enhanced retrieval; without it that branch is not planned. generator answers in place of
    the local answer, judge finds conflicts for queries whose conflict_mode isn't the fast one; both fall back to the local way; so does guard_embedder, which
    compares instruction-like sentences with example attacks.
    """
    likeness = guard.by_terms if guard_embedder is None else providers.guard_likeness(guard_embedder)
    q = with_defaults(queries)
    q = materialize(q, "queries")
    found = materialize(guard.question_findings(q, likeness), "question-findings")
    q = materialize(q.join(guard.refuse(q, found), "qid"), "guarded")
    live = q.where(~F.col("refuse")).drop("refuse")
    asked = materialize(corpus.rewrite(live, kb.chunks, rewrite), "asked")
    asking = live.select("qid", "mode").join(asked, "qid").select("qid", F.col("rewritten").alias("question"), "mode")
    pool = max(12, settings.max_chunks * 4)
    hits = materialize(search(kb, asking, pool), "hits")
    if expand:
        wants = live.where("retrieval_mode = 'Graph-Enhanced RAG'").select("qid")
        more = graph.enhance(hits.join(wants, "qid", "left_semi"), asking.join(wants, "qid", "left_semi"), kb.graph, pool)
        hits = hits.join(wants, "qid", "left_anti").unionByName(more)
    chosen = materialize(retrieval.select_evidence(hits, kb.chunks, asking, settings.max_chunks), "chosen")
    broad = live.where(evidence.is_overview_question(F.col("question"))).select("qid")
    # overview questions that retrieve nothing get the corpus's first chunks
    fallback = broad.join(chosen.select("qid").distinct(), "qid", "left_anti").crossJoin(F.broadcast(retrieval.overview(kb.chunks, settings.max_chunks)))  # max_chunks rows
    chosen = materialize(chosen.unionByName(fallback.select(*chosen.columns)), "evidence")
    records = materialize(guard.evidence_records(chosen), "records")
    findings = materialize(guard.evidence_findings(records, likeness), "findings")
    safe = materialize(guard.sanitize(chosen, records, findings, strict_headings), "safe")

    narrow = live.join(broad, "qid", "left_anti")
    local = evidence.local_answers(narrow, safe)
    if generator is not None:
        local = providers.generated_answers(narrow, evidence.compress(safe, narrow), local, generator)
    answers = materialize(local.unionByName(evidence.overview_answers(broad, safe)), "answers")
    conflicts = evidence.conflicts(safe)
    if judge is not None:
        slow = live.where("conflict_mode <> 'Fast heuristic'").select("qid", "question")
        conflicts = conflicts.join(slow, "qid", "left_anti").unionByName(providers.judged_conflicts(slow, safe.join(slow.select("qid"), "qid", "left_semi"), judge))

    own = found.select("qid", F.lit("User question").alias("citation"), "reason", F.col("score").cast("double").alias("score"), "detector")
    warned = own.unionByName(findings.select("qid", "citation", "reason", F.col("score").cast("double").alias("score"), "detector"))
    warnings = warned.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "citation", "reason", "detector"))).alias("warnings"))
    judged = materialize(evidence.trust(live, safe, answers, conflicts, warnings.select("qid", "n")), "trust")
    shown = evidence.listed(safe, ["qid"], ["rank"], F.struct(evidence.cite().alias("citation"), "chunk_id", F.round("score", 6).alias("score")), "evidence")

    out = live.join(answers, "qid").join(judged, "qid").join(asked, "qid").join(shown, "qid", "left").join(warnings.select("qid", "warnings"), "qid", "left")
    columns = ["qid", "mode", "answer", "rewritten_query", "score", "label", "reasons", "gaps", "conflict_warnings", "should_refuse", "evidence", "warnings"]
    out = out.select(
        "qid",
        "mode",
        F.when(F.col("should_refuse"), V.REFUSAL).otherwise(T.highlight(F.col("answer"))).alias("answer"),
        F.when(F.col("rewritten") != F.col("question"), F.col("rewritten")).alias("rewritten_query"),
        *columns[4:],
    )
    refused = q.where("refuse").join(warnings.select("qid", "warnings"), "qid", "left")
    no = F.array().cast("array<string>")
    refused = refused.select(
        "qid",
        "mode",
        F.lit(V.INJECTION_REFUSAL).alias("answer"),
        F.lit(None).cast("string").alias("rewritten_query"),
        F.lit(0).alias("score"),
        F.lit("Prompt injection blocked").alias("label"),
        F.array(F.lit("The user prompt was an instruction-only request to change assistant behavior.")).alias("reasons"),
        F.array(F.lit("Ask a factual question about the uploaded documents.")).alias("gaps"),
        no.alias("conflict_warnings"),
        F.lit(True).alias("should_refuse"),
        F.lit(None).cast(out.schema["evidence"].dataType).alias("evidence"),
        "warnings",
    )
    return out.unionByName(refused)
