"""Prompt-injection guard over questions and evidence.

Rules are column expressions (the first rule that matches gives the reason), so no sentence meets a table of rules. The semantic
check compares only instruction-like sentences without a rule finding; its IDF is that of the query's own batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V
from evidentia.functions import text as T
from evidentia.operators.retrieval import CHUNK, term_counts

RULE_SCORE, USER_SCORE = 0.96, 0.98


def first_reason(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The reason of the first rule that the text matches, or null."""
    return F.coalesce(*[F.when(T.rlike_any(c, p), F.lit(r)) for p, r in rules])


def local_similarity(records: DataFrame) -> DataFrame:
    """records: qid, ord, text. qid, ord, sim, example: the best cosine to an example attack (the first on ties).

    TF-IDF over the examples and the query's records together.
    """
    spark = records.sparkSession
    attacks = spark.createDataFrame(list(enumerate(V.ATTACKS)), "attack int, example string")
    a = attacks.select("attack", "example", T.guard_terms(F.col("example")).alias("t")).select("attack", "example", F.size("t").alias("total"), F.explode(term_counts(F.col("t"))).alias("x"))
    a = a.select("attack", "example", "total", "x.term", "x.tf")
    r = records.select("qid", "ord", T.guard_terms(F.col("text")).alias("t")).select("qid", "ord", F.size("t").alias("total"), F.explode(term_counts(F.col("t"))).alias("x")).select("qid", "ord", "total", "x.term", "x.tf")
    n = records.groupBy("qid").agg((F.count(F.lit(1)) + len(V.ATTACKS)).alias("n"))
    a = n.select("qid").crossJoin(F.broadcast(a))  # ten fixed sentences
    df = r.select("qid", "term").unionByName(a.select("qid", "term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "qid")
    idf = df.select("qid", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = F.col("tf") / F.col("total") * F.col("idf")
    r = r.join(idf, ["qid", "term"]).withColumn("w", weight).withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid", "ord"))))
    a = a.join(idf, ["qid", "term"]).withColumn("w", weight).withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid", "attack"))))
    both = r.select("qid", "term", "ord", F.col("w").alias("rw"), F.col("norm").alias("rn")).join(a.select("qid", "term", "attack", "example", F.col("w").alias("aw"), F.col("norm").alias("an")), ["qid", "term"])
    cos = both.groupBy("qid", "ord", "attack", "example").agg((F.sum(F.col("rw") * F.col("aw")) / (F.first("rn") * F.first("an"))).alias("sim"))
    best = F.row_number().over(Window.partitionBy("qid", "ord").orderBy(F.round("sim", 9).desc(), "attack"))
    return cos.withColumn("b", best).where("b = 1").select("qid", "ord", "sim", "example")


#: records (qid, ord, text) to qid, ord, sim, example, detector of those that are like an attack.
Likeness = Callable[[DataFrame], DataFrame]


def by_terms(records: DataFrame) -> DataFrame:
    return local_similarity(records).where(F.col("sim") >= V.LOCAL_THRESHOLD).withColumn("detector", F.lit("local semantic"))


def _semantic(records: DataFrame, likeness: Likeness) -> DataFrame:
    """Semantic findings among records (qid, ord, text, rule): the first 24 candidates of each query."""
    like = records.where(F.col("rule").isNull() & T.instruction_like(F.col("text")))
    like = like.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("ord"))).where(F.col("n") <= V.MAX_SEMANTIC)
    return likeness(like.select("qid", "ord", "text"))


def question_findings(queries: DataFrame, likeness: Likeness = by_terms) -> DataFrame:
    """qid, reason, score, detector: at most one finding for each question; user rules over rules over likeness."""
    q = queries.select("qid", F.col("question").alias("text"), F.lit(0).alias("ord"))
    q = q.withColumn("user", first_reason(F.col("text"), V.USER_RULES)).withColumn("rule", F.when(T.strip(F.col("text")) != "", first_reason(F.col("text"), V.RULES)))
    q = q.join(_semantic(q, likeness), ["qid", "ord"], "left")
    like = F.concat(F.lit("Semantically similar to prompt-injection behavior: "), F.col("example"))
    out = q.select(
        "qid",
        F.coalesce("user", "rule", like).alias("reason"),
        F.when(F.col("user").isNotNull(), USER_SCORE).when(F.col("rule").isNotNull(), RULE_SCORE).otherwise(F.round("sim", 3)).alias("score"),
        F.when(F.col("user").isNotNull(), "user rule").when(F.col("rule").isNotNull(), "rule").otherwise(F.col("detector")).alias("detector"),
    )
    return out.where("reason IS NOT NULL")


def has_question_intent(c: Column) -> Column:
    terms = T.guard_terms(c)
    asks = lambda t: F.arrays_overlap(t, T.lit_array(V.QUESTION_WORDS))
    more = F.size(F.array_except(terms, T.lit_array(V.CONTROL_TERMS))) > 0
    return c.contains("?") | F.coalesce(asks(F.slice(terms, 1, 1)), F.lit(False)) | (asks(F.slice(terms, 1, 4)) & more)


def refuse(queries: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """qid, refuse: whether a question is only an instruction attack."""
    findings = question_findings(queries) if findings is None else findings
    q = queries.join(findings.select("qid", "detector"), "qid", "left")
    c = F.col("question")
    rest = F.size(F.filter(T.guard_terms(c), lambda t: ~F.array_contains(T.lit_array(V.CONTROL_TERMS), t)))
    return q.select("qid", F.coalesce(F.when(F.col("detector").isNull(), False).when(first_reason(c, V.USER_RULES).isNotNull(), True).when(has_question_intent(c), False).otherwise(rest <= 1), F.lit(False)).alias("refuse"))


def evidence_records(evidence: DataFrame) -> DataFrame:
    """qid, ord, citation, source, chunk_id, text: the first 36 sentences of each query's evidence, in order."""
    s = evidence.select("qid", "rank", T.citation(F.col("source"), F.col("page"), F.col("chunk_index")).alias("citation"), "source", "chunk_id", F.posexplode(T.guard_sentences(F.col("text"))).alias("pos", "text"))
    ord_ = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "pos"))
    return s.withColumn("ord", ord_).where(F.col("ord") <= V.MAX_SENTENCES).select("qid", "ord", "citation", "source", "chunk_id", "text")


def evidence_findings(records: DataFrame, likeness: Likeness = by_terms) -> DataFrame:
    """qid, citation, source, text, norm, reason, score, detector: one finding for each citation and normal form."""
    r = records.where(T.strip(F.col("text")) != "").withColumn("rule", first_reason(F.col("text"), V.RULES))
    rules = r.where("rule IS NOT NULL").select("qid", "ord", "citation", "source", "text", F.col("rule").alias("reason"), F.lit(RULE_SCORE).alias("score"), F.lit("rule").alias("detector"))
    like = r.join(_semantic(r, likeness), ["qid", "ord"]).select("qid", "ord", "citation", "source", "text", F.concat(F.lit("Semantically similar to prompt-injection behavior: "), "example").alias("reason"), F.round("sim", 3).alias("score"), "detector")
    found = rules.unionByName(like).withColumn("norm", T.normalize_guard(F.col("text")))
    best = F.row_number().over(Window.partitionBy("qid", "citation", "norm").orderBy(F.col("score").desc(), "ord"))
    return found.withColumn("n", best).where("n = 1").drop("n")


def remove_blocked(text: Column, blocked: Column, strict_headings: bool = False) -> Column:
    """The text without blocked sentences. Headings are compared with their marks, so a marked heading that was found stays, unless strict."""

    def one(raw: Column) -> Column:
        line = T.strip(raw)
        body = T.unmarked(raw) if strict_headings else line
        heading = T.heading_marked(line) & ~F.array_contains(blocked, T.normalize_guard(body))
        safe = F.filter(F.split(T.collapse(body if strict_headings else line), T.SENTENCE_END, -1), lambda p: ~F.array_contains(blocked, T.normalize_guard(p)))
        return F.when(line == "", F.lit("")).when(heading, raw).when(F.size(safe) > 0, F.array_join(safe, " "))

    kept = F.filter(F.transform(T.lines(text), one), lambda x: x.isNotNull())
    return T.clean_sanitized(F.array_join(kept, "\n"))


def sanitize(evidence: DataFrame, records: DataFrame, findings: DataFrame, strict_headings: bool = False) -> DataFrame:
    """Evidence without found sentences; chunks that end up empty go."""
    hit = records.withColumn("norm", T.normalize_guard(F.col("text"))).join(findings.select("qid", "citation", "norm").distinct(), ["qid", "citation", "norm"])
    blocked = hit.groupBy("qid", "chunk_id").agg(F.collect_set("norm").alias("blocked"))
    e = evidence.join(blocked, ["qid", "chunk_id"], "left")
    text = F.when(F.col("blocked").isNull(), F.col("text")).otherwise(remove_blocked(F.col("text"), F.col("blocked"), strict_headings))
    e = e.withColumn("text", text).where(F.col("blocked").isNull() | (F.col("text") != ""))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return e.withColumn("rank", rank).select("qid", "rank", *CHUNK, "score")
