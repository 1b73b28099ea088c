"""What is made of evidence: compression, conflicts, trust, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V
from evidentia.functions import text as T
from evidentia.operators.retrieval import CHUNK, term_counts


def cite() -> Column:
    return T.citation(F.col("source"), F.col("page"), F.col("chunk_index"))


def listed(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, most: int | None = None) -> DataFrame:
    """by, name: the values of each group as an array in order. For groups of bounded size."""
    items = F.array_sort(F.collect_list(F.struct(*order, value.alias("value"))))
    if most is not None:
        items = F.slice(items, 1, most)
    return df.groupBy(*by).agg(F.transform(items, lambda x: x["value"]).alias(name))


# --- compression ----------------------------------------------------------------------------------------------------------------


def should_compress(question: Column, mode: Column) -> Column:
    terms = T.rerank_terms(question)
    low = F.lower(question)
    broad = F.arrays_overlap(terms, T.lit_array(V.BROAD_TERMS)) | low.contains(V.BROAD_PHRASES[0]) | low.contains(V.BROAD_PHRASES[1])
    narrow = mode.isin("Detailed Explanation", "Study Notes") & (F.size(F.array_distinct(terms)) <= 4)
    return ~(broad | narrow)


def sentence_limit(mode: Column) -> Column:
    return F.when(mode == "Conflict Analysis", 5).when(mode.isin("Action Items", "Bullet Summary"), 4).otherwise(3)


def score_sentences(records: DataFrame) -> DataFrame:
    """records: qid, chunk_id, question, i, heading, sentence. Adds score: BM25 within the chunk and small signals."""
    by = Window.partitionBy("qid", "chunk_id")
    r = records.withColumn("terms", T.rerank_terms(F.concat_ws(" ", "heading", "sentence"))).withColumn("q", T.rerank_terms(F.col("question")))
    r = r.withColumn("length", F.size("terms")).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("mean", F.avg("length").over(by))
    t = r.select("qid", "chunk_id", "i", "length", "n", "mean", "terms", F.explode(term_counts(F.col("q"))).alias("t"))
    t = t.withColumn("tf", F.size(F.filter("terms", lambda x: x == F.col("t.term")))).where("tf > 0")
    df = F.count(F.lit(1)).over(Window.partitionBy("qid", "chunk_id", "t.term"))
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    mean = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    part = F.col("t.tf") * idf * (F.col("tf") * (V.K1 + 1)) / (F.col("tf") + V.K1 * (1 - V.B + V.B * F.col("length") / mean))
    raw = t.withColumn("part", part).groupBy("qid", "chunk_id", "i").agg(F.sum("part").alias("raw"))
    raw = raw.select("qid", "chunk_id", "i", (F.col("raw") / F.max("raw").over(by)).alias("bm25"))
    r = r.join(raw, ["qid", "chunk_id", "i"], "left")
    distinct = F.array_distinct("q")
    numbers = F.filter(distinct, lambda x: x.rlike("^[0-9]+$"))
    score = (
        F.coalesce("bm25", F.lit(0.0))
        + F.size(F.array_intersect(distinct, T.rerank_terms(F.col("heading")))) * 0.14
        + F.size(F.array_intersect(distinct, "terms")) * 0.04
        + F.when(F.size(numbers) > 0, F.size(F.array_intersect(numbers, "terms")) / F.size(numbers) * 0.2).otherwise(0.0)
        + F.when(T.has_condition(F.col("sentence")), 0.16).otherwise(0.0)
        - F.least(F.col("i") * 0.015, F.lit(0.12))
    )
    return r.select(*records.columns, score.alias("score"))


def choose(ranked: Column, conditions: Column, limit: Column) -> Column:
    """Positions: the best `limit`, then neighbours with a condition signal, in ascending order, up to one more than the limit.

    ranked: positions of positive score, best first; conditions: positions with a signal.
    """
    first = F.slice(ranked, F.lit(1), limit)
    steps = F.flatten(F.transform(F.array_sort(first), lambda i: F.array(i - 1, i + 1)))

    def fold(acc: Column, i: Column) -> Column:
        return F.when((F.size(acc) < limit + 1) & F.array_contains(conditions, i) & ~F.array_contains(acc, i), F.concat(acc, F.array(i))).otherwise(acc)

    return F.array_sort(F.aggregate(steps, first, fold))


def compress(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """queries: qid, question, mode. evidence with shorter texts where the question allows it."""
    e = evidence.join(queries.select("qid", "question", "mode"), "qid").withColumn("limit", sentence_limit(F.col("mode")))
    e = e.withColumn("records", T.compress_records(F.col("text")))
    use = should_compress(F.col("question"), F.col("mode")) & (F.length("text") > 260) & (F.size("records") > F.col("limit"))
    e = e.withColumn("use", use)
    r = score_sentences(e.where("use").select("qid", "chunk_id", "question", F.posexplode("records").alias("i", "r")).select("qid", "chunk_id", "question", "i", "r.heading", "r.sentence"))
    picked = r.groupBy("qid", "chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("score") > 0, F.struct((-F.round("score", 9)).alias("s"), "i")))), lambda x: x["i"]).alias("ranked"),
        F.collect_list(F.when(T.has_condition(F.col("sentence")), F.col("i"))).alias("conditions"),
    )
    e = e.join(picked, ["qid", "chunk_id"], "left").withColumn("chosen", F.when(F.col("use"), choose(F.col("ranked"), F.col("conditions"), F.col("limit"))))
    taken = F.transform("chosen", lambda i: F.get(F.col("records"), i))
    heading = F.get(F.filter(F.transform(taken, lambda x: T.strip(x["heading"])), lambda h: h != ""), F.lit(0))
    body = F.concat(F.when(heading.isNotNull(), F.array(heading)).otherwise(F.array().cast("array<string>")), F.transform(taken, lambda x: x["sentence"]))
    short = T.shorten(F.array_join(body, "\n"), 900)
    text = F.when(~F.col("use"), F.col("text")).when((F.size("chosen") == 0) | (F.length(short) < 80), T.shorten(F.col("text"), 520)).otherwise(short)
    return e.withColumn("out", F.when(text == "", F.col("text")).otherwise(text)).select("qid", "rank", *[c for c in CHUNK if c != "text"], F.col("out").alias("text"), "score")


# --- conflicts and trust --------------------------------------------------------------------------------------------------------


def conflicts(evidence: DataFrame) -> DataFrame:
    """qid, conflict_warnings: disagreements by word pairs among the first six chunks, sorted. No row where there is none."""
    e = evidence.where("rank <= 6").select("qid", "rank", cite().alias("citation"), F.replace(F.lower("text"), F.lit("-"), F.lit(" ")).alias("text"))
    # a citation keeps its first place and its last text
    e = e.groupBy("qid", "citation").agg(F.min("rank").alias("place"), F.max_by("text", "rank").alias("text"))
    docs = e.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "citation", "text"))).alias("d"))  # six at most
    found = []
    for plus, minus in V.NEGATION_PAIRS:
        pos = F.transform(F.filter("d", _positive(plus, minus)), lambda x: x["citation"])
        neg = F.transform(F.filter("d", _negative(minus)), lambda x: x["citation"])
        where = F.slice(F.concat(F.slice(pos, 1, 2), F.slice(neg, 1, 2)), 1, 3)
        found.append(F.when((F.size(pos) > 0) & (F.size(neg) > 0), F.concat(F.lit(f"Possible disagreement around '{plus}' language in: "), F.array_join(where, ", "))))
    return docs.select("qid", F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("conflict_warnings")).where(F.size("conflict_warnings") > 0)


def _positive(plus: str, minus: str):
    return lambda x: x["text"].contains(plus) & ~x["text"].contains(minus)


def _negative(minus: str):
    return lambda x: x["text"].contains(minus)


def trust(queries: DataFrame, evidence: DataFrame, answers: DataFrame, conflict_rows: DataFrame, injections: DataFrame) -> DataFrame:
    """queries: qid, question; answers: qid, answer; conflict_rows: qid, conflict_warnings; injections: qid, n.

    qid, score, label, reasons, gaps, conflict_warnings, should_refuse.
    """
    agg = evidence.groupBy("qid").agg(
        F.max_by("score", -F.col("rank")).alias("top"),
        (F.sum(F.when(F.col("rank") <= 3, F.col("score"))) / F.least(F.count(F.lit(1)), F.lit(3))).alias("mean"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source").alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 4, F.struct("rank", "text")))), lambda x: x["text"]), " ").alias("first4"),
    )
    t = queries.select("qid", "question").join(agg, "qid", "left").join(answers, "qid", "left").join(conflict_rows, "qid", "left").join(injections.select("qid", F.col("n").alias("inj")), "qid", "left")
    q = F.array_distinct(T.trust_terms(F.col("question")))
    t = t.withColumn("q", q).withColumn("overlap", F.when(F.size("q") == 0, 1.0).otherwise(F.size(F.array_intersect("q", T.trust_terms(F.col("first4")))) / F.size("q")))
    base = F.bround(15 + F.least(F.col("top") / 0.35, F.lit(1.0)) * 35 + F.least(F.col("mean") / 0.22, F.lit(1.0)) * 20 + F.col("overlap") * 25).cast("int")
    inj = F.coalesce("inj", F.lit(0))
    n_conflicts = F.when(F.col("conflict_warnings").isNull(), 0).otherwise(F.size("conflict_warnings"))
    score = base + F.when(F.col("n") >= 3, 6).otherwise(0) + F.when(F.col("sources") > 1, 4).otherwise(0) - F.least(F.lit(25), n_conflicts * 10) - F.least(F.lit(30), inj * 12)
    low = F.lower("answer")
    missing = low.contains("not found") | low.contains("could not find")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.when(missing, F.least(score, F.lit(35))).otherwise(score)))
    none = F.col("n").isNull()
    t = t.withColumn("points", F.when(none, 0).otherwise(score).cast("int")).withColumn("no", none | (F.col("points") < 35) | (F.col("top") < 0.05))
    say = lambda c, s: F.when(c, F.lit(s))
    reasons = F.array_compact(
        F.array(
            say(F.col("n") >= 3, "Multiple supporting chunks were found."),
            say(F.col("sources") > 1, "Evidence comes from more than one document."),
            say(n_conflicts > 0, "Potentially conflicting evidence was detected."),
            say(inj > 0, "Possible prompt injection was detected and excluded from answer context."),
        )
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("Score is based on retrieval relevance and evidence coverage.")))
    gaps = F.array_sort(
        F.array_compact(
            F.array(
                say(inj > 0, "Suspicious instruction-like text was removed before answer generation."),
                say(F.col("top") < 0.08, "The closest source match is weak."),
                say((F.size("q") > 0) & (F.col("overlap") < 0.18), "The question terms have limited overlap with the retrieved evidence."),
                say(missing, "The answer says the documents do not fully contain the requested detail."),
            )
        )
    )
    label = F.when(none, "No support").when(F.col("no"), "Insufficient support").when(F.col("points") >= 75, "High trust").when(F.col("points") >= 50, "Medium trust").otherwise("Low trust")
    empty = F.array().cast("array<string>")
    return t.select(
        "qid",
        F.col("points").alias("score"),
        label.alias("label"),
        F.when(none, F.array(F.lit("No relevant document chunks were retrieved."))).otherwise(reasons).alias("reasons"),
        F.when(none, F.array(F.lit("Upload more relevant documents or ask a narrower question."))).otherwise(gaps).alias("gaps"),
        F.when(none, empty).otherwise(F.coalesce("conflict_warnings", empty)).alias("conflict_warnings"),
        F.col("no").alias("should_refuse"),
    )


# --- answers --------------------------------------------------------------------------------------------------------------------


def is_overview_question(c: Column) -> Column:
    norm = T.collapse(F.lower(c))
    hit = F.lit(False)
    for p in V.OVERVIEW_PHRASES:
        hit = hit | norm.contains(p)
    return hit | (norm.startswith("what is ") & norm.endswith(" about") & (F.size(T.words(F.regexp_replace(norm, r"[?.!]+\z", ""))) <= 8))


def intent_boost(q: Column, sentence: Column, heading_terms: Column) -> Column:
    low = F.lower(sentence)
    asks = lambda w: F.arrays_overlap(q, T.lit_array(w))

    def any_of(w: list[str]) -> Column:
        out = F.lit(False)
        for x in w:
            out = out | low.contains(x)
        return out

    add = lambda c, x: F.when(c, x).otherwise(0.0)
    return (
        add(asks(V.TIME_TERMS) & low.rlike(r"(?Ud)\bwithin\b.*\b\d+\b.*\bday"), 3.0)
        + add(asks(V.TIME_TERMS) & low.rlike(r"(?Ud)\b\d+\b.*\bday"), 1.0)
        + add(asks(V.STEP_TERMS) & any_of(V.STEP_WORDS), 2.0)
        + add(asks(V.LIMIT_TERMS) & F.arrays_overlap(heading_terms, T.lit_array(V.LIMIT_HEADINGS)), 4.0)
        + add(asks(V.LIMIT_TERMS) & any_of(V.LIMIT_WORDS), 2.0)
    )


def best_sentences(evidence: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """qid, n, sentence (with its citation): the best sentences of the first four chunks."""
    e = evidence.where("rank <= 4").join(queries.select("qid", "question"), "qid")
    s = e.select("qid", "rank", "score", cite().alias("citation"), F.array_distinct(T.answer_terms(F.col("question"))).alias("q"), F.posexplode(T.answer_records(F.col("text"))).alias("i", "r"))
    s = s.withColumn("h", T.answer_terms(F.col("r.heading"))).withColumn("t", T.answer_terms(F.col("r.sentence")))
    overlap, over_head = F.size(F.array_intersect("q", "t")), F.size(F.array_intersect("q", "h"))
    domain = F.array_except("q", T.lit_array(V.INTENT_TERMS))
    s = s.where((F.size(domain) == 0) | (F.size(F.array_intersect(domain, F.concat("t", "h"))) > 0)).where((F.size("q") == 0) | (overlap > 0) | (over_head > 0))
    points = overlap * 3 + over_head * 3 + intent_boost(F.col("q"), F.col("r.sentence"), F.col("h")) + F.col("score") - (F.col("rank") - 1) * 0.5 - F.col("i") * 0.05
    s = s.withColumn("points", points).where(F.size(T.words(F.col("r.sentence"))) >= 5)
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("points", 9).desc(), "rank", "i"))
    return s.withColumn("n", n).where(F.col("n") <= most).select("qid", "n", F.concat(F.col("r.sentence"), F.lit(" ("), "citation", F.lit(")")).alias("sentence"))


def action_items(evidence: DataFrame) -> DataFrame:
    """qid, answer: up to eight sentences with an action word, else three excerpts."""
    s = evidence.select("qid", "rank", cite().alias("citation"), F.posexplode(T.answer_records(F.col("text"))).alias("i", "r"))
    hit = F.lit(False)
    for w in V.ACTION_WORDS:
        hit = hit | F.lower("r.sentence").contains(w)
    line = F.concat(F.lit("- "), T.strip(F.col("r.sentence")), F.lit(" ("), F.col("citation"), F.lit(")"))
    items = listed(s.where(hit), ["qid"], ["rank", "i"], line, "items", 8)
    plain = listed(evidence.where("rank <= 3"), ["qid"], ["rank"], F.concat(F.lit("- "), T.shorten(F.col("text"), 240), F.lit(" ("), cite(), F.lit(")")), "plain")
    out = plain.join(items, "qid", "left")
    return out.select("qid", F.when(F.col("items").isNotNull(), F.concat(F.lit("Action items found:\n"), F.array_join("items", "\n"))).otherwise(F.concat(F.lit("No clear action items were found. Relevant evidence:\n"), F.array_join("plain", "\n"))).alias("answer"))


def local_answers(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """queries: qid, question, mode. qid, answer in the query's mode, from the evidence alone."""
    short = lambda n: T.shorten(F.col("text"), n)
    e = evidence.withColumn("citation", cite())
    parts = e.groupBy("qid").agg(
        *[
            F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", v.alias("v"))))), lambda x: x["v"]).alias(name)
            for name, k, v in (
                ("lines", 4, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "citation", F.lit(": "), short(420))),
                ("mail", 3, short(180)),
                ("talk", 3, F.concat(F.lit("- "), short(260), F.lit(" ("), F.col("citation"), F.lit(")"))),
                ("plain", 5, F.concat(short(220), F.lit(" ("), "citation", F.lit(")"))),
            )
        ]
    )
    best = listed(best_sentences(evidence, queries, 5), ["qid"], ["n"], F.col("sentence"), "best")
    a = queries.select("qid", "question", "mode").join(parts, "qid", "left").join(best, "qid", "left").join(action_items(evidence).withColumnRenamed("answer", "actions"), "qid", "left")
    chosen = lambda n: F.when(F.col("best").isNotNull(), F.slice("best", 1, n)).otherwise(F.slice("plain", 1, n))
    dashed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    mode = F.col("mode")
    answer = (
        F.when(F.col("lines").isNull(), V.NO_EVIDENCE)
        .when(mode == "Bullet Summary", F.concat(F.lit("Direct answer:\n"), dashed(chosen(5)), F.lit("\n\nEvidence:\n"), dashed(F.col("lines"))))
        .when(mode == "Action Items", F.col("actions"))
        .when(
            mode == "Email Draft",
            F.concat(
                F.lit("Subject: Question About Document Details\n\nHello,\n\nI reviewed the available document evidence related to: "),
                "question",
                F.lit("\n\nThe relevant document text appears to say: "),
                F.array_join("mail", " "),
                F.lit("\n\nCould you please confirm whether this interpretation is correct and whether any additional details apply?\n\nThank you."),
            ),
        )
        .when(mode == "Study Notes", F.concat(F.lit("Study notes:\n"), dashed(F.col("lines"))))
        .when(
            mode == "Interview Prep",
            F.concat(
                F.lit("Talking points:\n"),
                F.array_join("talk", "\n"),
                F.lit("\n\nPossible follow-up questions:\n- What source supports the answer to '"),
                "question",
                F.lit("'?\n- What exceptions or edge cases are mentioned?\n- What information is not covered by the documents?"),
            ),
        )
        .otherwise(F.concat(F.lit("Direct answer: "), F.array_join(chosen(3), " "), F.lit("\n\nEvidence:\n"), F.array_join("lines", "\n\n")))
    )
    return a.select("qid", answer.alias("answer"))


def overview_answers(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """queries: qid. qid, answer: one line for each of the first six chunks."""
    line = F.concat(F.lit("- **"), "source", F.lit("**: "), T.shorten(T.first_informative(F.col("text")), 260))
    rows = listed(evidence.where("rank <= 6"), ["qid"], ["rank"], line, "lines")
    n = evidence.groupBy("qid").agg(F.count_distinct("source").alias("n"))
    a = queries.select("qid").join(rows, "qid", "left").join(n, "qid", "left")
    text = F.concat(
        F.lit("The indexed "),
        F.when(F.col("n") == 1, "document").otherwise("documents"),
        F.lit(" appear to be about these main topics:\n\n"),
        F.array_join("lines", "\n"),
        F.lit("\n\nThis is an overview based on representative indexed chunks. Ask a more specific question for a more precise answer."),
    )
    return a.select("qid", F.when(F.col("lines").isNull(), V.NO_OVERVIEW).otherwise(text).alias("answer"))


def context(evidence: DataFrame) -> DataFrame:
    """qid, context: numbered evidence with citations and relevance, for a generating provider."""
    item = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), cite(), F.format_string("\nRelevance: %.3f\n", F.col("score")), F.col("text"))
    return listed(evidence, ["qid"], ["rank"], item, "items").select("qid", F.array_join("items", "\n\n").alias("context"))


def citation_cards(evidence: DataFrame) -> DataFrame:
    """What a reader sees of each piece of evidence: number, source, location, relevance, excerpt."""
    place = F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise(F.concat(F.lit("Chunk "), (F.col("chunk_index") + 1).cast("string")))
    return evidence.select("qid", F.col("rank").alias("number"), "source", place.alias("location"), F.round("score", 2).alias("relevance"), T.supporting_excerpt(F.col("text")).alias("excerpt"))
