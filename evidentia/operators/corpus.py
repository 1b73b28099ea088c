"""Reports over the corpus: health, freshness, suggested questions, query rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V
from evidentia.functions import text as T


def health(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row. docs: doc_ord, source, page, text."""
    terms = T.health_terms(F.col("text"))
    d = docs.select("doc_ord", "source", "page", F.length("text").alias("chars"), terms.alias("terms"))
    words = d.select("doc_ord", F.posexplode("terms").alias("pos", "term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_ord", "pos")).alias("first"))
    top = words.orderBy(F.col("n").desc(), "first").limit(8).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "term"))).alias("t"))
    top = top.select(F.transform("t", lambda x: x["term"]).alias("top_terms"))
    low = (F.col("page").isNotNull()) & (F.col("chars") < 80)
    by_doc = d.agg(
        F.count_distinct("source").alias("document_count"),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long").alias("total_words"),
        F.count_if(F.size("terms") < 40).alias("short_document_count"),
        F.array_sort(F.collect_set(F.when(low, F.col("source")))).alias("low_text_sources"),
    )
    prints = chunks.groupBy(fingerprint(F.col("text")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    by_chunk = prints.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunk_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    one = by_doc.crossJoin(by_chunk).crossJoin(top)  # one row each
    ratio = F.col("extra") / F.greatest(F.col("chunk_count"), F.lit(1))
    return one.select("document_count", "chunk_count", "total_words", ratio.alias("duplicate_ratio"), "short_document_count", "low_text_sources", "top_terms")


def fingerprint(c: Column) -> Column:
    """The first 80 terms."""
    return F.array_join(F.slice(T.health_terms(c), 1, 80), " ")


def index_freshness(uploaded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Names among the uploads (name) that the index does not have."""
    return uploaded.select(F.col("name").alias("source")).distinct().join(chunks.select("source").distinct(), "source", "left_anti").orderBy("source")


# --- suggestions ----------------------------------------------------------------------------------------------------------------


def _distinct_in_order(rows: DataFrame, value: str, order: list[str], most: int) -> DataFrame:
    """The first `most` values, compared without case, each as first seen."""
    first = rows.groupBy(F.lower(value).alias("key")).agg(F.min(F.struct(*order, value)).alias("x"))
    return first.orderBy(*[f"x.{c}" for c in order]).limit(most).select(*[F.col(f"x.{c}").alias(c) for c in order], F.col(f"x.{value}").alias(value))


def headings(chunks: DataFrame, most: int = 8) -> DataFrame:
    """Heading lines over the corpus, distinct, in order."""
    x = chunks.select("doc_ord", "chunk_index", F.posexplode(T.lines(F.col("text"))).alias("line", "raw")).withColumn("heading", T.strip_chars(F.col("raw"), r"# \-\t"))
    x = x.where(T.heading_sized(F.col("heading"), 10)).withColumn("heading", T.collapse(F.col("heading"))).where("heading <> ''")
    return _distinct_in_order(x, "heading", ["doc_ord", "chunk_index", "line"], most)


def source_names(chunks: DataFrame, most: int = 4) -> DataFrame:
    x = chunks.groupBy("source").agg(F.min(F.struct("doc_ord", "chunk_index")).alias("f")).select("f.doc_ord", "f.chunk_index", T.collapse(T.source_name(F.col("source"))).alias("name")).where("name <> ''")
    return _distinct_in_order(x, "name", ["doc_ord", "chunk_index"], most)


def key_phrases(chunks: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent pairs of neighbouring terms: phrase, n; ties to the first seen."""
    x = chunks.select("doc_ord", "chunk_index", F.posexplode(T.phrase_terms(F.col("text"))).alias("pos", "phrase"))
    x = x.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_ord", "chunk_index", "pos")).alias("first"))
    return x.orderBy(F.col("n").desc(), "first").limit(most)


def suggestions(chunks: DataFrame, most: int = 5) -> DataFrame:
    """pos, question."""

    def ordered(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias(name))

    one = ordered(headings(chunks), ["doc_ord", "chunk_index", "line"], "heading", "h").crossJoin(ordered(source_names(chunks), ["doc_ord", "chunk_index"], "name", "s"))
    one = one.crossJoin(ordered(key_phrases(chunks).withColumn("m", -F.col("n")), ["m", "first"], "phrase", "p")).crossJoin(chunks.limit(1).agg(F.count(F.lit(1)).alias("some")))  # one row each
    h, h2, s, p = F.get("h", F.lit(0)), F.get("h", F.lit(1)), F.get("s", F.lit(0)), F.get("p", F.lit(0))
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])  # noqa: E731  null where a part is
    own = F.array(say("What is the purpose of ", s, "?"), say("What should I know about ", h, "?"), say("How are ", h, " and ", h2, " related?"), say("What requirements or steps are mentioned for ", p, "?"), *[F.lit(q) for q in V.LAST_QUESTIONS])
    questions = F.when(F.col("some") == 0, T.lit_array(V.FALLBACK_QUESTIONS)).otherwise(dedupe_questions(F.array_compact(own)))
    return one.select(F.posexplode(F.slice(questions, 1, most)).alias("pos", "question"))


def dedupe_questions(c: Column) -> Column:
    """Stripped, with a question mark, distinct without case, in order."""
    marked = F.transform(F.filter(F.transform(c, T.strip), lambda q: q != ""), lambda q: F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))))
    return F.aggregate(marked, F.array().cast("array<string>"), lambda acc, q: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(q)), acc).otherwise(F.concat(acc, F.array(q))))


# --- rewriting ------------------------------------------------------------------------------------------------------------------


def looks_vague(c: Column) -> Column:
    t = T.raw_tokens(c)
    return (F.size(t) <= 4) | F.arrays_overlap(t, T.lit_array(V.VAGUE_TERMS))


def subjects(chunks: DataFrame) -> DataFrame:
    """cand, terms, weight, uses, place: possible subjects in the first eight chunks: source names (weight 1) and heading lines (3)."""
    first = chunks.orderBy("doc_ord", "chunk_index").limit(8)
    names = first.select("doc_ord", "chunk_index", F.lit(-1).alias("line"), T.source_name(F.col("source")).alias("cand"), F.lit(1).alias("weight"))
    lines = first.select("doc_ord", "chunk_index", F.posexplode(T.lines(F.col("text"))).alias("line", "raw")).select("doc_ord", "chunk_index", "line", T.strip_chars(F.col("raw"), r"# \-\t").alias("cand"), F.lit(3).alias("weight"))
    lines = lines.where(T.heading_short(F.col("cand"), 10))
    return names.unionByName(lines).where("cand <> ''").select("cand", F.array_distinct(T.rewrite_terms(F.col("cand"))).alias("terms"), "weight", F.struct("doc_ord", "chunk_index", "line").alias("place"))


def rewrite(queries: DataFrame, chunks: DataFrame, enabled: bool = True) -> DataFrame:
    """qid, rewritten: the collapsed question; a vague one gets the best subject of the first chunks."""
    q = queries.select("qid", T.collapse(F.col("question")).alias("question"))
    if not enabled:
        return q.select("qid", F.col("question").alias("rewritten"))
    q = q.withColumn("terms", F.array_except(F.array_distinct(T.rewrite_terms(F.col("question"))), T.lit_array(V.VAGUE_TERMS)))
    s = subjects(chunks).select("cand", F.col("terms").alias("own"), "weight", "place")
    # the subjects of eight chunks: a small set of fixed origin for every query
    pairs = q.where((F.col("question") != "") & looks_vague(F.col("question"))).join(F.broadcast(s), F.arrays_overlap("terms", "own"))
    scored = pairs.groupBy("qid", "cand").agg(F.sum(F.size(F.array_intersect("terms", "own")) * F.col("weight")).alias("points"), F.min("place").alias("place"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("points").desc(), "place"))
    scored = scored.withColumn("n", best).where("n = 1 AND points >= 2").select("qid", "cand")
    out = q.join(scored, "qid", "left")
    use = F.col("cand").isNotNull() & ~F.lower("question").contains(F.lower("cand"))
    return out.select("qid", F.when(use, F.concat("question", F.lit(" in "), "cand")).otherwise(F.col("question")).alias("rewritten"))


def clean_rewrite(raw: Column, original: Column) -> Column:
    """A provider's rewrite, unquoted, its first line; the original if it is empty or over 220 characters."""
    c = T.strip_chars(T.strip_chars(T.strip(raw), '"'), "'")
    c = T.strip(F.regexp_replace(c, rf"(?i)\Arewritten query:{T.WS}*", ""))
    c = T.strip(F.coalesce(F.get(T.lines(c), F.lit(0)), F.lit("")))
    return F.when((c == "") | (F.length(c) > 220), original).otherwise(c)


# --- replies of providers -------------------------------------------------------------------------------------------------------


def extract_json(raw: Column) -> Column:
    """The JSON object of a reply, out of a fence or of other words; null if there is none."""
    c = T.strip(raw)
    c = F.when(c.startswith("```"), T.strip(F.regexp_replace(T.strip(F.regexp_replace(c, r"(?i)\A```(?:json)?", "")), r"```\z", ""))).otherwise(c)
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(c.startswith("{"), c).when(found != "", found)


def parse_conflicts(raw: Column) -> Column:
    """The conflicts of a reply as sentences; those without a reason are left out."""
    fields = "claim_a", "source_a", "claim_b", "source_b", "why_conflict", "severity"
    data = F.from_json(extract_json(raw), "conflicts array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")

    def sentence(x: Column) -> Column:
        get = lambda f, d="": T.strip(F.coalesce(x[f], F.lit(d)))
        return F.concat(F.initcap(F.lower(get("severity", "medium"))), F.lit(" conflict: "), get("source_a", "source A"), F.lit(" says '"), get("claim_a"), F.lit("', while "), get("source_b", "source B"), F.lit(" says '"), get("claim_b"), F.lit("'. "), get("why_conflict"))

    rows = F.filter(F.coalesce(data["conflicts"], F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")), lambda x: T.strip(F.coalesce(x["why_conflict"], F.lit(""))) != "")
    return F.transform(rows, sentence)


def parse_questions(raw: Column) -> Column:
    data = F.from_json(extract_json(raw), "questions array<string>")
    return dedupe_questions(F.coalesce(data["questions"], F.array().cast("array<string>")))
