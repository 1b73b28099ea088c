"""One query for each operator, over whole tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import sql_forms as S
from evidentia.functions import fixed_values as V
from evidentia.functions import text as T
from evidentia.functions.tables import materialize, spread
from evidentia.operators import chunking, corpus, evidence, graph, guard, providers, retrieval
from evidentia.plans import pipeline
from evidentia.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- inputs ---------------------------------------------------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_ord, source, page, text: each row of documents as a document with a name of its own."""
    t = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text"))
    return t.select(F.col("doc_id").alias("doc_ord"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.lit(None).cast("int").alias("page"), T.clean_text(F.col("text")).alias("text"))


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    return materialize(chunking.split_documents(documents(spark, d)), "chunks", compact=True)


MODES = list(V.ANSWER_MODES)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item as a question; modes in turn."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    mode = F.element_at(T.lit_array(MODES), (F.col("item_id") % 7 + 1).cast("int"))
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), mode.alias("mode"))


def inline_evidence(spark: SparkSession) -> DataFrame:
    rows = [(q, r, f"{src}#{i}", q, src, None, i, text, score) for q, r, src, i, score, text in S.EVIDENCE]
    return spark.createDataFrame(rows, "qid long, rank int, chunk_id string, doc_ord long, source string, page int, chunk_index int, text string, score double")


def inline_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.QUESTIONS, "qid long, question string, mode string")


def all_questions(spark: SparkSession, d: str) -> DataFrame:
    """The inline questions and, shifted by 1000, the user turns of conversations by number."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    turns = turns.select((F.lit(1000) + F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.col("text").alias("question"), F.lit("Simple Answer").alias("mode"))
    return inline_questions(spark).unionByName(turns)


ALL_QUESTIONS = "(SELECT qid, question, mode FROM fq UNION ALL SELECT 1000 + conv_id * 100 + turn, text, 'Simple Answer' FROM conversations WHERE role = 'user')"


def hits(spark: SparkSession, d: str, k: int = V.POOL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, questions, the k best chunks of each question."""
    chunks = chunk_table(spark, d)
    q = questions(spark, d)
    return chunks, q, materialize(retrieval.search(retrieval.build_index(chunks, write=True), q, k), "hits")


def selected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks, q, h = hits(spark, d)
    return q, materialize(retrieval.select_evidence(h, chunks, q), "evidence")


def digest(c: Column) -> Column:
    return F.md5(F.array_join(c, "\n").cast("binary"))


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# --- text -----------------------------------------------------------------------------------------------------------------------


@query(S.statement("SELECT doc_ord AS doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM docs", "docs"))
def clean_text(spark, d):
    return documents(spark, d).select(F.col("doc_ord").alias("doc_id"), F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    S.statement(
        f"""SELECT doc_ord AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {S.h_short('y', 9)}) AS h1, count(*) FILTER (WHERE {S.h2('y')}) AS h2, count(*) FILTER (WHERE {S.h_short('y', 10)}) AS h3,
  count(*) FILTER (WHERE {S.h_sized('y')}) AS h4, count(*) FILTER (WHERE {S.h_sized('y', 10)}) AS h5 FROM (SELECT doc_ord, unnest({S.lines('text')}) AS y FROM docs) z GROUP BY doc_ord""",
        "docs",
    )
)
def heading_tests(spark, d):
    count = lambda f: F.size(F.filter("l", f)).cast("long")
    l = documents(spark, d).select(F.col("doc_ord").alias("doc_id"), T.lines(F.col("text")).alias("l"))  # noqa: E741
    return l.where(F.size("l") > 0).select(
        "doc_id",
        F.size("l").cast("long").alias("n_lines"),
        count(lambda x: T.heading_short(x, 9)).alias("h1"),
        count(T.heading_marked).alias("h2"),
        count(lambda x: T.heading_short(x, 10)).alias("h3"),
        count(lambda x: T.heading_sized(x)).alias("h4"),
        count(lambda x: T.heading_sized(x, 10)).alias("h5"),
    )


_TOKENS = {"t1": S.t1, "t2": S.t2, "t3": S.t3, "t4": S.t4, "t5": S.t5, "t6": S.t6, "t7": S.t7, "t8": S.t8, "t9": S.t9, "t10": S.raw_tokens}


@query(S.statement("SELECT doc_ord AS doc_id, " + ", ".join(f"md5(array_to_string({f('text')}, chr(10))) AS {n}" for n, f in _TOKENS.items()) + " FROM docs", "docs"))
def tokenizers(spark, d):
    t = F.col("text")
    forms = {"t1": retrieval._index_tokens, "t2": T.rerank_terms, "t3": T.guard_terms, "t4": T.graph_terms, "t5": T.trust_terms, "t6": T.answer_terms, "t7": T.rewrite_terms, "t8": T.health_terms, "t9": T.phrase_terms, "t10": T.raw_tokens}
    return documents(spark, d).select(F.col("doc_ord").alias("doc_id"), *[digest(f(t)).alias(n) for n, f in forms.items()])


S.CTES.update(
    {
        "sl0": (("docs",), f"SELECT doc_ord, i, y, {S.unmarked('y')} AS body FROM (SELECT doc_ord, unnest({S.lines('text')}) AS y, generate_subscripts({S.lines('text')}, 1) AS i FROM docs) z"),
        "sl1": (("sl0",), f"SELECT *, {S.h_short('body', 9)} AS is2, {S.h2('y')} AS is3 FROM sl0 WHERE body <> ''"),
        "sl": (
            ("sl1",),
            f"""SELECT doc_ord, i, y, body, is2, is3, coalesce(last_value(CASE WHEN is2 THEN body END IGNORE NULLS) OVER (PARTITION BY doc_ord ORDER BY i), '') AS head2,
  coalesce(last_value(CASE WHEN is3 THEN body END IGNORE NULLS) OVER (PARTITION BY doc_ord ORDER BY i), '') AS head3, {S.sentences('body')} AS z FROM sl1""",
        ),
        "sj": (("sl",), "SELECT * EXCLUDE (z), unnest(z) AS z, generate_subscripts(z, 1) AS j FROM sl"),
    }
)


@query(
    S.statement(
        f"""SELECT d.doc_ord AS doc_id, md5(array_to_string({S.sentences('text')}, chr(10))) AS s1, coalesce(v2, md5(array_to_string(list_transform({S.sentences('text')}, lambda q: '|' || q), chr(10)))) AS s2,
  coalesce(v3, md5(array_to_string(list_transform({S.sentences('text')}, lambda q: '|' || q), chr(10)))) AS s3, coalesce(v4, md5(array_to_string({S.sentences('text')}, chr(10)))) AS s4, coalesce(v5, md5('')) AS s5
FROM docs d LEFT JOIN (
  SELECT doc_ord, md5(string_agg(head2 || '|' || z, chr(10) ORDER BY i, j) FILTER (WHERE NOT is2)) AS v2, md5(string_agg(head3 || '|' || z, chr(10) ORDER BY i, j) FILTER (WHERE NOT is3)) AS v3,
    md5(string_agg(z, chr(10) ORDER BY i, j) FILTER (WHERE (NOT is3 OR {S.instruction_like('body')}) AND len({S.words('z')}) >= 3)) AS v4,
    md5(string_agg(z, chr(10) ORDER BY i, j) FILTER (WHERE NOT is2 AND len({S.words('z')}) >= 4)) AS v5 FROM sj GROUP BY doc_ord) s USING (doc_ord)""",
        "docs",
        "sj",
    )
)
def sentence_splitters(spark, d):
    t = F.col("text")
    rec = lambda c: digest(F.transform(c, lambda x: F.concat_ws("|", x["heading"], x["sentence"])))
    return documents(spark, d).select(
        F.col("doc_ord").alias("doc_id"), digest(T.sentences(t)).alias("s1"), rec(T.answer_records(t)).alias("s2"), rec(T.compress_records(t)).alias("s3"), digest(T.guard_sentences(t)).alias("s4"), digest(T.readable_sentences(t)).alias("s5")
    )


@query(
    S.statement(
        f"SELECT doc_ord AS doc_id, {S.shorten('text', 120)} AS short, {S.shorten(f'coalesce(list_filter(list_transform(list_filter(string_split(replace(text, chr(10), chr(46) || chr(32)), chr(46)), lambda p: {S.strip('p')} <> {S.s('')}), lambda p: {S.strip(S.strip_chars('p', '# '))}), lambda p: len({S.words('p')}) >= 6)[1], text)', 260)} AS informative FROM docs",
        "docs",
    )
)
def excerpts(spark, d):
    t = F.col("text")
    return documents(spark, d).select(F.col("doc_ord").alias("doc_id"), T.shorten(t, 120).alias("short"), T.shorten(T.first_informative(t), 260).alias("informative"))


@query(S.statement(f"SELECT doc_ord AS doc_id, {S.excerpt('text')} AS excerpt FROM docs", "docs"))
def supporting_excerpts(spark, d):
    t = F.col("text")
    return documents(spark, d).select(F.col("doc_ord").alias("doc_id"), T.supporting_excerpt(t).alias("excerpt"))


@query(f"SELECT i, {S.highlight('x')} AS answer FROM (SELECT unnest([{', '.join(S.s(x) for x in S.FACTS)}]) AS x, generate_subscripts([{', '.join(S.s(x) for x in S.FACTS)}], 1) - 1 AS i UNION ALL SELECT text, 100 + doc_id FROM documents) z")
def highlight(spark, d):
    inline = spark.createDataFrame(list(enumerate(S.FACTS)), "i long, x string")
    rows = inline.unionByName(spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") + 100).alias("i"), F.col("text").alias("x")))
    return rows.select("i", T.highlight(F.col("x")).alias("answer"))


# --- chunks and index -----------------------------------------------------------------------------------------------------------


@query(S.statement("SELECT chunk_id, doc_ord AS doc_id, source, chunk_index, length(text) AS n_chars, md5(text) AS text_md5, source || ', chunk ' || (chunk_index + 1) AS citation FROM chunks", "chunks"))
def chunk_documents(spark, d):
    c = chunking.split_documents(documents(spark, d))
    return c.select("chunk_id", F.col("doc_ord").alias("doc_id"), "source", "chunk_index", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), evidence.cite().alias("citation"))


@query(S.statement(f"SELECT doc_ord AS doc_id, len(h) AS n, md5(array_to_string(h, chr(10))) AS windows_md5 FROM (SELECT doc_ord, {S._hard('text')} AS h FROM docs) z", "docs"))
def hard_split(spark, d):
    h = documents(spark, d).select(F.col("doc_ord").alias("doc_id"), chunking.hard_split(F.col("text")).alias("h"))
    return h.select("doc_id", F.size("h").cast("long").alias("n"), digest(F.col("h")).alias("windows_md5"))


@query(S.statement("SELECT term, df, round(idf, 6) AS idf FROM idf", "idf"))
def tfidf_idf(spark, d):
    return retrieval.build_index(chunk_table(spark, d)).idf.select("term", "df", r6("idf"))


@query(S.statement("SELECT qid, rank, chunk_id, source || ', chunk ' || (chunk_index + 1) AS citation, round(score, 6) AS score FROM bhits WHERE rank <= 6", "bhits"))
def tfidf_topk(spark, d):
    _, _, h = hits(spark, d, 6)
    return h.select("qid", "rank", "chunk_id", evidence.cite().alias("citation"), r6("score"))


@query(
    """SELECT qid, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT q.vec_id AS qid, v.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) s WHERE score > 0) r WHERE rank <= 6"""
)
def dense_topk(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    return providers.dense_search(v, q, 6).select("qid", "rank", "id", r6("score"))


@query(S.statement("SELECT qid, cand_ord, chunk_id, round(score, 6) AS score FROM bcand", "bcand"))
def adjacent_context(spark, d):
    chunks, _, h = hits(spark, d)
    return retrieval.add_adjacent(h, chunks).select("qid", "cand_ord", "chunk_id", r6("score"))


@query(S.statement("SELECT qid, rank, chunk_id, round(base, 6) AS base, round(lexical, 6) AS lexical, round(structure, 6) AS structure, round(score, 6) AS score FROM brr", "brr"))
def rerank(spark, d):
    chunks, q, h = hits(spark, d)
    return retrieval.rerank(retrieval.add_adjacent(h, chunks), q).select("qid", "rank", "chunk_id", r6("base"), r6("lexical"), r6("structure"), r6("score"))


@query(S.statement("SELECT qid, rank, chunk_id, round(score, 6) AS score FROM bsel", "bsel"))
def adaptive_select(spark, d):
    chunks, q, h = hits(spark, d)
    return retrieval.select_evidence(h, chunks, q).select("qid", "rank", "chunk_id", r6("score"))


@query(S.statement("SELECT row_number() OVER (ORDER BY f DESC, doc_ord, chunk_index) AS rank, chunk_id, CASE WHEN f = 1 THEN 0.82 ELSE 0.72 END::DOUBLE AS score FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_ord, chunk_index) = 1)::INT AS f FROM chunks) z ORDER BY rank LIMIT 6", "chunks"))
def overview_topk(spark, d):
    return retrieval.overview(chunk_table(spark, d)).select("rank", "chunk_id", "score")


@query(
    S.statement(
        "SELECT b.qid, bool_or(coalesce(h.source = r.source, false)) AS hit FROM bq b JOIN (SELECT item_id AS qid, d.source || '/' || d.doc_id AS source FROM benchmark b JOIN documents d ON contains(d.text, b.text)) r USING (qid) LEFT JOIN bhits h ON h.qid = b.qid AND h.rank <= 6 GROUP BY b.qid",
        "bq",
        "bhits",
    )
)
def retrieval_hit_at_k(spark, d):
    _, q, h = hits(spark, d, 6)
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), "text")
    return retrieval.hit_at_k(h, retrieval.holding(docs, b), 6)


# --- graph ----------------------------------------------------------------------------------------------------------------------


def _entities_sql(table: str, key: str) -> str:
    norm = S.graph_norm("p")
    phrase = S.s(r"(?:^|[^\p{L}\p{N}_])(" + V.CAPITAL_PHRASE + ")")
    head = S.strip_chars("y", r"# \-\t")
    phrases = f"list_filter(list_transform(regexp_extract_all(text, {phrase}, 1), lambda p: {norm}), lambda e: length(e) >= 4 AND NOT list_contains({S.arr(V.STOP_GRAPH)}, e) AND NOT regexp_full_match(e, '[0-9]+'))"
    heads = f"flatten(list_transform(list_filter(list_transform({S.lines('text')}, lambda y: {head}), lambda y: {S.h_sized('y')}), lambda y: {S.t4('y')}))"
    return f"""SELECT {key}, entity, weight, pos FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY weight DESC, pos) AS n FROM (
  SELECT {key}, m.e AS entity, sum(m.w) AS weight, min(i) AS pos FROM (
    SELECT {key}, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
      SELECT {key}, list_concat(list_transform({heads}, lambda e: {{'e': e, 'w': 4}}), list_transform({phrases}, lambda e: {{'e': e, 'w': 3}}), list_transform({S.t4('text')}, lambda e: {{'e': e, 'w': 1}})) AS ms FROM {table}) z) y GROUP BY ALL) x) w WHERE n <= 14"""


S.CTES.update(
    {
        "ce": (("chunks",), f"SELECT e.*, doc_ord, chunk_index FROM ({_entities_sql('chunks', 'chunk_id')}) e JOIN chunks USING (chunk_id)"),
        "edges": (
            ("ce",),
            """SELECT src, dst, weight, f.d AS first_doc, f.c AS first_chunk FROM (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight, min({'d': a.doc_ord, 'c': a.chunk_index}) AS f
FROM ce a JOIN ce b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity GROUP BY ALL) z""",
        ),
        "near": (("edges",), "SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, first_doc, first_chunk, dst) AS n FROM edges"),
    }
)


def _graph_chain(p: str, q: str, found: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """CTEs from questions (qid, question) and their hits to the hits with the graph's boosts; p is the prefix of their names."""
    return {
        f"{p}q": ((q,), f"SELECT qid, question AS text, {S.graph_norm('question')} AS norm FROM {q}"),
        f"{p}m": (
            (f"{p}q", "ce", found),
            f"SELECT DISTINCT g.qid, e.entity FROM (SELECT * FROM {p}q WHERE qid IN (SELECT qid FROM {found})) g JOIN (SELECT DISTINCT entity FROM ce) e ON contains(g.norm, e.entity) UNION SELECT qid, entity FROM ({_entities_sql(f'{p}q', 'qid')}) o WHERE entity IN (SELECT entity FROM ce) AND qid IN (SELECT qid FROM {found})",
        ),
        f"{p}b": (
            (f"{p}m", "near", "ce", found),
            f"""SELECT qid, entity, 0.18::DOUBLE AS boost FROM {p}m UNION ALL SELECT qid, dst, least(0.10, 0.025 * weight) FROM {p}m JOIN near ON src = entity AND n <= 6
UNION ALL SELECT qid, dst, least(0.06, 0.015 * near.weight) FROM {found} JOIN ce USING (chunk_id) JOIN near ON src = entity AND n <= 4 WHERE rank <= 3""",
        ),
        f"{p}x": (
            (f"{p}b", "ce", found, "chunks"),
            f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, br NULLS LAST, doc_ord, chunk_index) AS rank, chunk_id, least(score, 1.0) AS score FROM (
  SELECT qid, chunk_id, sum(part) AS score, min(rank) AS br FROM (SELECT qid, chunk_id, score AS part, rank FROM {found} UNION ALL SELECT qid, chunk_id, boost, NULL FROM {p}b JOIN ce USING (entity)) u GROUP BY ALL) z JOIN chunks USING (chunk_id)""",
        ),
    }


S.CTES.update(_graph_chain("g", "bq", "bhits"))


@query(S.statement("SELECT chunk_id, entity, weight FROM ce", "ce"))
def chunk_entities(spark, d):
    return graph.entities(chunk_table(spark, d), ["chunk_id"], "text").select("chunk_id", "entity", "weight")


@query(S.statement("SELECT src, dst, weight FROM edges WHERE src < dst", "edges"))
def entity_edges(spark, d):
    return graph.build_graph(chunk_table(spark, d)).edges.where("src < dst").select("src", "dst", "weight")


@query(S.statement("SELECT (SELECT count(DISTINCT entity) FROM ce) AS entity_count, (SELECT count(*) FROM edges WHERE src < dst) AS edge_count", "ce", "edges"))
def graph_size(spark, d):
    return graph.graph_size(graph.build_graph(chunk_table(spark, d), write=True))


@query(S.statement("SELECT qid, rank, chunk_id, round(score, 6) AS score FROM gx WHERE rank <= 24", "gx"))
def graph_expand(spark, d):
    chunks, q, h = hits(spark, d)
    return graph.enhance(h, q, graph.build_graph(chunks, write=True), V.POOL).select("qid", "rank", "chunk_id", r6("score"))


# --- guard ----------------------------------------------------------------------------------------------------------------------


def _similar_sql(records: str) -> str:
    """records: qid, ord, text. qid, ord, sim, example."""
    attacks = ", ".join(f"({i}, {S.s(a)})" for i, a in enumerate(V.ATTACKS))
    return f"""SELECT qid, ord, sim, example FROM (SELECT *, row_number() OVER (PARTITION BY qid, ord ORDER BY round(sim, 9) DESC, attack) AS b FROM (
  SELECT r.qid, r.ord, a.attack, any_value(a.example) AS example, sum(r.w * a.w) / (any_value(r.norm) * any_value(a.norm)) AS sim FROM
    (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY qid, ord)) AS norm FROM (SELECT qid, ord, term, tf / total * idf AS w FROM r_tf JOIN r_idf USING (qid, term)) z) r
    JOIN (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY qid, attack)) AS norm FROM (SELECT qid, attack, example, term, tf / total * idf AS w FROM a_tf JOIN r_idf USING (term)) z) a USING (qid, term) GROUP BY ALL) y) x WHERE b = 1""", f"""
r_in AS MATERIALIZED ({records}), r_n AS (SELECT qid, count(*) + 10 AS n FROM r_in GROUP BY qid),
r_tf AS MATERIALIZED (SELECT qid, ord, total, term, count(*) AS tf FROM (SELECT qid, ord, len({S.t3('text')}) AS total, unnest({S.t3('text')}) AS term FROM r_in) z GROUP BY ALL),
a_tf AS MATERIALIZED (SELECT attack, example, total, term, count(*) AS tf FROM (SELECT attack, example, len({S.t3('example')}) AS total, unnest({S.t3('example')}) AS term FROM (VALUES {attacks}) AS v(attack, example)) z GROUP BY ALL),
r_idf AS MATERIALIZED (SELECT qid, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM (SELECT qid, term FROM r_tf UNION ALL SELECT qid, term FROM r_n, a_tf) u JOIN r_n USING (qid) GROUP BY qid, term, n)"""


def _question_sql(final: str, table: str = ALL_QUESTIONS, *needs: str) -> str:
    like = f"SELECT qid, 0 AS ord, text FROM qf WHERE rule IS NULL AND {S.instruction_like('text')}"
    best, ctes = _similar_sql(like)
    rules = S.first_reason("question", V.RULES)
    user = S.first_reason("question", V.USER_RULES)
    base = S.statement("", "fq", *needs)
    return f"""{base.rstrip()}, qf AS MATERIALIZED (SELECT qid, question AS text, mode, {user} AS usr, {rules} AS rule FROM {table} q), {ctes},
sim AS ({best}),
found AS MATERIALIZED (SELECT qid, coalesce(usr, rule, CASE WHEN sim >= 0.34 THEN 'Semantically similar to prompt-injection behavior: ' || example END) AS reason, CASE WHEN usr IS NOT NULL THEN 0.98 WHEN rule IS NOT NULL THEN 0.96 ELSE round(sim, 3) END::DOUBLE AS score,
  CASE WHEN usr IS NOT NULL THEN 'user rule' WHEN rule IS NOT NULL THEN 'rule' ELSE 'local semantic' END AS detector FROM qf LEFT JOIN sim USING (qid))
{final}"""


@query(_question_sql("SELECT * FROM found WHERE reason IS NOT NULL"))
def question_findings(spark, d):
    return guard.question_findings(all_questions(spark, d))


_REFUSE = f"""SELECT q.qid, CASE WHEN reason IS NULL THEN false WHEN usr IS NOT NULL THEN true WHEN {S.question_intent('text')} THEN false
  ELSE len(list_filter({S.t3('text')}, lambda y: NOT list_contains({S.arr(V.CONTROL_TERMS)}, y))) <= 1 END AS refuse FROM qf q LEFT JOIN found USING (qid)"""


@query(_question_sql(_REFUSE))
def refuse_user(spark, d):
    return guard.refuse(all_questions(spark, d))


@query(S.statement(f"SELECT qid, {S.overview_question('question')} AS overview, {S.vague('question')} AS vague, {S.question_intent('question')} AS intent, {S.instruction_like('question')} AS instruction, {S.should_compress('question', 'mode')} AS compress, {S.condition('question')} AS condition FROM {ALL_QUESTIONS} q", "fq"))
def question_flags(spark, d):
    q, m = F.col("question"), F.col("mode")
    return all_questions(spark, d).select(
        "qid", evidence.is_overview_question(q).alias("overview"), corpus.looks_vague(q).alias("vague"), guard.has_question_intent(q).alias("intent"), T.instruction_like(q).alias("instruction"), evidence.should_compress(q, m).alias("compress"), T.has_condition(q).alias("condition")
    )


def _guard_input(spark: SparkSession, d: str) -> DataFrame:
    """The inline evidence, and every document as one piece of evidence of a question of its own."""
    docs = documents(spark, d).select((F.col("doc_ord") + 1000).alias("qid"), F.lit(1).alias("rank"), F.concat_ws("#", "source", F.lit("0")).alias("chunk_id"), "doc_ord", "source", "page", F.lit(0).alias("chunk_index"), "text", F.lit(0.5).alias("score"))
    return inline_evidence(spark).unionByName(docs)


def _guard_sql(final: str) -> str:
    base = S.statement("", "fe", "docs")
    like = f"SELECT qid, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord) AS n FROM rec WHERE rule IS NULL AND {S.instruction_like('text')}) z WHERE n <= 24"
    best, ctes = _similar_sql(like)
    return f"""{base.rstrip()}, ev AS MATERIALIZED (SELECT qid, rank, source || '#' || chunk_index AS chunk_id, source, chunk_index, text FROM fe UNION ALL SELECT doc_ord + 1000, 1, source || '#0', source, 0, text FROM docs),
ln0 AS MATERIALIZED (SELECT qid, rank, i, y, {S.unmarked('y')} AS body FROM (SELECT qid, rank, unnest({S.lines('text')}) AS y, generate_subscripts({S.lines('text')}, 1) AS i FROM ev) z),
ln AS MATERIALIZED (SELECT * FROM (SELECT qid, rank, i, unnest({S.sentences('body')}) AS z, generate_subscripts({S.sentences('body')}, 1) AS j FROM ln0 WHERE body <> '' AND (NOT {S.h2('y')} OR {S.instruction_like('body')})) w WHERE len({S.words('z')}) >= 3),
st AS MATERIALIZED (SELECT * FROM ln UNION ALL SELECT qid, rank, 0, z, j FROM (SELECT qid, rank, unnest({S.sentences('text')}) AS z, generate_subscripts({S.sentences('text')}, 1) AS j FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.qid = e.qid AND ln.rank = e.rank)) w),
rec AS MATERIALIZED (SELECT qid, ord, {S.CITE} AS citation, source, chunk_id, z AS text, {S.first_reason('z', V.RULES)} AS rule FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, i, j) AS ord FROM st JOIN ev USING (qid, rank)) w WHERE ord <= 36), {ctes},
sim AS ({best}),
fnd AS MATERIALIZED (SELECT * FROM (SELECT *, {S.norm_guard('text')} AS norm, row_number() OVER (PARTITION BY qid, citation, {S.norm_guard('text')} ORDER BY score DESC, ord) AS n FROM (
  SELECT qid, ord, citation, source, text, rule AS reason, 0.96::DOUBLE AS score, 'rule' AS detector FROM rec WHERE rule IS NOT NULL
  UNION ALL SELECT qid, ord, citation, source, text, 'Semantically similar to prompt-injection behavior: ' || example, round(sim, 3), 'local semantic' FROM rec JOIN sim USING (qid, ord) WHERE sim >= 0.34) u) w WHERE n = 1)
{final}"""


@query(_guard_sql("SELECT qid, citation, text, reason, score, detector FROM fnd"))
def evidence_findings(spark, d):
    records = materialize(guard.evidence_records(_guard_input(spark, d)), "records")
    return guard.evidence_findings(records).select("qid", "citation", "text", "reason", F.col("score").cast("double").alias("score"), "detector")


@query(
    _guard_sql(
        f""", blk AS (SELECT r.qid, r.chunk_id, list(DISTINCT f.norm) AS b FROM rec r JOIN fnd f ON f.qid = r.qid AND f.citation = r.citation AND f.norm = {S.norm_guard('r.text')} GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, chunk_id, text FROM (SELECT qid, rank, chunk_id, CASE WHEN b IS NULL THEN text ELSE {S.strip(f'''regexp_replace(array_to_string(list_transform(list_filter(list_transform({S.lines('text')},
  lambda y: CASE WHEN {S.strip('y')} = '' THEN '' WHEN {S.h2('y')} AND NOT list_contains(b, {S.norm_guard(S.strip('y'))}) THEN y ELSE nullif(array_to_string(list_filter({S.sentences('y')}, lambda p: NOT list_contains(b, {S.norm_guard('p')})), ' '), '') END), lambda y: y IS NOT NULL), lambda y: regexp_replace(y, '{S.WS}+$', '')), chr(10)), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')''')} END AS text
FROM ev LEFT JOIN blk USING (qid, chunk_id)) z WHERE text <> '' OR chunk_id NOT IN (SELECT chunk_id FROM blk)"""
    )
)
def guard_sanitize(spark, d):
    e = materialize(_guard_input(spark, d), "guard-evidence")
    records = materialize(guard.evidence_records(e), "records")
    return guard.sanitize(e, records, guard.evidence_findings(records)).select("qid", "rank", "chunk_id", "text")


# --- answers --------------------------------------------------------------------------------------------------------------------


def _compress_sql(ev: str, q: str) -> str:
    """Evidence (qid, rank, chunk_id, text) and questions (qid, question, mode) to compressed texts; inside a WITH."""
    lim = "CASE WHEN mode = 'Conflict Analysis' THEN 5 WHEN mode IN ('Action Items', 'Bullet Summary') THEN 4 ELSE 3 END"
    cond = S.condition("sentence")
    return f"""
cl0 AS MATERIALIZED (SELECT qid, chunk_id, i, y, {S.unmarked('y')} AS body, {S.h2('y')} AS ish FROM (SELECT qid, chunk_id, unnest({S.lines('text')}) AS y, generate_subscripts({S.lines('text')}, 1) AS i FROM {ev}) z WHERE {S.strip('y')} <> ''),
cl1 AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN ish THEN body END IGNORE NULLS) OVER (PARTITION BY qid, chunk_id ORDER BY i), '') AS heading FROM cl0),
cl2 AS MATERIALIZED (SELECT qid, chunk_id, i, heading, unnest({S.sentences('body')}) AS sentence, generate_subscripts({S.sentences('body')}, 1) AS j FROM cl1 WHERE NOT ish),
cl3 AS MATERIALIZED (SELECT * FROM cl2 UNION ALL SELECT qid, chunk_id, 0, '', unnest({S.sentences('text')}), generate_subscripts({S.sentences('text')}, 1) FROM {ev} e WHERE NOT EXISTS (SELECT 1 FROM cl2 WHERE cl2.qid = e.qid AND cl2.chunk_id = e.chunk_id)),
cr AS MATERIALIZED (SELECT qid, chunk_id, question, {lim} AS lim, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY i, j) - 1 AS i, heading, sentence, {S.t2("heading || ' ' || sentence")} AS tl, {S.t2('question')} AS ql, count(*) OVER (PARTITION BY qid, chunk_id) AS n,
  {S.should_compress('question', 'mode')} AND length(text) > 260 AS u FROM cl3 JOIN {ev} USING (qid, chunk_id) JOIN {q} USING (qid)),
cu AS MATERIALIZED (SELECT *, avg(len(tl)) OVER (PARTITION BY qid, chunk_id) AS mean FROM cr WHERE u AND n > lim),
cb AS (SELECT qid, chunk_id, i, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(tl) / mean))) AS raw FROM (SELECT *, count(*) OVER (PARTITION BY qid, chunk_id, term) AS df FROM (
  SELECT c.*, t.term, t.qtf, len(list_filter(tl, lambda y: y = t.term)) AS tf FROM cu c JOIN (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({S.t2('question')}) AS term FROM {q}) z GROUP BY ALL) t USING (qid)) x WHERE tf > 0) w GROUP BY ALL),
cs AS MATERIALIZED (SELECT cu.*, coalesce(raw / max(raw) OVER (PARTITION BY qid, chunk_id), 0) + len(list_intersect(list_distinct(ql), {S.t2('heading')})) * 0.14 + len(list_intersect(list_distinct(ql), tl)) * 0.04
  + CASE WHEN len(list_filter(ql, lambda y: regexp_full_match(y, '[0-9]+'))) > 0 THEN len(list_intersect(list_distinct(list_filter(ql, lambda y: regexp_full_match(y, '[0-9]+'))), tl)) / len(list_distinct(list_filter(ql, lambda y: regexp_full_match(y, '[0-9]+')))) * 0.2 ELSE 0 END
  + CASE WHEN {cond} THEN 0.16 ELSE 0 END - least(i * 0.015, 0.12) AS score FROM cu LEFT JOIN cb USING (qid, chunk_id, i)),
cp AS (SELECT qid, chunk_id, any_value(lim) AS lim, coalesce(list(i ORDER BY round(score, 9) DESC, i) FILTER (WHERE score > 0), [])[1:any_value(lim)] AS top, coalesce(list(i) FILTER (WHERE {cond}), []) AS conds FROM cs GROUP BY ALL),
cc AS MATERIALIZED (SELECT qid, chunk_id, list_reduce(list_transform(flatten(list_transform(list_sort(top), lambda i: [i - 1, i + 1])), lambda i: [i]), lambda a, x: CASE WHEN len(a) < lim + 1 AND list_contains(conds, x[1]) AND NOT list_contains(a, x[1]) THEN list_append(a, x[1]) ELSE a END, top) AS chosen FROM cp),
cj AS MATERIALIZED (SELECT qid, chunk_id, string_agg(sentence, chr(10) ORDER BY i) AS body, list({S.strip('heading')} ORDER BY i) FILTER (WHERE {S.strip('heading')} <> '') AS heads FROM cs JOIN cc USING (qid, chunk_id) WHERE list_contains(chosen, i) GROUP BY ALL),
cf AS MATERIALIZED (SELECT qid, chunk_id, body, CASE WHEN len(coalesce(heads, [])) > 0 THEN heads[1] || chr(10) || body ELSE body END AS joined FROM cj),
compressed AS (SELECT e.qid, e.chunk_id, CASE WHEN cc.qid IS NULL THEN text WHEN cf.qid IS NULL OR length({S.shorten('joined', 900)}) < 80 THEN {S.shorten('text', 520)} ELSE {S.shorten('joined', 900)} END AS text FROM {ev} e LEFT JOIN cc USING (qid, chunk_id) LEFT JOIN cf USING (qid, chunk_id))"""


S.CTES["fe2"] = (("fe",), "SELECT qid, rank, source || '#' || chunk_index AS chunk_id, text FROM fe")


@query(S.statement("", "bsel", "bq").rstrip() + "," + _compress_sql("bsel", "bq") + " SELECT qid, chunk_id, text FROM compressed")
def compress(spark, d):
    q, e = selected(spark, d)
    return evidence.compress(e, q).select("qid", "chunk_id", "text")


@query(S.statement("", "fe2", "fq").rstrip() + "," + _compress_sql("fe2", "fq") + " SELECT qid, chunk_id, text FROM compressed")
def compress_conditions(spark, d):
    return evidence.compress(inline_evidence(spark), inline_questions(spark)).select("qid", "chunk_id", "text")


@query(S.statement("SELECT * FROM bbest UNION ALL SELECT 1000 + qid, n, sentence FROM fbest", "bbest", "fbest"))
def best_sentences(spark, d):
    q, e = selected(spark, d)
    own = evidence.best_sentences(inline_evidence(spark), inline_questions(spark))
    return evidence.best_sentences(e, q).unionByName(own.withColumn("qid", F.col("qid") + 1000))


@query(S.statement("SELECT qid, answer FROM bact UNION ALL SELECT 1000 + qid, answer FROM fact", "bact", "fact"))
def action_items(spark, d):
    _, e = selected(spark, d)
    return evidence.action_items(e).unionByName(evidence.action_items(inline_evidence(spark)).withColumn("qid", F.col("qid") + 1000))


@query(S.statement("SELECT qid, answer FROM bans UNION ALL SELECT 1000 + qid, answer FROM fans", "bans", "fans"))
def local_answers(spark, d):
    q, e = selected(spark, d)
    own = evidence.local_answers(inline_questions(spark), inline_evidence(spark))
    return evidence.local_answers(q, e).unionByName(own.withColumn("qid", F.col("qid") + 1000))


_INFORMATIVE = f"coalesce(list_filter(list_transform(list_filter(string_split(replace(text, chr(10), '. '), '.'), lambda p: {S.strip('p')} <> ''), lambda p: {S.strip(S.strip_chars('p', '# '))}), lambda p: len({S.words('p')}) >= 6)[1], text)"


@query(
    S.statement(
        f"""SELECT qid, coalesce('The indexed ' || CASE WHEN n = 1 THEN 'document' ELSE 'documents' END || ' appear to be about these main topics:' || chr(10) || chr(10) || l || chr(10) || chr(10) || 'This is an overview based on representative indexed chunks. Ask a more specific question for a more precise answer.', {S.s(V.NO_OVERVIEW)}) AS answer
FROM bq LEFT JOIN (SELECT qid, count(DISTINCT source) AS n, string_agg('- **' || source || '**: ' || {S.shorten(_INFORMATIVE, 260)}, chr(10) ORDER BY rank) AS l FROM bsel GROUP BY qid) z USING (qid)""",
        "bq",
        "bsel",
    )
)
def overview_answers(spark, d):
    q, e = selected(spark, d)
    return evidence.overview_answers(q, e)


@query(S.statement(f"SELECT qid, string_agg('[' || rank || '] ' || {S.CITE} || chr(10) || 'Relevance: ' || printf('%.3f', score) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM bsel GROUP BY qid", "bsel"))
def context_format(spark, d):
    _, e = selected(spark, d)
    return evidence.context(e)


@query(S.statement("SELECT qid, conflict_warnings FROM bconf UNION ALL SELECT 1000 + qid, conflict_warnings FROM fconf", "bconf", "fconf"))
def conflicts(spark, d):
    _, e = selected(spark, d)
    return evidence.conflicts(e).unionByName(evidence.conflicts(inline_evidence(spark)).withColumn("qid", F.col("qid") + 1000))


S.CTES["inj"] = ((), "SELECT 1 AS qid, 2 AS n UNION ALL SELECT 3, 1")


@query(
    S.statement(
        f"SELECT * EXCLUDE (answer) FROM ({S.trust_sql('b', 'bsel', 'bans', 'bconf', 'none')}) x UNION ALL SELECT 1000 + qid, * EXCLUDE (qid, answer) FROM ({S.trust_sql('f', 'fe', 'fans', 'fconf', 'inj')}) y",
        *("bsel", "bans", "bconf", "none", "fe", "fans", "fconf", "inj"),
    )
)
def trust(spark, d):
    q, e = selected(spark, d)
    one = evidence.trust(q, e, evidence.local_answers(q, e), evidence.conflicts(e), spark.createDataFrame([], "qid long, n long"))
    fq, fe = inline_questions(spark), inline_evidence(spark)
    two = evidence.trust(fq, fe, evidence.local_answers(fq, fe), evidence.conflicts(fe), spark.createDataFrame([(1, 2), (3, 1)], "qid long, n long"))
    return one.unionByName(two.withColumn("qid", F.col("qid") + 1000))


# --- corpus ---------------------------------------------------------------------------------------------------------------------


@query(
    S.statement(
        f"""SELECT (SELECT count(DISTINCT source) FROM docs) AS document_count, (SELECT count(*) FROM chunks) AS chunk_count, (SELECT sum(len({S.t8('text')}))::BIGINT FROM docs) AS total_words,
  round((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM (SELECT array_to_string({S.t8('text')}[1:80], ' ') AS f FROM chunks) z GROUP BY f) y) / greatest((SELECT count(*) FROM chunks), 1), 6) AS duplicate_ratio,
  (SELECT count(*) FROM docs WHERE len({S.t8('text')}) < 40) AS short_document_count, []::VARCHAR[] AS low_text_sources,
  (SELECT list(term ORDER BY n DESC, f) FROM (SELECT term, count(*) AS n, min({{'d': doc_ord, 'i': i}}) AS f FROM (SELECT doc_ord, unnest({S.t8('text')}) AS term, generate_subscripts({S.t8('text')}, 1) AS i FROM docs) z GROUP BY term ORDER BY n DESC, f LIMIT 8) y) AS top_terms""",
        "docs",
        "chunks",
    )
)
def health(spark, d):
    return corpus.health(documents(spark, d), chunk_table(spark, d)).withColumn("duplicate_ratio", F.round("duplicate_ratio", 6))


S.CTES.update(
    {
        "hd": (("chunks",), f"SELECT doc_ord, chunk_index, i, {S.collapse('y')} AS heading FROM (SELECT doc_ord, chunk_index, i, {S.strip_chars('y', '# ' + chr(92) + '-' + chr(92) + 't')} AS y FROM (SELECT doc_ord, chunk_index, unnest({S.lines('text')}) AS y, generate_subscripts({S.lines('text')}, 1) AS i FROM chunks) z) w WHERE {S.h_sized('y', 10)}"),
        "hd8": (("hd",), "SELECT heading, row_number() OVER (ORDER BY f) AS n FROM (SELECT arg_min(heading, {'d': doc_ord, 'c': chunk_index, 'i': i}) AS heading, min({'d': doc_ord, 'c': chunk_index, 'i': i}) AS f FROM hd WHERE heading <> '' GROUP BY lower(heading) ORDER BY f LIMIT 8) z"),
        "ph": (("chunks",), f"SELECT phrase, count(*) AS n, min({{'d': doc_ord, 'c': chunk_index, 'i': i}}) AS f FROM (SELECT doc_ord, chunk_index, unnest({S.t9('text')}) AS phrase, generate_subscripts({S.t9('text')}, 1) AS i FROM chunks) z GROUP BY phrase ORDER BY n DESC, f LIMIT 6"),
        "nm": (("docs",), f"SELECT {S.collapse("translate(regexp_replace(source, '(?i)\\.(pdf|md|txt|docx)$', ''), '_-', '  ')")} AS name FROM docs WHERE text <> '' ORDER BY doc_ord LIMIT 1"),
    }
)


@query(S.statement("SELECT phrase, n FROM ph", "ph"))
def key_phrases(spark, d):
    return corpus.key_phrases(chunk_table(spark, d)).select("phrase", "n")


@query(S.statement("SELECT n - 1 AS pos, heading FROM hd8", "hd8"))
def headings(spark, d):
    h = corpus.headings(chunk_table(spark, d))
    from pyspark.sql import Window

    return h.select((F.row_number().over(Window.orderBy("doc_ord", "chunk_index", "line")) - 1).alias("pos"), "heading")  # eight rows


@query(
    S.statement(
        f"""SELECT i - 1 AS pos, l[i] AS question FROM (SELECT list_filter(['What is the purpose of ' || (SELECT name FROM nm) || '?', 'What should I know about ' || (SELECT heading FROM hd8 WHERE n = 1) || '?', 'How are ' || (SELECT heading FROM hd8 WHERE n = 1) || ' and ' || (SELECT heading FROM hd8 WHERE n = 2) || ' related?',
  'What requirements or steps are mentioned for ' || (SELECT phrase FROM ph ORDER BY ph.n DESC, f LIMIT 1) || '?', {', '.join(S.s(x) for x in V.LAST_QUESTIONS)}], lambda y: y IS NOT NULL)[1:5] AS l) z, unnest(range(1, len(l) + 1)) AS u(i)""",
        "nm",
        "hd8",
        "ph",
    )
)
def suggestions(spark, d):
    return corpus.suggestions(chunk_table(spark, d))


@query(S.statement("SELECT source FROM (SELECT source FROM docs UNION SELECT 'missing.pdf' EXCEPT SELECT source FROM chunks) z", "docs", "chunks"))
def index_freshness(spark, d):
    """All documents, those without text among them, and one more name, against the index of all documents."""
    uploads = documents(spark, d).select(F.col("source").alias("name")).union(spark.createDataFrame([("missing.pdf",)], "name string"))
    return corpus.index_freshness(uploads, chunk_table(spark, d))


S.CTES.update(
    {
        "c8": (("chunks",), "SELECT * FROM chunks ORDER BY doc_ord, chunk_index LIMIT 8"),
        "subj": (
            ("c8",),
            f"""SELECT cand, weight, {{'d': doc_ord, 'c': chunk_index, 'i': i}} AS place, list_distinct({S.t7('cand')}) AS own FROM (
  SELECT doc_ord, chunk_index, 0 AS i, {S.strip("translate(regexp_replace(source, '(?i)\\.(pdf|md|txt|docx)$', ''), '_-', '  ')")} AS cand, 1 AS weight FROM c8
  UNION ALL SELECT doc_ord, chunk_index, i, y, 3 FROM (SELECT doc_ord, chunk_index, i, {S.strip_chars('y', '# ' + chr(92) + '-' + chr(92) + 't')} AS y FROM (SELECT doc_ord, chunk_index, unnest({S.lines('text')}) AS y, generate_subscripts({S.lines('text')}, 1) AS i FROM c8) z) w WHERE {S.h_short('y', 10)}) u WHERE cand <> ''""",
        ),
    }
)


def _rewrite_cte(name: str, table: str) -> None:
    q = f"(SELECT qid, {S.collapse('question')} AS question, mode FROM {table})"
    S.CTES[name] = (
        (table, "subj") if table in S.CTES else ("fq", "subj"),
        f"""SELECT q.qid, q.question AS original, mode, CASE WHEN cand IS NOT NULL AND NOT contains(lower(q.question), lower(cand)) THEN q.question || ' in ' || cand ELSE q.question END AS question FROM {q} q LEFT JOIN (
  SELECT * FROM (SELECT qid, cand, points, row_number() OVER (PARTITION BY qid ORDER BY points DESC, place) AS n FROM (
    SELECT qid, cand, sum(len(list_intersect(terms, own)) * weight) AS points, min(place) AS place FROM (SELECT qid, question, list_filter(list_distinct({S.t7('question')}), lambda y: NOT list_contains({S.arr(V.VAGUE_TERMS)}, y)) AS terms FROM {q} z WHERE question <> '' AND {S.vague('question')}) v, subj
    WHERE len(list_intersect(terms, own)) > 0 GROUP BY qid, cand) y) x WHERE n = 1 AND points >= 2) r USING (qid)""",
    )


_rewrite_cte("brw", "bq")
_rewrite_cte("arw", ALL_QUESTIONS)


@query(S.statement("SELECT qid, question AS rewritten FROM arw", "arw"))
def rewrite_query(spark, d):
    return corpus.rewrite(all_questions(spark, d), chunk_table(spark, d))


# --- replies, sources -----------------------------------------------------------------------------------------------------------

REPLIES = [
    (1, '```json\n{"conflicts": [{"claim_a": "a", "source_a": "x", "claim_b": "b", "source_b": "y", "why_conflict": "differs", "severity": "HIGH"}, {"claim_a": "c", "why_conflict": ""}]}\n```'),
    (2, 'Sure: {"conflicts": [{"claim_a": "p", "claim_b": "q", "why_conflict": "other"}]} done'),
    (3, '{"conflicts": []}'),
]


@query(
    "SELECT id, list_transform(list_filter(from_json(j, '{\"conflicts\": [{\"claim_a\": \"VARCHAR\", \"source_a\": \"VARCHAR\", \"claim_b\": \"VARCHAR\", \"source_b\": \"VARCHAR\", \"why_conflict\": \"VARCHAR\", \"severity\": \"VARCHAR\"}]}').conflicts, lambda c: coalesce(trim(c.why_conflict), '') <> ''), "
    "lambda c: upper(left(coalesce(c.severity, 'medium'), 1)) || lower(substr(coalesce(c.severity, 'medium'), 2)) || ' conflict: ' || coalesce(c.source_a, 'source A') || ' says ''' || coalesce(c.claim_a, '') || ''', while ' || coalesce(c.source_b, 'source B') || ' says ''' || coalesce(c.claim_b, '') || '''. ' || c.why_conflict) AS warnings "
    f"FROM (SELECT id, regexp_extract(reply, '(?s)\\{{.*\\}}') AS j FROM (VALUES {', '.join(f'({i}, {S.s(t)})' for i, t in REPLIES)}) AS v(id, reply)) z"
)
def parse_conflict_replies(spark, d):
    return spark.createDataFrame(REPLIES, "id int, reply string").select("id", corpus.parse_conflicts(F.col("reply")).alias("warnings"))


STYLES = ["heading 1", "heading 9", "heading", "heading 0", "title"]


@query(f"SELECT x AS style, CASE WHEN regexp_replace(x, '[^0-9]', '', 'g') = '' THEN 2 ELSE least(greatest(regexp_replace(x, '[^0-9]', '', 'g')::INT, 1), 6) END AS level FROM (SELECT unnest({S.arr(STYLES)}) AS x) z")
def heading_levels(spark, d):
    return spark.createDataFrame([(x,) for x in STYLES], "style string").select("style", files.heading_level(F.col("style")).alias("level"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform([source, '', ' ' || lang || ' ', n_chars::VARCHAR], lambda c: trim(c)), lambda c: c <> ''), ' | ') AS line FROM documents")
def table_lines(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", files.table_line(F.array("source", F.lit(""), F.concat(F.lit(" "), "lang", F.lit(" ")), F.col("n_chars").cast("string"))).alias("line"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext, lower(regexp_extract(url, '\\.([^./]*)$', 1)) IN ('pdf', 'docx', 'md', 'txt') AS supported FROM pages")
def supported_formats(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", files.extension(F.col("url")).alias("ext"))
    return p.withColumn("supported", F.col("ext").isin(V.EXTENSIONS))


# --- the whole way --------------------------------------------------------------------------------------------------------------

S.CTES.update(S.search_chain("r", "brw"))
S.CTES.update(S.answer_chain("r", "rsel", "bq"))
_FULL = f"""SELECT qid, CASE WHEN should_refuse THEN {S.s(V.REFUSAL)} ELSE {S.highlight('answer')} END AS answer, rewritten_query, score, label, reasons, gaps, conflict_warnings, should_refuse
FROM ({S.trust_sql('r', 'rsel', 'rans', 'rconf', 'none')}) t JOIN (SELECT qid, CASE WHEN question <> b.question0 THEN question END AS rewritten_query FROM brw JOIN (SELECT qid, question AS question0 FROM bq) b USING (qid)) w USING (qid)"""


@query(S.statement(_FULL, "rsel", "rans", "rconf", "none", "brw", "bq"))
def answer_pipeline(spark, d):
    kb = pipeline.build(documents(spark, d), with_graph=False)
    out = pipeline.answer(questions(spark, d), kb)
    return out.select("qid", "answer", "rewritten_query", "score", "label", "reasons", "gaps", "conflict_warnings", "should_refuse")


S.CTES["cq"] = (("bq",), f"SELECT qid, {S.s(V.COMPARE_PREFIX)} || question AS question, 'Detailed Explanation' AS mode FROM bq")
_rewrite_cte("crw", "cq")
S.CTES.update(S.search_chain("c_", "crw"))
S.CTES.update(S.answer_chain("c_", "c_sel", "cq"))


@query(
    S.statement(
        f"SELECT qid, CASE WHEN should_refuse THEN {S.s(V.REFUSAL)} ELSE {S.highlight('answer')} END AS answer, score, label, should_refuse FROM ({S.trust_sql('c_', 'c_sel', 'c_ans', 'c_conf', 'none')}) t",
        *("c_sel", "c_ans", "c_conf", "none"),
    )
)
def compare_documents(spark, d):
    kb = pipeline.build(documents(spark, d), with_graph=False)
    return pipeline.answer(pipeline.compare(questions(spark, d)), kb).select("qid", "answer", "score", "label", "should_refuse")


S.CTES.update(_graph_chain("rg", "brw", "rhits"))
S.CTES.update({**S.search_chain("g_", "brw"), "g_hits": (("rgx", "chunks"), "SELECT qid, rank, c.*, score FROM rgx JOIN chunks c USING (chunk_id) WHERE rank <= 24")})
S.CTES.update(S.answer_chain("g_", "g_sel", "bq"))


@query(
    S.statement(
        f"SELECT qid, CASE WHEN should_refuse THEN {S.s(V.REFUSAL)} ELSE {S.highlight('answer')} END AS answer, score, label, should_refuse FROM ({S.trust_sql('g_', 'g_sel', 'g_ans', 'g_conf', 'none')}) t",
        *("g_sel", "g_ans", "g_conf", "none"),
    )
)
def graph_pipeline(spark, d):
    kb = pipeline.build(documents(spark, d))
    return pipeline.answer(questions(spark, d).withColumn("retrieval_mode", F.lit("Graph-Enhanced RAG")), kb, expand=True).select("qid", "answer", "score", "label", "should_refuse")


REPLY = "The limit is 30 days [1]."
_rewrite_cte("hrw", "fq")
S.CTES.update(S.search_chain("h_", "hrw"))
S.CTES.update(
    {
        "ovw": (("chunks",), "SELECT row_number() OVER (ORDER BY f DESC, doc_ord, chunk_index)::INT AS rank, chunk_id, doc_ord, source, chunk_index, text, CASE WHEN f = 1 THEN 0.82 ELSE 0.72 END::DOUBLE AS score FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_ord, chunk_index) = 1)::INT AS f FROM chunks) z ORDER BY rank LIMIT 6"),
        "h_ev": (
            ("h_sel", "ovw", "fq"),
            f"SELECT qid, rank, chunk_id, doc_ord, source, chunk_index, text, score FROM h_sel UNION ALL SELECT q.qid, o.rank, o.chunk_id, o.doc_ord, o.source, o.chunk_index, o.text, o.score FROM (SELECT qid FROM fq WHERE {S.overview_question('question')} AND qid NOT IN (SELECT qid FROM h_sel)) q, ovw o",
        ),
        "h_conf": S.answer_chain("h_", "h_ev", "fq")["h_conf"],
        "h_ans": (
            ("h_ev", "fq"),
            f"""SELECT f.qid, question, CASE WHEN NOT {S.overview_question('question')} THEN {S.s(REPLY)} ELSE coalesce('The indexed ' || CASE WHEN n = 1 THEN 'document' ELSE 'documents' END || ' appear to be about these main topics:' || chr(10) || chr(10) || l || chr(10) || chr(10)
  || 'This is an overview based on representative indexed chunks. Ask a more specific question for a more precise answer.', {S.s(V.NO_OVERVIEW)}) END AS answer
FROM fq f LEFT JOIN (SELECT qid, count(DISTINCT source) AS n, string_agg('- **' || source || '**: ' || {S.shorten(_INFORMATIVE, 260)}, chr(10) ORDER BY rank) AS l FROM h_ev GROUP BY qid) z USING (qid)""",
        ),
    }
)


@query(
    _question_sql(
        f""", ref AS MATERIALIZED ({_REFUSE}), hinj AS MATERIALIZED (SELECT qid, 1 AS n FROM found WHERE reason IS NOT NULL)
SELECT t.qid, CASE WHEN should_refuse THEN {S.s(V.REFUSAL)} ELSE {S.highlight('answer')} END AS answer, score, label, should_refuse, coalesce(w.n, 0)::INT AS n_warnings
FROM ({S.trust_sql('h_', 'h_ev', 'h_ans', 'h_conf', 'hinj')}) t JOIN ref r ON r.qid = t.qid AND NOT refuse LEFT JOIN hinj w ON w.qid = t.qid
UNION ALL SELECT qid, {S.s(V.INJECTION_REFUSAL)}, 0, 'Prompt injection blocked', true, 1 FROM ref WHERE refuse""",
        "fq",
        *("h_ev", "h_ans", "h_conf"),
    )
)
def guarded_pipeline(spark, d):
    kb = pipeline.build(documents(spark, d), with_graph=False)
    out = pipeline.answer(inline_questions(spark), kb, generator=providers.EchoGenerator(REPLY), judge=providers.EchoGenerator("{}"))
    n = F.when(F.col("warnings").isNull(), 0).otherwise(F.size("warnings"))
    return out.select("qid", "answer", "score", "label", "should_refuse", n.cast("int").alias("n_warnings"))


class LetterEmbedder:
    """A text's counts of the letters a to z: an embedder that SQL can follow."""

    name, model = "letters", "counts"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


LETTERS = "abcdefghijklmnopqrstuvwxyz"
_counts = f"list_transform({S.arr(LETTERS)}, lambda l: (length(lower(x)) - length(replace(lower(x), l, '')))::DOUBLE)"
_DENSE = f"""SELECT qid, rank, chunk_id, doc_ord, source, chunk_index, text, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
  SELECT qid, c.*, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score FROM (SELECT qid, {_counts} AS v FROM (SELECT qid, question AS x FROM %s) a) q, (SELECT *, {_counts.replace('(x)', '(text)')} AS v FROM chunks) c) s WHERE score > 0) r WHERE rank <= %d"""


@query(S.statement(f"SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ({_DENSE % ('bq', 6)}) z", "bq", "chunks"))
def provider_index(spark, d):
    chunks = chunk_table(spark, d)
    dense, _, _ = providers.build_index(chunks, LetterEmbedder())
    return providers.search_dense_index(dense, chunks, questions(spark, d), LetterEmbedder(), 6).select("qid", "rank", "chunk_id", r6("score"))


S.CTES.update({**S.search_chain("d_", "brw"), "d_hits": (("brw", "chunks"), _DENSE % ("brw", 24))})
S.CTES.update(S.answer_chain("d_", "d_sel", "bq"))


@query(
    S.statement(
        f"SELECT qid, CASE WHEN should_refuse THEN {S.s(V.REFUSAL)} ELSE {S.highlight('answer')} END AS answer, score, label, should_refuse FROM ({S.trust_sql('d_', 'd_sel', 'd_ans', 'd_conf', 'none')}) t",
        *("d_sel", "d_ans", "d_conf", "none"),
    )
)
def dense_pipeline(spark, d):
    """The whole way over an index of embeddings."""
    kb = pipeline.build(documents(spark, d), with_graph=False, embedder=LetterEmbedder())
    return pipeline.answer(questions(spark, d), kb).select("qid", "answer", "score", "label", "should_refuse")


def _likeness_sql(questions: str) -> str:
    lit = lambda t: f"(list_transform([{S.s(t)}], lambda x: {_counts}))[1]"
    attacks = ", ".join(f"({i}, {S.s(a)}, {lit(a)})" for i, a in enumerate(V.ATTACKS))
    return f"""SELECT qid, 0 AS ord, sim, example FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, i) AS n FROM (SELECT qid, i, example, list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))) AS sim
FROM (SELECT qid, {_counts} AS v FROM (SELECT qid, question AS x FROM {questions}) y) q, (VALUES {attacks}) AS a(i, example, w)) z) u WHERE n = 1"""


@query(S.statement(f"SELECT qid, round(sim, 6) AS sim, example FROM ({_likeness_sql(ALL_QUESTIONS)}) z", "fq"))
def embedded_likeness(spark, d):
    """Each question's likeness to the example attacks, by embeddings."""
    q = all_questions(spark, d).select("qid", F.lit(0).alias("ord"), F.col("question").alias("text"))
    return providers.embedded_similarity(q, LetterEmbedder()).select("qid", r6("sim"), "example")


@query(S.statement(f"SELECT qid, rank AS number, source, 'Chunk ' || (chunk_index + 1) AS location, round(score, 2) AS relevance, {S.excerpt('text')} AS excerpt FROM bsel", "bsel"))
def citation_cards(spark, d):
    _, e = selected(spark, d)
    return evidence.citation_cards(e)
