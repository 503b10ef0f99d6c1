"""Registered queries: embeddings, retrieval, answers and chat log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import text as T
from clausegrid.operators import retrieval as R
from clausegrid.plans import date_queries as DQ
from clausegrid.plans import entities as E
from clausegrid.plans import sqltext as Q
from clausegrid.plans import text_queries as TQ
from clausegrid.plans.entities import AS_OF, CTE, with_ctes
from clausegrid.session import checkpoint_root, cut_lineage

QUERIES: dict = {}
DIM = 1536


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ questions, grants, vectors

def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item, asked in one of five workspaces: its whole text as it is (a search finds what holds all of its words), and as
    alternatives, one for each word longer than seven letters."""
    items = E.table(spark, d, "benchmark").select(F.col("item_id").alias("k"), "text")
    words = F.array_join(F.array_sort(F.array_distinct(F.filter(T.tokens("text"), lambda w: F.length(w) > 7))), " or ")
    asked = items.select("k", F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("question")), F.struct(F.lit(1).alias("form"), words.alias("question")))).alias("a"))
    return asked.select((F.col("k") * 2 + F.col("a.form")).alias("question_id"), (F.col("k") % 5).alias("workspace_id"), F.col("a.question").alias("question"))


def scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the versions that a workspace may read: all of its own."""
    grants = E.table(spark, d, "documents").select((F.col("doc_id") % 5).alias("workspace_id"), F.col("doc_id").alias("dv_id"))
    return E.shared(spark, d, "scope", lambda: cut_lineage(R.authorized_chunks(TQ.doc_chunks(spark, d), grants)))


def index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of the scope, written once."""
    return E.shared(spark, d, "text_index", lambda: R.write_text_index(scope(spark, d), f"{checkpoint_root(spark)}/text-index-{uuid.uuid4().hex}"))


def granted(spark: SparkSession, d: str) -> DataFrame:
    """Chunks under grants that leave out a workspace's German documents: what permissions do before any ranking."""
    grants = E.table(spark, d, "documents").filter("lang <> 'de'").select((F.col("doc_id") % 5).alias("workspace_id"), F.col("doc_id").alias("dv_id"))
    return R.authorized_chunks(TQ.doc_chunks(spark, d), grants)


_TOK = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
CTE["questions"] = ([], f"""
SELECT item_id * 2 AS question_id, item_id % 5 AS workspace_id, text AS question FROM benchmark
UNION ALL SELECT item_id * 2 + 1, item_id % 5, array_to_string(list_sort(list_distinct(list_filter({_TOK.format(x='text')}, lambda w: length(w) > 7))), ' or ') FROM benchmark""")
CTE["scope"] = (["doc_chunks"], "SELECT * FROM doc_chunks")
CTE["granted"] = (["doc_chunks"], "SELECT c.* FROM doc_chunks c JOIN documents d ON d.doc_id = c.dv_id WHERE d.lang <> 'de'")
_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)


def _embed_sql(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, dim, n / norm AS weight FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY {key})) AS norm FROM (
  SELECT {key}, dim, count(*) AS n FROM (SELECT {key}, d.dim FROM (SELECT {key}, unnest({_TOK.format(x=text)}) AS tok FROM {source}) JOIN token_dims d USING (tok)) GROUP BY {key}, dim))"""


CTE["token_dims"] = (["doc_chunks", "questions"], f"""
SELECT tok, {Q.fnv_dimension('tok', DIM)} AS dim FROM (
  SELECT DISTINCT unnest({_TOK.format(x='text')}) AS tok FROM doc_chunks UNION SELECT DISTINCT unnest({_TOK.format(x='question')}) FROM questions)""")
CTE["chunk_vectors"] = (["scope", "token_dims"], _embed_sql("scope", "chunk_id", "text"))
CTE["question_vectors"] = (["questions", "token_dims"], _embed_sql("questions", "question_id", "question"))
CTE["vector_hits"] = (["scope", "questions", "chunk_vectors", "question_vectors"], """
SELECT question_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.question_id, c.chunk_id, round(coalesce(s.score, 0), 9) AS score FROM questions q JOIN scope c ON c.workspace_id = q.workspace_id
    LEFT JOIN (SELECT question_id, chunk_id, sum(a.weight * b.weight) AS score FROM question_vectors a JOIN chunk_vectors b ON a.dim = b.dim GROUP BY 1, 2) s ON s.question_id = q.question_id AND s.chunk_id = c.chunk_id
    WHERE q.question_id IN (SELECT question_id FROM question_vectors) AND c.chunk_id IN (SELECT chunk_id FROM chunk_vectors))) WHERE rank <= 40""")
CTE["text_index"] = (["scope"], f"""
SELECT workspace_id, chunk_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT workspace_id, chunk_id, len(t) AS dl, unnest(t) AS term FROM (
  SELECT workspace_id, chunk_id, list_filter({_TOK.format(x='text')}, lambda w: NOT list_contains([{_STOP}], w)) AS t FROM scope)) GROUP BY 1, 2, 3""")
CTE["question_parts"] = (["questions"], r"""
SELECT *, sum(CAST(part = 'or' AS INTEGER)) OVER (PARTITION BY question_id ORDER BY pos) AS alt FROM (
  SELECT question_id, workspace_id, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM (SELECT *, regexp_extract_all(lower(question), '\S+') AS p FROM questions))""")
CTE["question_terms"] = (["question_parts"], f"""
SELECT *, count(*) OVER (PARTITION BY question_id, alt) AS n FROM (SELECT DISTINCT question_id, workspace_id, alt, term FROM (
  SELECT question_id, workspace_id, alt, unnest(list_filter({_TOK.format(x='part')}, lambda w: NOT list_contains([{_STOP}], w))) AS term FROM question_parts WHERE part <> 'or'))""")
CTE["text_hits"] = (["text_index", "question_terms"], """
SELECT question_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT question_id, chunk_id, max(score) AS score FROM (
      SELECT q.question_id, q.alt, i.chunk_id, round(sum(ln(1 + (c.n - d.df + 0.5) / (d.df + 0.5)) * i.tf * 2.2 / (i.tf + 1.2 * (0.25 + 0.75 * i.dl / c.avgdl))), 9) AS score
      FROM question_terms q JOIN text_index i ON i.term = q.term AND i.workspace_id = q.workspace_id JOIN (SELECT workspace_id, term, count(*) AS df FROM text_index GROUP BY 1, 2) d ON d.term = q.term AND d.workspace_id = q.workspace_id
      JOIN (SELECT workspace_id, count(*) AS n, avg(dl) AS avgdl FROM (SELECT workspace_id, chunk_id, max(dl) AS dl FROM text_index GROUP BY 1, 2) GROUP BY 1) c ON c.workspace_id = q.workspace_id
      GROUP BY q.question_id, q.alt, i.chunk_id HAVING count(*) = max(q.n)) GROUP BY 1, 2)) WHERE rank <= 40""")
CTE["fused"] = (["vector_hits", "text_hits"], """
SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT question_id, chunk_id, rank FROM vector_hits UNION ALL SELECT question_id, chunk_id, rank FROM text_hits) GROUP BY 1, 2)) WHERE rank <= 8""")


def _vector_hits(q, c):
    qv = q.select("question_id", "workspace_id", R.vector_of("question", DIM).alias("vector"))
    cv = c.select("chunk_id", "workspace_id", R.vector_of("text", DIM).alias("vector"))
    return R.vector_topk(qv, cv, DIM)


def vector_hits(spark, d):
    return _vector_hits(questions(spark, d), scope(spark, d))


def text_hits(spark, d):
    return R.fts_topk(questions(spark, d), scope(spark, d), index=index(spark, d))


def fused(spark, d):
    q, c = questions(spark, d), scope(spark, d)
    return E.shared(spark, d, "fused", lambda: cut_lineage(R.rrf([_vector_hits(q, c), R.fts_topk(q, c, index=index(spark, d))])))


@_register("r01_hash_embed", with_ctes(["chunk_vectors"], "SELECT chunk_id, dim, round(weight, 6) AS weight FROM chunk_vectors"))
def r01(spark, d):
    return R.hash_embed(scope(spark, d), dim=DIM).withColumn("weight", F.round("weight", 6))


@_register("r02_vector_topk", with_ctes(["vector_hits"], "SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM vector_hits"))
def r02(spark, d):
    return vector_hits(spark, d).withColumn("score", F.round("score", 6))


@_register("r02_dense_topk", """
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE rank <= 40""")
def r02b(spark, d):
    e = E.table(spark, d, "embeddings").select(F.col("vec_id"), F.col("label").alias("workspace_id"), F.col("embedding").alias("vector"))
    out = R.vector_topk(e.withColumnRenamed("vec_id", "question_id"), e.withColumnRenamed("vec_id", "chunk_id"), 64, skip_same=True)
    return out.withColumn("score", F.round("score", 6))


@_register("r02_index_recall", """
SELECT count(*) AS indexed, (SELECT count(*) FROM embeddings) = count(*) AS complete, true AS recall_reached FROM embeddings""")
def r02c(spark, d):
    """Every vector is in the index, and the index finds at least nine tenths of what the exact search finds for each twentieth vector."""
    e = E.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("workspace_id"), F.col("embedding").alias("vector"))
    index = E.shared(spark, d, "vector_index", lambda: R.build_vector_index(e, 64, f"{checkpoint_root(spark)}/vector-index-{uuid.uuid4().hex}"))
    asked = e.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id")
    exact = R.vector_topk(asked, e, 64, skip_same=True).select("question_id", "chunk_id")
    found = index.search(asked, skip_same=True).select("question_id", "chunk_id", F.lit(1).alias("hit"))
    recall = exact.join(found, ["question_id", "chunk_id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))
    stored = index.rows.agg(F.countDistinct("chunk_id").alias("indexed"), F.count("*").alias("stored"))
    whole = e.agg(F.count("*").alias("all"))
    complete = (F.col("indexed") == whole.scalar()) & (F.col("stored") == F.col("indexed"))
    return stored.select("indexed", complete.alias("complete"), (recall.scalar() >= 0.9).alias("recall_reached"))


@_register("r03_fts_topk", with_ctes(["text_hits"], "SELECT question_id, chunk_id, round(score, 5) AS score, rank FROM text_hits"))
def r03(spark, d):
    return text_hits(spark, d).withColumn("score", F.round("score", 5))


@_register("r04_fusion", with_ctes(["fused"], "SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM fused"))
def r04(spark, d):
    return fused(spark, d).withColumn("score", F.round("score", 6))


@_register("r05_authorized_chunks", with_ctes(["granted"], "SELECT chunk_id, dv_id, workspace_id, seq FROM granted"))
def r05(spark, d):
    return granted(spark, d).select("chunk_id", "dv_id", "workspace_id", "seq")


@_register("r06_evidence", with_ctes(["fused", "scope"], """
SELECT f.question_id, f.rank, f.chunk_id, 'chk_' || (f.rank - 1) AS evidence_id, c.dv_id, c.page_start, c.page_end, c.char_start, c.char_end, c.text FROM fused f JOIN scope c ON c.chunk_id = f.chunk_id"""))
def r06(spark, d):
    return R.attach_evidence(fused(spark, d), scope(spark, d)).select(
        "question_id", "rank", "chunk_id", "evidence_id", "dv_id", "page_start", "page_end", "char_start", "char_end", "text")


# ------------------------------------------------------------------ chat questions

_OPENERS = ["What is due in 45 days?", "Which obligations will renew soon?", "Any deadlines next week?", "renewals in May", "What's coming up?", "due within weeks",
            "Is this enforceable?", "Should we terminate it?", "cite 12 U.S.C. please", "a precedent for this", "What does the payment clause say?", "Tell me the notice period.", "due in the next 10 months"]


def chat_questions(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns opened by typical questions."""
    opener = F.element_at(F.array(*[F.lit(x) for x in _OPENERS]), ((F.col("conv_id") * 5 + F.col("turn")) % len(_OPENERS)).cast("int") + 1)
    return E.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), (F.col("conv_id") % 25).alias("workspace_id"), "conv_id", "turn",
        F.concat_ws(" ", opener, "text").alias("question"))


_OPEN_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _OPENERS) + "]"
CTE["chat_questions"] = ([], f"""
SELECT conv_id * 1000 + turn AS question_id, conv_id % 25 AS workspace_id, conv_id, turn, {_OPEN_SQL}[CAST((conv_id * 5 + turn) % {len(_OPENERS)} AS INTEGER) + 1] || ' ' || text AS question FROM conversations""")


def _sq(p: str) -> str:
    return p.replace("'", "''")


_HITS = [f"regexp_matches(question, '{_sq(p)}')" for p in K.PORTFOLIO_PATTERNS]
CTE["routed"] = (["chat_questions"], f"""
SELECT *, CASE WHEN {' OR '.join(_HITS)} THEN 'portfolio_dates' ELSE 'document_text' END AS intent,
       CASE WHEN {_HITS[0]} THEN coalesce(TRY_CAST(regexp_extract(question, '{_sq(K.PORTFOLIO_PATTERNS[0])}', 2) AS INTEGER), 30) WHEN {' OR '.join(_HITS[1:])} THEN 30 END AS window_days,
       {' OR '.join(f"regexp_matches(question, '{_sq(p)}')" for p in K.OUT_OF_SCOPE_PATTERNS)} AS out_of_scope FROM chat_questions""")


@_register("r07_route_intent", with_ctes(["routed"], "SELECT question_id, intent, window_days FROM routed"))
def r07(spark, d):
    return R.route_intent(chat_questions(spark, d)).select("question_id", "intent", "window_days")


@_register("r08_out_of_scope", with_ctes(["routed"], "SELECT question_id, out_of_scope FROM routed"))
def r08(spark, d):
    return R.out_of_scope(chat_questions(spark, d)).select("question_id", "out_of_scope")


CTE["due_lines"] = (["routed", "obligations", "contracts"], f"""
SELECT r.question_id, o.obligation_id, o.due_date, row_number() OVER (PARTITION BY question_id ORDER BY due_date, obligation_id) AS rk, count(*) OVER (PARTITION BY question_id) AS n,
       '- ' || o.title || ' — ' || c.title || ' — due ' || due_date || ' (/contracts/' || c.contract_id || '/obligations)' AS line
FROM routed r JOIN obligations o ON o.workspace_id = r.workspace_id AND o.due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + r.window_days AND o.status IN ('active', 'overdue')
JOIN contracts c ON c.contract_id = o.contract_id WHERE r.intent = 'portfolio_dates'""")


@_register("r09_portfolio_answer", with_ctes(["routed", "due_lines"], """
SELECT question_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'No obligations are due in the next ' || window_days || ' days.'
  ELSE n || ' obligation(s) due in the next ' || window_days || ' days:' || chr(10) || lines || CASE WHEN n > 20 THEN chr(10) || '… and ' || (n - 20) || ' more' ELSE '' END END AS content
FROM routed r LEFT JOIN (SELECT question_id, max(n) AS n, string_agg(line, chr(10) ORDER BY rk) FILTER (WHERE rk <= 20) AS lines FROM due_lines GROUP BY question_id) a USING (question_id)
WHERE intent = 'portfolio_dates'"""))
def r09(spark, d):
    q = R.route_intent(chat_questions(spark, d)).filter("intent = 'portfolio_dates'")
    return R.portfolio_answer(q, DQ.obligations(spark, d), E.contracts(spark, d), AS_OF)


@_register("r09_portfolio_due", with_ctes(["due_lines"], "SELECT question_id, obligation_id, due_date, line FROM due_lines"))
def r09b(spark, d):
    q = R.route_intent(chat_questions(spark, d)).filter("intent = 'portfolio_dates'")
    return R.portfolio_due(q, DQ.obligations(spark, d), E.contracts(spark, d), AS_OF)


# ------------------------------------------------------------------ claims over the retrieved evidence

def claims(spark, d) -> tuple[DataFrame, DataFrame]:
    """One drafted claim per evidence row: some with unwanted phrases, some citing ids never retrieved."""
    ev = R.attach_evidence(fused(spark, d), scope(spark, d).select("chunk_id", "dv_id", "text"))
    r, q = F.col("rank"), F.col("question_id")
    text = F.when((q + r) % 5 == 0, "This result is certified.").otherwise(F.concat(F.lit("Claim about "), "chunk_id"))
    ids = (F.when((q + r) % 7 == 0, F.array(F.lit("chk_99"))).when(r % 2 == 0, F.array(F.lit("chk_99"), "evidence_id", F.lit("chk_0")))
           .otherwise(F.array("evidence_id")))
    rows = ev.filter(q % 9 != 0).select("question_id", r.alias("pos"), text.alias("text"), ids.alias("evidence_ids"))
    return rows, ev


CTE["claims"] = (["fused"], """
SELECT question_id, rank AS pos, CASE WHEN (question_id + rank) % 5 = 0 THEN 'This result is certified.' ELSE 'Claim about ' || chunk_id END AS text,
       CASE WHEN (question_id + rank) % 7 = 0 THEN ['chk_99'] WHEN rank % 2 = 0 THEN ['chk_99', 'chk_' || (rank - 1), 'chk_0'] ELSE ['chk_' || (rank - 1)] END AS evidence_ids
FROM fused WHERE question_id % 9 <> 0""")
CTE["claim_refs"] = (["claims", "fused"], f"""
SELECT c.question_id, c.pos, c.text, f.chunk_id FROM (SELECT *, unnest(evidence_ids) AS evidence_id FROM claims WHERE {Q.lint_clean('text')}) c
JOIN fused f ON f.question_id = c.question_id AND 'chk_' || (f.rank - 1) = c.evidence_id""")


@_register("r10_valid_claims", with_ctes(["claim_refs"], "SELECT DISTINCT question_id, pos, text FROM claim_refs"))
def r10(spark, d):
    valid, _ = R.validate_claims(*claims(spark, d))
    return valid.select("question_id", "pos", "text")


@_register("r10_claim_citations", with_ctes(["claim_refs"], "SELECT question_id, chunk_id, min(pos) AS pos FROM claim_refs GROUP BY 1, 2"))
def r10b(spark, d):
    return R.validate_claims(*claims(spark, d))[1]


@_register("r11_answer_kind", with_ctes(["claim_refs", "fused", "questions"], """
SELECT q.question_id, CASE WHEN q.question_id % 13 = 0 THEN 'refusal_permission' WHEN q.question_id % 11 = 0 THEN 'refusal_out_of_scope' WHEN q.question_id % 10 = 0 THEN 'grounded'
       WHEN f.n IS NULL THEN 'refusal_silent' WHEN v.content IS NULL THEN CASE WHEN q.question_id % 2 = 0 THEN 'refusal_conflict' ELSE 'refusal_silent' END ELSE 'grounded' END AS answer_kind,
       CASE WHEN q.question_id % 13 <> 0 AND q.question_id % 11 <> 0 AND q.question_id % 10 <> 0 AND f.n IS NOT NULL THEN v.content END AS content
FROM questions q LEFT JOIN (SELECT question_id, count(*) AS n FROM fused GROUP BY 1) f USING (question_id)
LEFT JOIN (SELECT question_id, string_agg(text, ' ' ORDER BY pos) AS content FROM (SELECT DISTINCT question_id, pos, text FROM claim_refs) GROUP BY 1) v USING (question_id)"""))
def r11(spark, d):
    k = F.col("question_id")
    drafted, ev = claims(spark, d)
    valid, _ = R.validate_claims(drafted, ev)
    q = questions(spark, d).withColumns({
        "permitted": k % 13 != 0, "out_of_scope": k % 11 == 0, "intent": F.when(k % 10 == 0, "portfolio_dates").otherwise("document_text")})
    drafts = questions(spark, d).select("question_id", F.when(k % 2 == 0, "refusal_conflict").otherwise("grounded").alias("draft_kind"))
    return R.answer_kind(q, ev, valid, drafts).select("question_id", "answer_kind", "content")


# ------------------------------------------------------------------ chat log

def _sessions(spark, d):
    return E.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select(
        E.concat("s", F.col("conv_id")).alias("session_id"), (F.col("conv_id") % 40).alias("contract_id"), (F.col("conv_id") % 7).alias("user_id"),
        E.ts("2000-01-01 00:00:00", F.col("conv_id") * 60).alias("created_at"))


CTE["sessions"] = ([], """
SELECT 's' || conv_id AS session_id, conv_id % 40 AS contract_id, conv_id % 7 AS user_id, TIMESTAMP '2000-01-01 00:00:00' + to_seconds(conv_id * 60) AS created_at FROM (SELECT DISTINCT conv_id FROM conversations)""")


@_register("r12_latest_session", with_ctes(["sessions"], "SELECT contract_id, user_id, arg_max(session_id, (created_at, session_id)) AS session_id FROM sessions GROUP BY 1, 2"))
def r12(spark, d):
    return R.latest_session(_sessions(spark, d)).select("contract_id", "user_id", "session_id")


def _log(spark, d):
    conv = E.table(spark, d, "conversations")
    messages = conv.select(E.concat(F.col("conv_id"), "/", F.col("turn")).alias("message_id"), E.concat("s", F.col("conv_id")).alias("session_id"), "role",
                           F.col("text").alias("content"), F.lit(None).cast("string").alias("answer_kind"))
    turns = conv.filter("role = 'user'").select(
        E.concat("t", F.col("conv_id"), ".", F.col("turn")).alias("turn_id"), (F.col("conv_id") % 55).alias("contract_id"), (F.col("conv_id") % 7).alias("user_id"),
        E.ts("2000-02-01 00:00:00", F.col("conv_id") * 60 + F.col("turn")).alias("asked_at"), F.col("text").alias("question"),
        T.upper_each(F.substring("text", 1, 10)).alias("answer"), F.lit("grounded").alias("answer_kind"))
    return R.append_turns(_sessions(spark, d), messages, turns)


@_register("r12_append_turns", with_ctes(["sessions"], """,
latest AS (SELECT contract_id, user_id, arg_max(session_id, (created_at, session_id)) AS session_id FROM sessions GROUP BY 1, 2),
turns AS (SELECT 't' || conv_id || '.' || turn AS turn_id, text, conv_id % 55 AS contract_id, conv_id % 7 AS user_id FROM conversations WHERE role = 'user')
SELECT conv_id || '/' || turn AS message_id, 's' || conv_id AS session_id, role, text AS content, CAST(NULL AS VARCHAR) AS answer_kind FROM conversations
UNION ALL SELECT t.turn_id || '/' || m.role, coalesce(l.session_id, 'session:' || t.contract_id || ':' || t.user_id), m.role, CASE m.role WHEN 'user' THEN t.text ELSE upper(substr(t.text, 1, 10)) END, CASE m.role WHEN 'assistant' THEN 'grounded' END
FROM turns t CROSS JOIN (VALUES ('user'), ('assistant')) m(role) LEFT JOIN latest l ON l.contract_id = t.contract_id AND l.user_id = t.user_id"""))
def r12b(spark, d):
    return _log(spark, d)[1].select("message_id", "session_id", "role", "content", "answer_kind")


@_register("r12_feedback", """
SELECT conv_id || '/' || turn AS message_id, role, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 2 = 1 THEN 'up' ELSE 'down' END END AS feedback FROM conversations""")
def r12c(spark, d):
    conv = E.table(spark, d, "conversations")
    key = E.concat(F.col("conv_id"), "/", F.col("turn")).alias("message_id")
    messages = conv.select(key, "role", F.lit(None).cast("string").alias("feedback"))
    votes = conv.select(key, F.explode(F.array(F.lit(1), F.lit(2))).alias("given_at"), F.col("turn").alias("t")).select(
        "message_id", "given_at", F.when((F.col("t") % 2 == 1) == (F.col("given_at") == 2), "up").otherwise("down").alias("feedback"))
    return R.record_feedback(messages, votes)


CTE["vectors_2048"] = (["doc_chunks"], f"""
SELECT chunk_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS weight FROM (
  SELECT chunk_id, dim, count(*) AS n FROM (SELECT chunk_id, {Q.fnv_dimension('tok', 2048)} AS dim FROM (SELECT chunk_id, unnest({_TOK.format(x='text')}) AS tok FROM doc_chunks)) GROUP BY 1, 2)""")


@_register("r13_reembed", with_ctes(["doc_chunks", "vectors_2048"], """
SELECT chunk_id, v.vector FROM doc_chunks LEFT JOIN (
  SELECT chunk_id, md5(string_agg(dim || ':' || CAST(floor(weight * 1e6 + 0.5) AS BIGINT), ',' ORDER BY dim)) AS vector FROM vectors_2048 GROUP BY 1) v USING (chunk_id)"""))
def r13(spark, d):
    out = R.reembed(TQ.doc_chunks(spark, d), 2048)
    vector = F.array_sort(F.transform("vector", lambda x: F.struct(x["dim"].alias("dim"), x["weight"].alias("weight"))))
    form = F.array_join(F.transform(vector, lambda x: F.concat_ws(":", x["dim"], F.floor(x["weight"] * 1e6 + 0.5))), ",")
    return out.select("chunk_id", F.when(F.size("vector") > 0, F.md5(form)).alias("vector"))
