"""All queries of the engine over the driver tables; ``oracle`` has their SQL.

Each query calls the operators that a user calls; parameters are literals here and repeated in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import fold
from skein.functions import text as X
from skein.functions.vector import cosine
from skein.operators import embed, ingest, lexical, profile, search, status, windows
from skein.plans import stores
from skein.plans.oracle import ORACLE_SQL as OWN_SQL
from skein.sources.tables import START, conversation_chunks, embedding_units, table

SEARCH = "the and tion of"
PHRASES = "of.the in"


def messages(spark: SparkSession, d: str) -> DataFrame:
    return ingest.to_messages(conversation_chunks(spark, d))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions_of(messages(spark, d))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("session_ref", "tool", "git_branch", X.iso_time(F.col("started_at")).alias("started_at"), X.iso_time(F.col("last_activity_at")).alias("last_activity_at"), "message_count", "preview")


def recent_sessions(spark, d):
    return _shown(status.recent_sessions(sessions(spark, d), 5))


def recent_sessions_filtered(spark, d):
    return _shown(status.recent_sessions(sessions(spark, d), 7, ["codex", "cursor", "codex", ""], ["main"]))


def all_sessions(spark, d):
    return _shown(sessions(spark, d))


def session_detail_page(spark, d):
    page = status.session_detail(messages(spark, d), "codex:conv-1", offset=1, limit=4)
    return page.select("session_ref", "role", "message_index", X.iso_time(F.col("ts")).alias("ts"), "content", "id")


def session_by_ref(spark, d):
    return _shown(status.by_ref(sessions(spark, d), "cursor:conv-2"))


def manifest_resolve(spark, d):
    found = status.resolve_refs(sessions(spark, d), ["codex:conv-1", "codex:none", "cursor:conv-2", "codex:conv-1"])
    return found.select("position", "session_ref", "missing", F.coalesce("message_count", F.lit(0)).alias("message_count"))


def continuity_status(spark, d):
    s, m = sessions(spark, d), messages(spark, d)
    return status.tool_status(s, m).select("tool", "indexed_sessions", "indexed_messages", X.iso_time(F.col("newest")).alias("newest"))


def table_counts(spark, d):
    return status.counts({"sessions": sessions(spark, d), "messages": messages(spark, d), "retrieval_units": windows.retrieval_units(messages(spark, d), 4, 2)})


def active_session(spark, d):
    now = F.timestamp_seconds(F.lit(START + 48 * 3600))
    return _shown(status.active(sessions(spark, d).filter(F.col("last_activity_at") <= now), now))


def message_ids(spark, d):
    return messages(spark, d).select("id", "session_ref", "message_index", "content_hash")


def message_dedupe(spark, d):
    twice = conversation_chunks(spark, d).unionByName(conversation_chunks(spark, d))
    stored = messages(spark, d).filter("tool = 'codex'")
    return ingest.new_messages(ingest.to_messages(twice), stored).groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def first_non_null_merge(spark, d):
    s = sessions(spark, d)
    older = s.withColumns({"git_branch": F.when(F.col("tool") == "codex", F.lit("old")), "last_activity_at": F.timestamp_seconds(F.lit(START)), "message_count": F.lit(1).cast("long")})
    return _shown(ingest.merge_sessions(older, s))


def _unit_rows(units: DataFrame) -> DataFrame:
    return units.select("unit_id", "session_ref", "message_start_index", "message_end_index", X.iso_time(F.col("started_at")).alias("started_at"), X.iso_time(F.col("ended_at")).alias("ended_at"), F.md5("content").alias("content_md5"), F.md5("searchable_text").alias("searchable_md5"))


def sliding_windows_4_2(spark, d):
    return _unit_rows(windows.retrieval_units(messages(spark, d), 4, 2))


def sliding_windows_8_4(spark, d):
    return _unit_rows(windows.retrieval_units(messages(spark, d)))


def window_diff(spark, d):
    before = windows.retrieval_units(messages(spark, d).filter("message_index < 4"), 4, 2)
    gone, new = windows.window_diff(before, windows.retrieval_units(messages(spark, d), 4, 2))
    rows = gone.withColumn("action", F.lit("delete")).unionByName(new.withColumn("action", F.lit("insert")))
    return rows.select("action", "unit_id", "session_ref")


def unvectorized_backlog(spark, d):
    units = windows.retrieval_units(messages(spark, d), 4, 2)
    vectors = units.filter("tool in ('codex', 'cursor')").select("unit_id", "content_hash", F.lit("m1").alias("model"))
    return windows.backlog(units, vectors, "m1").select("unit_id", "session_ref")


def _index(spark, d):
    units = windows.retrieval_units(messages(spark, d), 4, 2)
    return units, lexical.postings(units), lexical.unit_stats(units)


def tokenize_documents(spark, d):
    terms = X.document_terms(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


def term_stats(spark, d):
    units, index, _ = _index(spark, d)
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, d):
    units, index, stats = _index(spark, d)
    scored = lexical.bm25(index, stats, SEARCH).withColumn("bm25", F.round("bm25", 6))
    return scored.orderBy("bm25", "unit_id").limit(20)


def phrase_match(spark, d):
    units, index, stats = _index(spark, d)
    return lexical.bm25(index, stats, PHRASES).select("unit_id", F.round("bm25", 6).alias("bm25"))


def keyword_search(spark, d):
    units, index, stats = _index(spark, d)
    found = search.keyword_search(index, stats, units, sessions(spark, d), SEARCH, 5)
    return search.match_rows(found).select("session_rank", "session_ref", "match", "unit_id", "keyword_score", "recency_score", "continuity_score", F.round("session_score", 6).alias("session_score"))


def _query_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = F.array(*map(F.lit, _query_vector(spark, d)))
    return v.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(25)


def _semantic_rows(found: DataFrame) -> DataFrame:
    return found.select("session_rank", "session_ref", "match", "unit_id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"), F.round("session_relevance", 6).alias("session_relevance"))


def vector_search(spark, d):
    units, vectors, s = embedding_units(spark, d)
    return _semantic_rows(search.semantic_search(units, vectors, s, _query_vector(spark, d), 5))


def vector_search_one(spark, d):
    """Limit 1 gives one session with one match."""
    units, vectors, s = embedding_units(spark, d)
    return _semantic_rows(search.semantic_search(units, vectors, s, _query_vector(spark, d), 1, tools=["codex", "cursor"]))


KEYWORDS = "label3 group2"


def _keywords(units: DataFrame, sessions: DataFrame) -> DataFrame:
    return search.keyword_ranks(lexical.postings(units), lexical.unit_stats(units), units, sessions, KEYWORDS, 5)


def hybrid_search(spark, d):
    units, vectors, s = embedding_units(spark, d)
    return _semantic_rows(search.semantic_search(units, vectors, s, _query_vector(spark, d), 5, _keywords(units, s)))


def confidence_gate_empty(spark, d):
    """A query vector that nothing resembles."""
    units, vectors, s = embedding_units(spark, d)
    far = [1.0 if i == 0 else 0.0 for i in range(64)]
    low = vectors.filter(cosine(F.col("vector"), F.array(*map(F.lit, far))) < 0.3)
    return _semantic_rows(search.semantic_search(units, low, s, far, 5))


def confidence_gate_keywords(spark, d):
    """Below the gate, keyword hits alone stay."""
    units, vectors, s = embedding_units(spark, d)
    far = [1.0 if i == 0 else 0.0 for i in range(64)]
    low = vectors.filter(cosine(F.col("vector"), F.array(*map(F.lit, far))) < 0.3)
    return _semantic_rows(search.semantic_search(units, low, s, far, 5, _keywords(units, s)))


def mean_pool_renorm(spark, d):
    whole = embed.pooled(table(spark, d, "embeddings"), "label", "embedding")
    return whole.select("label", F.posexplode("pooled").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def scalar_functions(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(t).alias("tokens"), F.md5(X.preview_text(t)).alias("preview_md5"), F.length(X.truncate_content(t)).alias("cut_length"), X.truncate_echo(t).alias("echo"), X.round_score(F.col("n_chars") / 977).alias("score"))


def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", X.iso_time(F.col("ts").cast("timestamp")).alias("iso"))


PATHS = ["file:///c:/Work/App/src", "C:\\Work\\App", "/c:/work/app/", "c:/work/apple", "//srv//share/", "/home/me/a%20b", "/home/me/50%", "/home/me/a+b", "c:/work/app"]


def path_scope(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("path"))
    rows = pages.unionByName(spark.createDataFrame([(p,) for p in PATHS], "path string")).distinct()
    return rows.select("path", X.normalize_path(F.col("path")).alias("normal"), X.path_in_project(F.col("path"), F.lit("c:/work/app")).alias("inside"), X.encode_path(F.col("path")).alias("encoded"))


def sanitize_errors(spark, d):
    return table(spark, d, "pages").select("page_id", X.sanitize_error(F.concat(F.lit("cannot open /var/data/x.db or C:\\tmp\\y: '"), "url", F.lit("'"))).alias("said"))


def running_index(spark, d):
    takes = F.col("event_type") != "view"
    return table(spark, d, "events").select("event_id", "user_id", fold.running_index(takes, "user_id", "event_id").alias("message_index"))


def forward_fill_state(spark, d):
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, d, "events").select("event_id", "user_id", F.coalesce(fold.carried(bought, "user_id", "event_id"), F.lit(-1)).alias("state"))


def _event_chunks(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def incremental_cutoff(spark, d):
    since = F.lit("2024-01-15 00:00:00").cast("timestamp")
    rows = ingest.after_cutoff(_event_chunks(spark, d), since).withColumn("run", F.lit("since"))
    whole = ingest.after_cutoff(_event_chunks(spark, d), F.timestamp_seconds(F.lit(0))).withColumn("run", F.lit("full"))
    return rows.unionByName(whole).groupBy("run", "tool").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def cursor_advance(spark, d):
    return ingest.cursors(_event_chunks(spark, d)).select("tool", X.iso_time(F.col("last_timestamp")).alias("last_timestamp"))


def late_rows(spark, d):
    """Rows that a second run drops for good: a first run up to the middle of the month sets the cursors, and all older rows come again."""
    rows = _event_chunks(spark, d)
    cursor = ingest.cursors(rows.filter("ts < '2024-01-15'"))
    late = rows.join(cursor, "tool").filter(F.col("ts") <= F.col("last_timestamp"))
    return late.groupBy("tool").agg(F.count("*").alias("n"))


def json_shape_fingerprint(spark, d):
    return profile.fingerprint(table(spark, d, "events").select(F.col("event_type").alias("record_type"), F.col("props").alias("json")))


def drift_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("tool"), F.concat(F.lit("no field "), (F.col("event_id") % 3).cast("string")).alias("surprise"), F.concat(F.lit("events:"), F.col("event_id").cast("string")).alias("location"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("records"))
    return ingest.drift_summary(rows)


def ranking_metrics(spark, d):
    """Self-retrieval by label: rank of the nearest vector of the same label among the ten nearest."""
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = search.nearest(q, v, 10)
    labels = v.select("vec_id", "label")
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    ranked = near.join(labels, "vec_id").join(asked, "query_id").filter("label = wanted").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return search.ranking_metrics(ranked, q.select("query_id"))


def canary(spark, d):
    now = F.timestamp_seconds(F.lit(START + 100 * 3600))
    return profile.canary(conversation_chunks(spark, d), now)


def segment_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.segments(F.coalesce("text", F.lit(""))).alias("s"))
    return rows.select("doc_id", F.size("s").alias("segments"), F.md5(F.array_join("s", "|")).alias("segments_md5"))


def _is_query(name: str, f) -> bool:
    return callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == __name__


QUERIES = {n: f for n, f in list(globals().items()) if _is_query(n, f) and n not in ("messages", "sessions")} | stores.QUERIES
ORACLE_SQL = OWN_SQL | stores.ORACLE_SQL
