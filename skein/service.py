"""The query interface over a store: what a user of the engine calls.

Results are DataFrames where rows are many and plain values where a page or a status is asked for. A refresh runs at most
once at a time and at most every ``ttl`` seconds; a caller waits up to ``budget`` seconds and then gets what is there.
"""

from __future__ import annotations

import inspect
import threading
import time
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import render
from skein.functions.text import iso_time, query_phrases, sanitize_text
from skein.operators import embed, lexical, search, status, windows
from skein.operators.store import Store

# Seconds between refreshes, and that a caller waits for one; windows embedded a batch.
TTL, BUDGET, VECTOR_BATCH = 30.0, 4.0, 512


class Service:
    def __init__(self, spark: SparkSession, store: Store, provider: embed.EmbeddingProvider | None = None, refresh: Callable[[], dict[str, str]] | None = None, ttl: float = TTL, budget: float = BUDGET, project_root: str | None = None):
        self.spark, self.store, self.provider, self._refresh = spark, store, provider, refresh
        self.ttl, self.budget, self._lock, self._thread, self._at = ttl, budget, threading.Lock(), None, -1e9
        self.project_root = project_root
        self.embedding_error: str | None = None
        self.mode_used: str | None = None

    def refresh(self) -> bool:
        """Whether the tables are up to date when it returns."""
        if self._refresh is None:
            return True
        with self._lock:
            running = self._thread is not None and self._thread.is_alive()
            if not running and time.monotonic() - self._at < self.ttl:
                return True
            if not running:
                self._at = time.monotonic()
                self._thread = threading.Thread(target=self._refresh, daemon=True)
                self._thread.start()
            thread = self._thread
        thread.join(self.budget)
        return not thread.is_alive()

    def recent_sessions(self, limit: float | None = None, tools=None, branches=None) -> DataFrame:
        self.refresh()
        return status.recent_sessions(self.store.sessions(), limit, tools, branches)

    def indexed_sessions(self, limit: float | None = None, tools=None, branches=None) -> DataFrame:
        """As ``recent_sessions``, of what is stored already: no refresh."""
        return status.recent_sessions(self.store.sessions(), limit, tools, branches)

    def session_detail(self, ref: str, offset: int = 0, limit: float | None = None) -> DataFrame:
        return status.session_detail(self.store.messages(), ref, offset, limit)

    def session_by_ref(self, ref: str) -> DataFrame:
        return status.by_ref(self.store.sessions(), ref)

    def vectorize(self, seconds: float = 6.0, batch: int = VECTOR_BATCH) -> int:
        """Embed the backlog, newest windows first, a committed batch at a time until ``seconds`` have passed; batches done."""
        end, done = time.monotonic() + seconds, 0
        while self.provider is not None and time.monotonic() < end:
            units, vectors = self.store.units(), self.store.vectors()
            left = units if vectors is None else windows.backlog(units, vectors, self.provider.model)
            some = left.orderBy(F.desc("ended_at"), "unit_id").limit(batch)
            if some.isEmpty():
                break
            self.store.add({"vectors": embed.vectorize(some, self.provider)})
            done += 1
        return done

    def loading(self) -> bool:
        """Whether the provider says that its model is not ready yet."""
        ready = getattr(self.provider, "ready", None)
        return ready is not None and not ready()

    def search(self, query: str, limit: float | None = None, tools=None, branches=None, mode: str | None = None) -> DataFrame | None:
        """Matches of the best sessions, or None for a blank query. Hybrid falls back to keywords where embedding fails or its model
        is loading; vector raises. ``mode_used`` tells which it was.
        """
        if not query.strip():
            return None
        self.refresh()
        mode, limit = search.normalize_mode(mode), search.normalize_limit(limit)
        units, sessions = self.store.units(), self.store.sessions()
        terms = sorted({t for p in query_phrases(query) for t in lexical.phrase_parts(p)})
        index, stats = self.store.index(terms) or (lexical.postings(units), lexical.unit_stats(units))
        self.mode_used = "keyword"
        keyword = lambda: search.keyword_search(index, stats, units, sessions, query, limit, tools, branches)
        if mode == "keyword":
            return keyword()
        try:
            if self.provider is None:
                raise RuntimeError("no embedding provider")
            if self.loading():
                raise RuntimeError("the embedding model is loading")
            self.vectorize()
            vector = self.provider.embed_batch([query])[0]
        except Exception as e:
            if mode == "vector":
                raise
            self.embedding_error = sanitize_text(str(e))
            return keyword()
        vectors = self.store.vectors()
        if vectors is None:
            return keyword()
        self.mode_used = mode
        ranks = search.keyword_ranks(index, stats, units, sessions, query, limit, tools, branches) if mode == "hybrid" else None
        return search.semantic_search(units, vectors.filter(F.col("model") == self.provider.model), sessions, vector, limit, ranks, tools, branches)

    def answer(self, query: str, limit: float | None = None, tools=None, branches=None, mode: str | None = None) -> dict:
        """A search as one value: the mode that was used, sessions with their matches, and how far embedding has come."""
        found = self.search(query, limit, tools, branches, mode)
        rows = [] if found is None else search.match_rows(found).orderBy("session_rank", "match").collect()  # three matches a session, 100 sessions at most
        sessions: dict[str, dict] = {}
        for r in rows:
            score = {"score": r.session_score, "relevance": r.session_relevance}
            one = sessions.setdefault(r.session_ref, {"session_ref": r.session_ref, **score, "matches": []})
            one["matches"].append({k: r[k] for k in ("unit_id", "message_start_index", "message_end_index", "preview", "relevance", "semantic_score", "keyword_score", "recency_score", "continuity_score")})
        known = {r.session_ref: r.asDict() for r in self.store.sessions().filter(F.col("session_ref").isin(list(sessions))).collect()} if sessions else {}
        shown = ("tool", "git_branch", "git_commit", "message_count", "preview", "source_path")
        sessions = {ref: one | {k: known[ref][k] for k in shown if ref in known} for ref, one in sessions.items()}
        return {"query": query, "mode": self.mode_used, "sessions": list(sessions.values()), "progress": self.progress()}

    def progress(self) -> dict:
        """Windows, those with a current vector, and whether the model is loading."""
        units, vectors = self.store.units(), self.store.vectors()
        total = 0 if units is None else units.count()
        left = total if vectors is None or units is None or self.provider is None else windows.backlog(units, vectors, self.provider.model).count()
        return {"retrieval_units": total, "vectorized_units": total - left, "scanning": self.scanning(), "loading": self.loading(), "embedding_error": self.embedding_error}

    def scanning(self) -> bool:
        """Whether a refresh is still running."""
        return self._thread is not None and self._thread.is_alive()

    def status(self) -> dict:
        s, m, u, v, said = self.store.sessions(), self.store.messages(), self.store.units(), self.store.vectors(), self.store.settings()
        n = lambda df: 0 if df is None else df.count()
        tools = [] if s is None else [r.asDict() | {"last_error": said.get(f"last_error:{r.tool}")} for r in status.tool_status(s, m).orderBy("tool").collect()]
        return {"last_scan_at": said.get("last_scan_at"), "sessions": n(s), "messages": n(m), "retrieval_units": n(u), "vectorized_units": n(v), "embedding_error": self.embedding_error, "tools": tools}

    def manifest(self, refs: list[str] | None = None, limit: float | None = None, tools=None, branches=None, correlation_id: str | None = None) -> dict:
        """Sessions with pointers to their details, and requested references that are not stored."""
        if refs:
            rows = status.resolve_refs(search.scope(self.store.sessions(), tools, branches), refs).orderBy("position").collect()
        else:
            rows = self.recent_sessions(limit, tools, branches).withColumn("missing", F.lit(False)).collect()
        at = lambda t: None if t is None else t.isoformat(timespec="milliseconds") + "Z"
        found = [
            {"session_ref": r.session_ref, "tool": r.tool, "started_at": at(r.started_at), "last_activity_at": at(r.last_activity_at), "message_count": r.message_count, "source_path": r.source_path, "retrieve": {"query": "session_detail", "session_ref": r.session_ref}}
            for r in rows if not r.missing
        ]
        sessions, said = self.store.sessions(), self.store.settings()
        return {
            "schema_version": "handoff-manifest/v1", "generated_at": at(datetime.now(UTC).replace(tzinfo=None)), "correlation_id": (correlation_id or "").strip() or None, "project": {"root": self.project_root},
            "freshness": {"last_scan_at": said.get("last_scan_at"), "indexed_sessions": 0 if sessions is None else sessions.count(), "indexing": {k: v for k, v in self.progress().items() if k != "embedding_error"}},
            "sessions": found, "missing_session_refs": [r.session_ref for r in rows if r.missing], "contract": {"authority": "raw-transcript", "detail": "session_detail", "correlation": "kept by the caller alone"},
        }

    # calls by name

    def call(self, name: str, arguments: Mapping | None = None) -> dict:
        """A query by its name as an envelope: its value with a text of it, or an error of a kind; arguments that are no mapping count as none.

        ``format`` "markdown" gives the text as Markdown. Names that are no query, arguments that it does not take and everything that goes wrong
        inside it can be told apart by ``kind`` (not_found, invalid_argument, others).
        """
        given = dict(arguments) if isinstance(arguments, Mapping) else {}
        markdown = given.pop("format", None) == "markdown"
        try:
            if name not in CALLS:
                raise LookupError(f"no query {name}")
            run, shown = CALLS[name]
            try:
                bound = inspect.signature(run).bind(self, **given)
            except TypeError as e:
                raise ValueError(f"arguments of {name}: {e}") from None
            value = run(*bound.args, **bound.kwargs)
            return render.success(shown(value) if markdown else value)
        except Exception as e:  # every failure is an answer
            return render.failure(e)

    def _page(self, session_ref: str, offset: int = 0, limit: float | None = None) -> dict:
        if not isinstance(session_ref, str) or not session_ref.strip():
            raise ValueError("session_ref is empty")
        limit = search.normalize_limit(limit, search.DETAIL_LIMIT)
        return {"session_ref": session_ref, "offset": offset, "limit": limit, "messages": [r.asDict() for r in self.session_detail(session_ref, offset, limit).collect()]}

    def _recent(self, limit: float | None = None, tools=None, branches=None) -> dict:
        return {"sessions": [r.asDict() for r in self.recent_sessions(limit, tools, branches).collect()]}

    def _search(self, query: str, limit: float | None = None, tools=None, branches=None, mode: str | None = None) -> dict:
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query is empty")
        return self.answer(query, limit, tools, branches, mode)

    def active(self) -> dict | None:
        rows = status.active(self.store.sessions(), F.current_timestamp()).withColumn("last_activity_at", iso_time(F.col("last_activity_at"))).collect()
        return rows[0].asDict() if rows else None


#: Queries by name, and how each one's value is shown as Markdown.
CALLS: dict[str, tuple[Callable, Callable]] = {
    "recent_sessions": (Service._recent, lambda v: render.session_list(v["sessions"])),
    "session_detail": (Service._page, lambda v: render.session_detail(v["session_ref"], v["messages"], v["offset"], v["limit"])),
    "search_sessions": (Service._search, render.search_answer),
    "status": (Service.status, render.status),
    "manifest": (Service.manifest, render.manifest),
}
