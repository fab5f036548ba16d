"""Search: metadata, full-text, semantic and hybrid modes, related conversations, and their filters.

Where a filter stands is part of a mode's meaning: metadata and full-text searches take their rows first and filter then,
so a filtered page may be short; the semantic search filters first. The hybrid search inherits both.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors as V
from palimpsest.operators import fulltext as X
from palimpsest.schema import RESULT_COLUMNS, SearchMode

DEFAULT_LIMIT, RELATED_LIMIT = 25, 10
#: Rows of a page up to which it is broadcast to the conversations it is joined with.
BROADCAST_ROWS = 10_000


class MissingQuery(ValueError):
    """A mode that needs a query or a query vector got none."""


class MissingEmbedding(ValueError):
    """The conversation exists but has no embedding yet."""


@dataclass(frozen=True)
class SearchOptions:
    query: str | None = None
    mode: SearchMode | str | None = None
    date_from: float | None = None
    date_to: float | None = None
    model: str | None = None
    sources: list[str] = field(default_factory=list)
    risk_flags: list[str] = field(default_factory=list)
    topic_tags: list[str] = field(default_factory=list)
    limit: int | None = None
    sort: str | None = None  # accepted, without effect

    def rows(self) -> int:
        return DEFAULT_LIMIT if self.limit is None else self.limit


def effective_time() -> Column:
    return F.coalesce("update_time", "create_time", F.lit(0.0))


def contains_all(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(tags, F.array().cast("array<string>")))) == 0


def filtered(df: DataFrame, o: SearchOptions) -> DataFrame:
    """Rows that pass every filter that is set; a null model passes no model filter."""
    if o.sources:
        df = df.where(F.col("source").isin(*o.sources))
    if o.date_from is not None:
        df = df.where(effective_time() >= o.date_from)
    if o.date_to is not None:
        df = df.where(effective_time() <= o.date_to)
    if o.model is not None:
        df = df.where(F.col("default_model_slug") == o.model)
    if o.risk_flags:
        df = df.where(contains_all(F.col("risk_flags"), o.risk_flags))
    if o.topic_tags:
        df = df.where(contains_all(F.col("topic_tags"), o.topic_tags))
    return df


def as_results(df: DataFrame) -> DataFrame:
    missing = {"score": F.lit(None).cast("double"), "snippet": F.lit(None).cast("string")}
    return df.withColumns({k: v for k, v in missing.items() if k not in df.columns}).select(*RESULT_COLUMNS)


def metadata_search(conversations: DataFrame, o: SearchOptions) -> DataFrame:
    """The latest conversations, then the filters. Ties, as everywhere here, go to the smaller id."""
    page = conversations.select(*[c for c in RESULT_COLUMNS if c in conversations.columns])
    page = page.orderBy(F.coalesce("update_time", "create_time").desc_nulls_last(), "conversation_id").limit(o.rows())
    return as_results(filtered(page, o))


def fts_search(conversations: DataFrame, index: X.FullTextIndex, o: SearchOptions, snippets: bool = True) -> DataFrame:
    """The best matches by BM25, then the filters; snippets only for the page."""
    if o.query is None:
        raise MissingQuery("full-text search needs a query")
    _, phrases = X.parse(o.query)
    top = X.matches(index, o.query).orderBy("score", "conversation_id").limit(o.rows())
    kept = [c for c in RESULT_COLUMNS if c in conversations.columns]
    page = conversations.select(*kept, "transcript_text").join(F.broadcast(top) if o.rows() <= BROADCAST_ROWS else top, "conversation_id")
    page = filtered(page, o)
    if snippets:
        page = page.withColumn("snippet", X.snippet_col(F.col("transcript_text"), F.col("hits"), phrases))
    return as_results(page.drop("hits", "transcript_text"))


def semantic_search(conversations: DataFrame, vector: list[float] | None, o: SearchOptions) -> DataFrame:
    """The rows with embeddings that pass the filters, nearest first; what can't be compared scores 0."""
    if vector is None:
        raise MissingQuery("semantic search needs a query vector")
    query = F.array(*[F.lit(float(x)).cast("float") for x in vector]) if vector else F.array().cast("array<float>")
    rows = filtered(conversations.where(F.col("embedding").isNotNull()), o)
    scored = rows.withColumn("score", F.coalesce(V.cosine(F.col("embedding"), query), F.lit(0.0)))
    kept = [c for c in RESULT_COLUMNS if c in scored.columns]
    return as_results(scored.select(*kept).orderBy(F.desc("score"), "conversation_id").limit(o.rows()))


def related(conversations: DataFrame, conversation_id: str, limit: int = RELATED_LIMIT) -> DataFrame:
    """The nearest others. An unknown id has none; one without an embedding is an error."""
    own = conversations.where(F.col("conversation_id") == conversation_id).select("embedding").take(1)
    if own and own[0]["embedding"] is None:
        raise MissingEmbedding(conversation_id)
    vector = list(own[0]["embedding"]) if own else []
    others = conversations.where((F.col("conversation_id") != conversation_id) & F.lit(bool(own)))
    return semantic_search(others, vector, SearchOptions(limit=limit))


def fused(lists: list[DataFrame], limit: int | None = None, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (conversation_id, rank0): conversation_id, score."""
    all_lists = lists[0]
    for other in lists[1:]:
        all_lists = all_lists.unionByName(other)
    out = all_lists.groupBy("conversation_id").agg(F.sum(V.fusion_term(F.col("rank0"), k)).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "conversation_id").limit(limit)


def ranked(page: DataFrame, *order: Column | str) -> DataFrame:
    """rank0 within one page; its size is the search's limit, so a single task ranks it."""
    return page.withColumn("rank0", F.row_number().over(Window.orderBy(*order)) - 1)


def hybrid_search(conversations: DataFrame, index: X.FullTextIndex, vector: list[float] | None, o: SearchOptions, snippets: bool = True) -> DataFrame:
    """Both legs' pages, fused. A query that isn't one for the full-text leg leaves that leg empty. Where both legs have
    a conversation, the full-text leg's attributes (its snippet) stay."""
    semantic = ranked(semantic_search(conversations, vector, o), F.desc("score"), "conversation_id").withColumn("leg", F.lit(1))
    legs = semantic
    try:
        legs = ranked(fts_search(conversations, index, o, snippets), "score", "conversation_id").withColumn("leg", F.lit(0)).unionByName(semantic)
    except X.QuerySyntaxError:
        pass
    kept = [c for c in RESULT_COLUMNS if c not in ("conversation_id", "score")]
    out = legs.groupBy("conversation_id").agg(F.sum(V.fusion_term(F.col("rank0"))).alias("score"), F.min_by(F.struct(*kept), "leg").alias("row"))
    return out.orderBy(F.desc("score"), "conversation_id").limit(o.rows()).select("conversation_id", "score", "row.*").select(*RESULT_COLUMNS)


def search(conversations: DataFrame, index: X.FullTextIndex | None, o: SearchOptions) -> DataFrame:
    """By the mode that is set; without one, hybrid for a query and metadata for none."""
    mode = SearchMode(o.mode) if o.mode else SearchMode.HYBRID if o.query else SearchMode.METADATA
    if mode is SearchMode.METADATA:
        return metadata_search(conversations, o)
    if o.query is None:
        raise MissingQuery(f"{mode} search needs a query")
    index = index or X.FullTextIndex.build(conversations)
    if mode is SearchMode.FTS:
        return fts_search(conversations, index, o)
    vector = V.hashed_embedding(o.query).tolist()
    if mode is SearchMode.SEMANTIC:
        return semantic_search(conversations, vector, o)
    return hybrid_search(conversations, index, vector, replace(o, mode=mode))
