"""E3 (query) and E2 (search) jobs over a whole DataFrame of questions.

E3: analyse (M3/M4, U2) -> sub-queries -> vector + full-text hits (J1, J2, W2, U1) -> fusion (A4, K3) -> optional
re-rank (A5, M5, K4) -> cut (K5) -> repack (M7/M8) -> answer (M6) -> confidence (A6), sources (P8). One row per
question, including questions that found nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.embedding import HashingEmbedder
from ..operators import context as cx
from ..operators import fusion, search
from ..options import DEFAULTS, Options
from ..util import bounded_broadcast


def answer_questions(chunks: DataFrame, questions: DataFrame, opts: Options = DEFAULTS, *, embedder=None,
                     rewriter=None, scorer=None, generator=None, vec_col: str = "embedding",
                     reducer=None, fts_index=None, summarizer=None) -> DataFrame:
    """(query_id, query, clarified, answer, sources, n_sources, confidence, n_candidates, unique_sources,
    n_sub_queries).

    ``chunks``: the chunk table (id, chunk_text, file_path, chunk_index, embedding, ...). ``questions``:
    (query_id, query_text). Hooks: ``rewriter.rewrite(col)->struct`` (or
    ``rewrite_prompt(prompt_col)->struct`` for a model that is to get the rewriting prompt), ``scorer(query, text)->double column``,
    ``generator.generate(prompt_col)->string`` (null = failure, the extractive fallback is used). ``reducer``: a
    fitted reducer; it is used (P9) only when the table holds reduced vectors, decided once per job. ``fts_index``:
    (postings, (N, avgdl)) from ``jobs.load_fts_index``, to skip tokenising the corpus per job. ``summarizer``:
    ``summarize(prompt_col)->string`` for the summary-first context (M9); null keeps the plain context.
    """
    embedder = embedder or HashingEmbedder(opts.embedding_dim)
    # The question side is small and read by every later step: analysed (and rewritten) once, embedded once.
    analysis = fusion.analyze(questions, opts, rewriter).checkpoint()
    subq = fusion.sub_queries(analysis)
    query_vec = subq.select("qk", embedder.embed(F.col("sub_query")).alias("qvec")).checkpoint()
    if reducer is not None:
        has_reduced = chunks.where(F.col("reduced_embedding").isNotNull() & (F.size("reduced_embedding") > 0)) \
            .limit(1).count() > 0
        reducer = reducer if has_reduced else None
    postings, stats_ = fts_index if fts_index is not None else (None, None)
    hits = fusion.retrieve(chunks, subq, opts, embedder, vec_col=vec_col, query_vec=query_vec, reducer=reducer,
                           postings=postings, stats=stats_)
    # Retrieval ends in a small frame (questions x sub-queries x 2k rows at most): materialise it once in the shared
    # checkpoint folder so the size check and the later steps do not recompute the searches.
    fused = fusion.fuse(hits, opts).checkpoint()
    ana_small, _ = bounded_broadcast(analysis.select("query_id", "query_text", "clarified_intent", "context_needed"),
                                     opts.broadcast_max_rows)
    # The candidates (at most questions x sub-queries x 2k rows) are broadcast when provably small, so the chunk
    # table streams past them instead of being shuffled on id.
    fused_b, _ = bounded_broadcast(fused, opts.broadcast_max_rows)
    text = chunks.select("id", "chunk_text", "file_path", "chunk_index")
    cands = text.join(fused_b, "id").join(ana_small, "query_id")
    if opts.enable_reranking:
        ranked = fusion.rerank(cands, opts, scorer)
    else:
        ranked = cands
    n_ctx = F.least(F.lit(opts.top_k), tx.context_size(F.col("context_needed")))
    ctx_docs = ranked.where(F.col("pos") <= n_ctx)
    conf = fusion.confidence(ranked, opts.top_k)
    packed = cx.repack(ctx_docs.select("query_id", "pos", "file_path", "chunk_text"), analysis,
                       tx.max_chars(opts.max_context_tokens, opts.chars_per_token))
    src = (ctx_docs.where(F.col("file_path").isNotNull()).groupBy("query_id")
           .agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws("#", "file_path",
                                                                          F.col("chunk_index").cast("string"))
                                                      .alias("s")))).alias("_s")))
    stats = cands.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"),
                                          F.countDistinct("file_path").alias("unique_sources"))
    if summarizer is not None:
        prompt = F.format_string(tx.SUMMARY_PROMPT.replace("{query}", "%s").replace("{context}", "%s"),
                                 F.col("clarified_intent"), F.substring("context", 1, 1501))
        packed = (packed.join(analysis.select("query_id", "clarified_intent"), "query_id")
                  .select("query_id", cx.summary_context(F.col("context"), summarizer.summarize(prompt))
                          .alias("context")))
    out = (analysis.join(packed, "query_id", "left").join(src, "query_id", "left")
           .join(conf, "query_id", "left").join(stats, "query_id", "left"))
    fallback = F.concat(F.lit(tx.FALLBACK_ANSWER_PREFIX), F.substring("context", 1, 501), F.lit("..."))
    if generator is not None:
        generated = tx.strip_think_tags(generator.generate(tx.instructed_prompt(F.col("context"),
                                                                                F.col("clarified_intent"))))
        answer = F.coalesce(generated, fallback)
    else:
        answer = fallback
    found = F.coalesce(F.col("n_candidates"), F.lit(0)) > 0
    sources = F.coalesce(F.array_join(F.transform("_s", lambda x: x["s"]), ";"), F.lit(""))
    return out.select(
        "query_id", F.col("query_text").alias("query"), F.col("clarified_intent").alias("clarified"),
        F.when(found, answer).otherwise(F.lit(tx.NO_DOCUMENTS_ANSWER)).alias("answer"),
        F.when(found, sources).otherwise(F.lit("")).alias("sources"),
        F.when(found, F.coalesce(F.size("_s"), F.lit(0))).otherwise(0).cast("long").alias("n_sources"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("n_candidates"), F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(F.col("unique_sources"), F.lit(0)).cast("long").alias("unique_sources"),
        F.size("sub_queries").cast("long").alias("n_sub_queries"))


def search_chunks(chunks: DataFrame, questions: DataFrame, k: int = 5, opts: Options = DEFAULTS, *,
                  embedder=None, vec_col: str = "embedding") -> DataFrame:
    """K nearest chunks per question with file, chunk index, distance and preview."""
    embedder = embedder or HashingEmbedder(opts.embedding_dim)
    qv = questions.select("query_id", embedder.embed(F.col("query_text")).alias("qvec"))
    hits = search.knn_search(chunks, qv, k, id_col="id", vec_col=vec_col, query_id_col="query_id",
                             query_vec_col="qvec", metric=opts.metric, opts=opts)
    hits_b, _ = bounded_broadcast(hits.checkpoint(), opts.broadcast_max_rows)
    text = chunks.select("id", "chunk_text", "file_path", "chunk_index")
    return text.join(hits_b, "id").select("query_id", F.col("rank").cast("long").alias("rank"), "id", "file_path",
                                        "chunk_index", "distance", tx.preview(F.col("chunk_text")).alias("preview"))


def answers_json(answers: DataFrame) -> DataFrame:
    """Each answer row as one JSON document."""
    return answers.select("query_id", F.to_json(F.struct(*[c for c in answers.columns])).alias("json"))
