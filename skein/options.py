"""All tunable defaults in one frozen dataclass.

Every operator takes an ``Options`` (or keyword overrides) so that a job is fully described by its inputs and this
object: nothing is read from global state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values that must equal the reference's behaviour (defaults and separator list).
DEFAULT_CHUNK_SIZE = 512
DEFAULT_CHUNK_OVERLAP = 50
DEFAULT_REDUCED_DIMENSIONS = 64
DEFAULT_SEPARATORS = ("\n\n", "\n", ". ", " ", "")


@dataclass(frozen=True)
class Options:
    # chunking (characters, not tokens)
    chunk_size: int = DEFAULT_CHUNK_SIZE
    chunk_overlap: int = DEFAULT_CHUNK_OVERLAP
    separators: tuple[str, ...] = DEFAULT_SEPARATORS

    # default hashed embedder
    embedding_dim: int = 256

    # retrieval
    candidates_k: int = 20          # per sub-query, vector and full-text each
    top_k: int = 3                  # final documents kept by the query job
    rrf_k: float = 20.0             # fusion constant (the retrieval depth)
    fusion_mode: str = "distance"   # 'distance' (reference) or 'rank' (classic RRF)
    metric: str = "l2"              # l2 | cosine | dot
    enable_rewriting: bool = True
    enable_reranking: bool = False
    fts_pseudo_base: float = 0.1
    fts_pseudo_step: float = 0.05

    # approximate index: fitted on a bounded sample; every row is indexed
    index_sample: int = 50_000
    index_sample_bytes: int = 64 << 20
    index_lists: int | None = None      # None: square root of the rows
    index_part_dims: int = 4            # dimensions that share one byte of code
    index_block_rows: int = 100_000
    index_recall: float = 0.99          # share of true neighbours in the probed lists, measured on the sample
    index_rerank: int = 20              # candidates re-ranked exactly, times k

    # BM25
    bm25_k1: float = 1.2
    bm25_b: float = 0.75

    # context packing
    max_context_tokens: int = 2000
    chars_per_token: int = 4

    # reducer
    reduced_dims: int = DEFAULT_REDUCED_DIMENSIONS
    n_neighbors: int = 15
    min_dist: float = 0.1
    min_train_rows: int = 10
    reducer_method: str = "pca"             # pca | neighbours (graph layout)
    layout_points_per_part: int = 20_000    # points that one task moves at once
    layout_rounds: int = 16                 # exchanges of places between parts
    layout_epochs: int = 12                 # epochs between exchanges

    # topics
    min_cluster_size: int = 5
    n_topics: int | None = None     # None: round(sqrt(rows / 2)), at least 2
    kmeans_max_iter: int = 100      # Lloyd steps at most; they stop earlier when no centre moves
    kmeans_sample: int = 20_000     # rows of a sample for centres (``centres.bounded_sample``); topics are fitted on all rows
    kmeans_sample_bytes: int = 128 << 20    # of a sample; topics of as many bytes are fitted in one process, more in rounds over all
    clustering_method: str = "kmeans"               # kmeans | hdbscan (hierarchy) | density (one cut)
    min_samples: int | None = None                  # hdbscan: neighbour of the core distance; None: min_cluster_size
    cluster_selection_method: str = "eom"           # hdbscan: eom | leaf
    label_method: str = "hybrid"
    n_terms: int = 10
    n_representatives: int = 3

    # execution: sizes that decide between a broadcast and a shuffle, and block sizes of blocked operators
    broadcast_max_rows: int = 200_000
    knn_items_per_block: int = 50_000
    knn_broadcast_bytes: int = 64 << 20     # query vectors broadcast at once, or per query block beyond
    bm25_queries_per_block: int = 4_096
    bm25_rows_per_block: int = 20_000

    def with_(self, **kw) -> "Options":
        return replace(self, **kw)


DEFAULTS = Options()
