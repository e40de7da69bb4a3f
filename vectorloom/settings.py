"""Defaults shared by the operators; every one of them can be overridden by an argument."""

from __future__ import annotations

# Chunk sizes in characters.
CHUNK_MAX_SIZE = 1000
CHUNK_OVERLAP = 100

# Token thresholds of the length buckets and encode batch sizes per bucket.
SHORT_TOKENS = 64
MEDIUM_TOKENS = 256
BATCH_SIZES = {"short": 256, "medium": 64, "long": 16}

# Limits of the memory-driven batch size.
MIN_BATCH = 16
MAX_BATCH = 512
AVAILABLE_MEMORY_MB = 4096.0
MEMORY_SHARE = 0.7

# Store commits.
STREAM_BATCH_SIZE = 256
COMMIT_ROWS = 1000
COMMIT_DELAY_MS = 100

# Deltas of a type that readers merge before a stream merges them.
MERGE_DELTAS = 64

# Search.
SEARCH_K = 10
SEARCH_MIN_SCORE = 0.3
ANSWER_LIMIT = 5
OVERFETCH = 2

# Vector indexes.
EMBEDDING_DIM = 1024
MIN_TRAINING_ROWS = 100
# Rows drawn to train on, for every cell or code.
TRAINING_ROWS_A_CENTER = 256
# An index is to be trained anew when it holds so many times the rows it was trained with, when the rows
# added since lie so many times as far from their cells, or when its largest cell has grown so much more than
# the others.
RETRAIN_ROWS = 4.0
RETRAIN_DISTANCE = 1.25
RETRAIN_CELL = 4.0
NPROBE = 10
IVF_NLIST = 100
PQ_M = 8
PQ_NBITS = 8

# Files.
MAX_FILE_BYTES = 50 * 1024 * 1024
ALLOWED_EXTENSIONS = (".md",)
LARGE_TEXT_BYTES = 100 * 1024 * 1024

# Scores are computed in double precision and compared at this many decimals, close to its end: only
# the last bits are left out, so equal vectors tie on every plan (whatever the partitioning or matrix
# kernel) and the id breaks the tie. Six decimals are for display.
SCORE_DIGITS = 12

# Queries travel to the tasks as one broadcast below both bounds; larger query sets are dealt to blocks.
QUERY_BROADCAST_ROWS = 4096
QUERY_BROADCAST_BYTES = 96 * 1024 * 1024

# Queries that a task of the dealt blocks holds, within the same bytes.
QUERY_BLOCK_ROWS = 16_384

# Ranked hits are broadcast in later joins up to this many rows.
HIT_BROADCAST_ROWS = 500_000

# Vectors scored together by a task, at most.
VECTOR_BLOCK_ROWS = 50_000

# JSON files that Spark parses as one value; its own limit is 128 MiB.
WHOLE_JSON_BYTES = 64 * 1024 * 1024
