"""The subpackage's queries for ``__spark_entry__`` and their SQL."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, url_filter, warc
from .embedding_dedup import op1_embedding_dedup
from .exact_dedup import op5_exact_dedup
from .packing import op8_packing
from .quality import op7_quality
from .sentence_pieces import op6_sentence_pieces
from .simhash import op2_simhash
from .token_counts import op4_token_counts
from .token_files import op9_token_files
from .url_filter import op10_url_filter
from .warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_simhash, op3_warc, op4_token_counts, op5_exact_dedup, op6_sentence_pieces, op7_quality, op8_packing, op9_token_files, op10_url_filter)}
SQL: dict[str, str] = {"op1_embedding_dedup": embedding_dedup.SQL, "op3_warc": warc.SQL, "op5_exact_dedup": exact_dedup.SQL, "op10_url_filter": url_filter.SQL}
