"""The queries of this subpackage, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from millrace.llm.anchors import ORACLE_OP10, op10_anchors
from millrace.llm.jaccard import ORACLE_OP6, op6_jaccard
from millrace.llm.media import op5_media_columns
from millrace.llm.near_vectors import ORACLE_OP8, op8_near_vectors
from millrace.llm.packing import op7_packing
from millrace.llm.piece_sampling import op1_piece_sampling
from millrace.llm.prefix_free import ORACLE_OP3, op3_prefix_free
from millrace.llm.quality import op2_quality
from millrace.llm.token_counts import op4_token_counts
from millrace.llm.warc import ORACLE_OP9, op9_warc

QUERIES = {f.__name__: f for f in (op1_piece_sampling, op2_quality, op3_prefix_free, op4_token_counts, op5_media_columns, op6_jaccard, op7_packing, op8_near_vectors, op9_warc, op10_anchors)}
ORACLE_SQL = {"op3_prefix_free": ORACLE_OP3, "op6_jaccard": ORACLE_OP6, "op8_near_vectors": ORACLE_OP8, "op9_warc": ORACLE_OP9, "op10_anchors": ORACLE_OP10}
