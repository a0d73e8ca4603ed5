"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.decontamination import op7_decontamination
from tidemark.llm.jaccard_join import OP8_SQL, op8_jaccard_join
from tidemark.llm.line_dedup import OP4_SQL, op4_line_dedup
from tidemark.llm.mixing import OP9_SQL, op9_mixing
from tidemark.llm.quality import op2_quality
from tidemark.llm.sharding import op5_hilbert_shards
from tidemark.llm.token_counts import op10_token_counts
from tidemark.llm.toxicity import op6_toxicity
from tidemark.llm.topk_search import OP1_SQL, op1_topk_search
from tidemark.llm.url_filter import op3_url_filter

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
}
ORACLES = {"op1_topk_search": OP1_SQL, "op4_line_dedup": OP4_SQL, "op8_jaccard_join": OP8_SQL, "op9_mixing": OP9_SQL}
