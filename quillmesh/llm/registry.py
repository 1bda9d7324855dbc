"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import jaccard_join, rp_forest, topk, warc
from .bpe_automaton import op8_bpe_codec
from .chat import op12_chat
from .quality import op2_quality
from .rp_forest import op1_embedding_neardup
from .secrets_cnn import op10_secrets
from .spelling import op11_spelling
from .topk import op3_topk
from .toxicity import op7_toxicity
from .jaccard_join import op4_jaccard_join
from .packing import op5_packing
from .token_counts import op6_token_counts
from .warc import op9_warc
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_embedding_neardup, op2_quality, op3_topk, op4_jaccard_join, op5_packing, op6_token_counts, op7_toxicity, op8_bpe_codec, op9_warc, op10_secrets, op11_spelling, op12_chat, op13_whitening)}

SQL: dict[str, str] = {
    "op1_embedding_neardup": rp_forest.oracle_sql(),
    "op3_topk": topk.oracle_sql(),
    "op4_jaccard_join": jaccard_join.oracle_sql(),
    "op9_warc": warc.oracle_sql(),
}
