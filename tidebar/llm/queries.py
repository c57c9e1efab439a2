"""Queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from . import sql
from .bpe import op5_byte_bpe
from .centroids import OP11_SQL, op11_centroid_clusters
from .conversations import OP13_SQL, op13_conversation_repair
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .html_blocks import op7_block_labeller
from .line_dedup import OP12_SQL, op12_line_dedup
from .near_dedup import op3_prob_minhash
from .packing import op8_best_fit_packing
from .pii import op10_pii_surrogates
from .quality import op1_compression_bands
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op6_classifier_chain

QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands, op2_suffix_dedup, op3_prob_minhash, op4_exact_dedup, op5_byte_bpe,
        op6_classifier_chain, op7_block_labeller, op8_best_fit_packing, op9_substring_dedup, op10_pii_surrogates,
        op11_centroid_clusters, op12_line_dedup, op13_conversation_repair,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_prob_minhash": sql.OP3, "op4_exact_dedup": OP4_SQL, "op9_substring_dedup": sql.OP9, "op11_centroid_clusters": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_conversation_repair": OP13_SQL}
