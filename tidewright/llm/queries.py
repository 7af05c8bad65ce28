"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import manifest, mixing, prefix_trie, warc
from .bpe import op12_backtracking_bpe
from .decontamination import op4_simhash_windows
from .html_text import op6_block_rules
from .manifest import op11_pointer_jumping
from .mixing import op9_iterative_proportional_fitting
from .near_dup import op10_setsketch
from .prefix_trie import op13_interval_trie
from .quality import op5_covariance_determinant
from .sharding import op1_balanced_label_propagation
from .suffix_dedup import op3_difference_cover
from .tokens import op2_ranked_byte_codes
from .toxicity import op7_label_model
from .warc import op8_revisit_resolution

QUERIES = {
    f.__name__: f
    for f in (
        op1_balanced_label_propagation, op2_ranked_byte_codes, op3_difference_cover, op4_simhash_windows, op5_covariance_determinant, op6_block_rules, op7_label_model,
        op8_revisit_resolution, op9_iterative_proportional_fitting, op10_setsketch, op11_pointer_jumping, op12_backtracking_bpe, op13_interval_trie,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op8_revisit_resolution": warc.ORACLE, "op9_iterative_proportional_fitting": mixing.oracle(), "op11_pointer_jumping": manifest.ORACLE, "op13_interval_trie": prefix_trie.ORACLE,
}
