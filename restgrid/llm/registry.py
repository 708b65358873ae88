"""The queries of this subpackage and their SQL."""

from . import oracle
from .alignment import op13_token_alignment
from .chains import op5_substring_chains
from .jaccard import op4_ngram_jaccard_join
from .mixing import op1_mix_sources
from .pieces import op2_sentencepiece
from .quality import op10_quality_divergence
from .scoring import op3_lm_scoring
from .search import op8_topk_search
from .suffixes import op7_suffix_array_dedup
from .tokens import op12_token_counts
from .toxicity import op9_toxicity_machine
from .trie import op11_prefix_trie
from .warc import OP6_SQL, op6_warc_from_arc

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_substring_chains": op5_substring_chains,
    "op6_warc_from_arc": op6_warc_from_arc,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_topk_search": op8_topk_search,
    "op9_toxicity_machine": op9_toxicity_machine,
    "op10_quality_divergence": op10_quality_divergence,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op3_lm_scoring": oracle.LM,
    "op4_ngram_jaccard_join": oracle.JACCARD,
    "op6_warc_from_arc": OP6_SQL,
    "op7_suffix_array_dedup": oracle.SUFFIX,
    "op8_topk_search": oracle.SEARCH,
    "op10_quality_divergence": oracle.QUALITY,
    "op11_prefix_trie": oracle.TRIE,
}
