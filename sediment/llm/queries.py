"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from sediment.llm.ann_search import op5_multiprobe_neighbours
from sediment.llm.mixing import OP9_SQL, op9_ipf_mixture
from sediment.llm.ngram_join import op6_count_vector_jaccard
from sediment.llm.packing import op7_best_fit_packing
from sediment.llm.quality_crf import op8_line_crf_quality
from sediment.llm.quality_rules import OP4_SQL, op4_quality_cascade
from sediment.llm.secret_scan import op2_guess_cost_secrets
from sediment.llm.toxicity import op10_weak_supervision_toxicity
from sediment.llm.url_filter import OP1_SQL, op1_bloom_cascade_urls
from sediment.llm.warc import OP3_SQL, op3_warc_salvage

QUERIES = {f.__name__: f for f in (op1_bloom_cascade_urls, op2_guess_cost_secrets, op3_warc_salvage, op4_quality_cascade, op5_multiprobe_neighbours, op6_count_vector_jaccard, op7_best_fit_packing, op8_line_crf_quality, op9_ipf_mixture, op10_weak_supervision_toxicity)}
ORACLE_SQL: dict[str, str] = {"op1_bloom_cascade_urls": OP1_SQL, "op3_warc_salvage": OP3_SQL, "op4_quality_cascade": OP4_SQL, "op9_ipf_mixture": OP9_SQL}
