"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from cellwave.llm.bpe import op5_bpe_round_trip
from cellwave.llm.chat import op10_chat_format
from cellwave.llm.langid import op9_language_id
from cellwave.llm.linededup import OP8_SQL, op8_line_dedup
from cellwave.llm.mixing import op1_source_mix
from cellwave.llm.ngramjoin import op4_ngram_jaccard
from cellwave.llm.oracles import OP1_SQL, OP4_SQL, OP10_SQL
from cellwave.llm.periodic import op11_periodic_runs
from cellwave.llm.phrases import OP12_SQL, op12_phrase_collocations
from cellwave.llm.quality import op13_quality_trees
from cellwave.llm.repeats import op3_suffix_dedup
from cellwave.llm.tiff import op7_tiff_pages
from cellwave.llm.topk import OP2_SQL, op2_exact_top_k
from cellwave.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_toxicity": op6_toxicity,
    "op7_tiff_pages": op7_tiff_pages,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_quality_trees": op13_quality_trees,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": OP1_SQL,
    "op2_exact_top_k": OP2_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_chat_format": OP10_SQL,
    "op12_phrase_collocations": OP12_SQL,
}
