"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from gridlark.llm.chaining import op8_substring_dedup
from gridlark.llm.counts import op6_token_counts
from gridlark.llm.decontaminate import op1_benchmark_decontamination
from gridlark.llm.jaccard import OP7_SQL, op7_ngram_jaccard_join
from gridlark.llm.langid import op9_language_id
from gridlark.llm.licenses import OP4_SQL, op4_license_scan
from gridlark.llm.lines import OP13_SQL, op13_line_dedup
from gridlark.llm.quality import op5_quality_rules
from gridlark.llm.sentencepiece import op3_sentencepiece
from gridlark.llm.suffix import op2_suffix_array_dedup
from gridlark.llm.trie import OP11_SQL, op11_conversation_prefix_trie
from gridlark.llm.variants import OP12_SQL, op12_spelling_variants
from gridlark.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE = {
    "op4_license_scan": OP4_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_conversation_prefix_trie": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
