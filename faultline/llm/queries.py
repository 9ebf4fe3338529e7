"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from faultline.llm.anagram_join import OP13_SQL, op13_anagram_names
from faultline.llm.filter_audit import OP12_SQL, op12_filter_audit
from faultline.llm.fixity import OP4_SQL, op4_fixity
from faultline.llm.jaccard import op9_ngram_jaccard
from faultline.llm.language import op8_language
from faultline.llm.mixing import OP2_SQL, op2_mix_sources
from faultline.llm.near_vectors import OP10_SQL, op10_near_vectors
from faultline.llm.ngram_model import op6_ngram_scores
from faultline.llm.packing import op5_packing
from faultline.llm.posting_search import op1_posting_search
from faultline.llm.quality import op11_quality_pu
from faultline.llm.token_files import op3_token_files
from faultline.llm.transcripts import op7_transcripts


def queries():
    return {
        "op1_posting_search": op1_posting_search,
        "op2_mix_sources": op2_mix_sources,
        "op3_token_files": op3_token_files,
        "op4_fixity": op4_fixity,
        "op5_packing": op5_packing,
        "op6_ngram_scores": op6_ngram_scores,
        "op7_transcripts": op7_transcripts,
        "op8_language": op8_language,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_near_vectors": op10_near_vectors,
        "op11_quality_pu": op11_quality_pu,
        "op12_filter_audit": op12_filter_audit,
        "op13_anagram_names": op13_anagram_names,
    }


def oracle_sql():
    return {"op2_mix_sources": OP2_SQL, "op4_fixity": OP4_SQL, "op10_near_vectors": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_anagram_names": OP13_SQL}
