"""Queries of the training-data operators: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from vitrine.llm.byte_bpe import op9_byte_bpe
from vitrine.llm.embedding_dedup import OP2_SQL, op2_embedding_near_dedup
from vitrine.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from vitrine.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from vitrine.llm.filter_audit import OP11_SQL, op11_filter_audit
from vitrine.llm.jaccard_join import OP1_SQL, op1_ngram_jaccard_join
from vitrine.llm.language_model import op4_language_model
from vitrine.llm.licenses import op10_license_scan
from vitrine.llm.packing import op5_best_fit_packing
from vitrine.llm.pii import op13_pii
from vitrine.llm.secrets import op7_secret_scan
from vitrine.llm.suffix_dedup import op3_suffix_array_dedup
from vitrine.llm.toxicity import op8_toxicity
from vitrine.llm.workers import importable

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_language_model": op4_language_model,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_license_scan": op10_license_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_pii": op13_pii,
}
QUERIES = {name: importable(query) for name, query in QUERIES.items()}
SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_embedding_near_dedup": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
