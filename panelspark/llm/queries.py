"""Registered queries of the corpus operators and, where SQL can state them, their DuckDB text."""

from __future__ import annotations

from panelspark.llm.bwt import op8_suffix_array_dedup
from panelspark.llm.fmindex import op2_substring_dedup
from panelspark.llm.infill import OP12_SQL, op12_fill_in_middle
from panelspark.llm.lexical import OP13_SQL, op13_ranked_search
from panelspark.llm.licenses import op4_license_scan
from panelspark.llm.lines import OP5_SQL, op5_line_dedup
from panelspark.llm.mixing import OP9_SQL, op9_mix_sources
from panelspark.llm.packing import op10_best_fit_packing
from panelspark.llm.quality import op7_quality_rules
from panelspark.llm.rans import op6_token_files
from panelspark.llm.simhash import op1_simhash
from panelspark.llm.vectors import op3_embedding_near_dups
from panelspark.llm.warc import OP11_SQL, op11_warc_archive

_ALL = (
    op1_simhash, op2_substring_dedup, op3_embedding_near_dups, op4_license_scan, op5_line_dedup, op6_token_files, op7_quality_rules,
    op8_suffix_array_dedup, op9_mix_sources, op10_best_fit_packing, op11_warc_archive, op12_fill_in_middle, op13_ranked_search,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op5_line_dedup": OP5_SQL, "op9_mix_sources": OP9_SQL, "op11_warc_archive": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_ranked_search": OP13_SQL}
