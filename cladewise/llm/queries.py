"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from cladewise.llm import op1_url_filter as op1
from cladewise.llm import op10_quality_classifier as op10
from cladewise.llm import op11_resample as op11
from cladewise.llm import op12_context_tree as op12
from cladewise.llm import op13_ranked_search as op13
from cladewise.llm import op2_html_extract as op2
from cladewise.llm import op3_decontaminate as op3
from cladewise.llm import op4_license_scan as op4
from cladewise.llm import op5_bpe as op5
from cladewise.llm import op6_near_dedup as op6
from cladewise.llm import op7_toxicity as op7
from cladewise.llm import op8_token_counts as op8
from cladewise.llm import op9_quality_rules as op9

QUERIES = {
    "op1_url_filter": op1.op1_url_filter,
    "op2_html_extract": op2.op2_html_extract,
    "op3_decontaminate": op3.op3_decontaminate,
    "op4_license_scan": op4.op4_license_scan,
    "op5_bpe": op5.op5_bpe,
    "op6_near_dedup": op6.op6_near_dedup,
    "op7_toxicity": op7.op7_toxicity,
    "op8_token_counts": op8.op8_token_counts,
    "op9_quality_rules": op9.op9_quality_rules,
    "op10_quality_classifier": op10.op10_quality_classifier,
    "op11_resample": op11.op11_resample,
    "op12_context_tree": op12.op12_context_tree,
    "op13_ranked_search": op13.op13_ranked_search,
    "quality_ablations": op9.quality_ablations,
}
ORACLE_SQL = {
    "op1_url_filter": op1.OP1_SQL,
    "op4_license_scan": op4.OP4_SQL,
    "op6_near_dedup": op6.OP6_SQL,
    "op9_quality_rules": op9.OP9_SQL,
    "op11_resample": op11.OP11_SQL,
    "op13_ranked_search": op13.OP13_SQL,
    "quality_ablations": op9.ABLATIONS_SQL,
}
