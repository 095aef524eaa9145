"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.llm.decontaminate import OP2_SQL, op2_decontaminate
from siltstone.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from siltstone.llm.licenses import op8_license_templates
from siltstone.llm.lp_packing import op11_best_fit_packing
from siltstone.llm.packing import op7_packing
from siltstone.llm.periodic_runs import op12_periodic_runs
from siltstone.llm.pii import op1_pii_weak
from siltstone.llm.quality import op4_quality_qda
from siltstone.llm.simhash_vptree import op9_simhash_vptree
from siltstone.llm.source_divergence import OP13_SQL, op13_source_divergence
from siltstone.llm.suffix_dedup import op5_suffix_dedup
from siltstone.llm.token_counts import op6_token_counts
from siltstone.llm.toxicity import op10_toxicity_weak

QUERIES = {
    "op1_pii_weak": op1_pii_weak,
    "op2_decontaminate": op2_decontaminate,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_qda": op4_quality_qda,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_license_templates": op8_license_templates,
    "op9_simhash_vptree": op9_simhash_vptree,
    "op10_toxicity_weak": op10_toxicity_weak,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op13_source_divergence": OP13_SQL}
