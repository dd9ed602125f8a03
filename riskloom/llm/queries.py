"""Registered queries of the llm operators and their DuckDB statements."""

from riskloom.llm.bpe import op11_bpe
from riskloom.llm.hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from riskloom.llm.hard_negatives import op13_hard_negatives
from riskloom.llm.license_scan import op1_license_scan
from riskloom.llm.line_dedup import op8_line_dedup
from riskloom.llm.merkle import ORACLE_SQL as MERKLE_SQL
from riskloom.llm.merkle import op12_merkle_manifest
from riskloom.llm.mixing import op3_mixing
from riskloom.llm.ngram_lm import op2_lm_score
from riskloom.llm.order_minhash import op5_order_minhash
from riskloom.llm.packing import op7_packing
from riskloom.llm.quality import op6_quality
from riskloom.llm.range_join import op10_range_join
from riskloom.llm.secrets import op4_secret_scan
from riskloom.llm.toxicity import op9_toxicity

REGISTRY = {f.__name__: f for f in (
    op1_license_scan, op2_lm_score, op3_mixing, op4_secret_scan, op5_order_minhash, op6_quality, op7_packing,
    op8_line_dedup, op9_toxicity, op10_range_join, op11_bpe, op12_merkle_manifest, op13_hard_negatives)}

ORACLE: dict[str, str] = {"op12_merkle_manifest": MERKLE_SQL, "op13_hard_negatives": NEGATIVES_SQL}
