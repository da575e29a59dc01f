"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, hardneg, lm, minhash, mixing, packing, pipeline, quality, resync, sharding, sstable, suffixes, warc

QUERIES = {
    "op1_sstable": sstable.op1_sstable,
    "op2_sharding": sharding.op2_sharding,
    "op3_ann": ann.op3_ann,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_gru_lm": lm.op5_gru_lm,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_minhash": minhash.op7_minhash,
    "op8_warc": warc.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_token_counts": resync.op12_token_counts,
    "pipeline": pipeline.run,
}
SQL: dict[str, str] = {"op2_sharding": sharding.OP2_SQL, "op11_hard_negatives": hardneg.OP11_SQL}
