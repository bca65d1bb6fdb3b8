"""The queries of this subpackage, and their SQL."""

from . import bpe, interleave, line_cleaning, mixing, ngram_join, ogg, pii_bootstrap, quality_cotraining, secret_scan, training_order

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_line_cleaning": line_cleaning.op2_line_cleaning,
    "op3_training_order": training_order.op3_training_order,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_pii_bootstrap": pii_bootstrap.op5_pii_bootstrap,
    "op6_quality_cotraining": quality_cotraining.op6_quality_cotraining,
    "op7_bpe": bpe.op7_bpe,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_ogg": ogg.op9_ogg,
    "op10_interleave": interleave.op10_interleave,
}

ORACLES = {
    "op2_line_cleaning": line_cleaning.OP2_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op10_interleave": interleave.OP10_SQL,
}
