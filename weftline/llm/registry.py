"""The subpackage's queries and their SQL."""

from . import ann, bpe, exact_dedup, importance, langid, mixing, pieces, quality, simhash, suffix_dedup, token_counts, toxicity, whitening

OPS = [mixing.op1_mixing, token_counts.op2_token_counts, simhash.op3_simhash, toxicity.op4_toxicity, exact_dedup.op5_exact_dedup, ann.op6_ann, bpe.op7_bpe, langid.op8_langid, suffix_dedup.op9_suffix_dedup, quality.op10_quality, pieces.op11_pieces, whitening.op12_whitening, importance.op13_importance]
SQL = {"op5_exact_dedup": exact_dedup.SQL, "op9_suffix_dedup": suffix_dedup.SQL, "op13_importance": importance.SQL}


def queries():
    return {f.__name__: f for f in OPS}


def oracle_sql():
    return dict(SQL)
