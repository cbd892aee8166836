"""The queries of this package, and the SQL of those that SQL can express."""

from . import ann, bpe, conversation_repair, embedding_dedup, jaccard_join, language, line_dedup, mixing, pii, token_io, toxicity, warc, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_pii": pii.op2_pii,
    "op8_mixing": mixing.op8_mixing,
    "op3_ann": ann.op3_ann,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_token_io": token_io.op7_token_io,
    "op9_bpe": bpe.op9_bpe,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_whitening": whitening.op11_whitening,
    "op12_language": language.op12_language,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLES = {
    "op6_warc": warc.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
