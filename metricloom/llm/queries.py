"""The queries of this subpackage and their SQL answers, by key."""

from metricloom.llm import (
    bpe,
    chats,
    counts,
    manifest,
    packing,
    pii,
    quality,
    repeats,
    runs,
    sharding,
    simhash,
    toxicity,
    vectors,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_cascade": quality.op3_cascade,
    "op4_quotes": chats.op4_quotes,
    "op5_crf": pii.op5_crf,
    "op6_two_pass": sharding.op6_two_pass,
    "op7_pq": vectors.op7_pq,
    "op8_packing": packing.op8_packing,
    "op9_suffix_array": repeats.op9_suffix_array,
    "op10_bpe": bpe.op10_bpe,
    "op11_digest_cache": counts.op11_digest_cache,
    "op12_repair": runs.op12_repair,
    "op13_levels": manifest.op13_levels,
}
ORACLE: dict[str, str] = {
    "op3_cascade": quality.OP3_SQL,
    "op4_quotes": chats.OP4_SQL,
    "op13_levels": manifest.OP13_SQL,
}
