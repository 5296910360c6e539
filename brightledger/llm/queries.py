"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import conversation_trie, exact_dedup, language_id, licence_scan, minhash_dedup, permutation_index, quality, sanitisation, sentencepiece_codec, temperature_mix, tool_calls, toxicity, vector_codes

QUERIES = {
    "op1_permutation_index": permutation_index.op1_permutation_index,
    "op2_quality": quality.op2_quality,
    "op3_tool_calls": tool_calls.op3_tool_calls,
    "op4_temperature_mix": temperature_mix.op4_temperature_mix,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_licence_scan": licence_scan.op7_licence_scan,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_sanitisation": sanitisation.op13_sanitisation,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op3_tool_calls": tool_calls.OP3_SQL,
    "op4_temperature_mix": temperature_mix.OP4_SQL,
    "op5_minhash_dedup": minhash_dedup.OP5_SQL,
    "op7_licence_scan": licence_scan.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_conversation_trie": conversation_trie.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
