"""The registered queries of the text operators, and the SQL of those that have one."""

from geoquarry.llm import centroids, chat, language, mixing, packing, pii, quality_model, quality_rules, repeats, simhash, topk, toxicity, trie

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_repeats": repeats.op2_repeats,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_classifier": quality_model.op5_quality_classifier,
    "op6_packing": packing.op6_packing,
    "op7_language_id": language.op7_language_id,
    "op8_topk": topk.op8_topk,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_chat": chat.op11_chat,
    "op12_centroids": centroids.op12_centroids,
    "op13_trie": trie.op13_trie,
}
ORACLE = {"op1_mixing": mixing.SQL, "op8_topk": topk.SQL, "op11_chat": chat.SQL, "op12_centroids": centroids.SQL, "op13_trie": trie.SQL}
