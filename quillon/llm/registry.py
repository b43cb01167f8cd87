"""Queries of this subpackage and their SQL."""

from quillon.llm import bpe, chat, convtrie, ctw, decontam, egojoin, htmlmain, langid, licenses, ngramjoin, pii, spelling, vafile

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_bpe": bpe.op2_bpe,
    "op3_chat_format": chat.op3_chat_format,
    "op4_main_text": htmlmain.op4_main_text,
    "op5_licenses": licenses.op5_licenses,
    "op6_topk": vafile.op6_topk,
    "op7_langid": langid.op7_langid,
    "op8_lm_score": ctw.op8_lm_score,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op10_ngram_join": ngramjoin.op10_ngram_join,
    "op11_conversation_trie": convtrie.op11_conversation_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_embedding_dedup": egojoin.op13_embedding_dedup,
}
ORACLES = {
    "op3_chat_format": chat.ORACLE,
    "op6_topk": vafile.ORACLE,
    "op10_ngram_join": ngramjoin.ORACLE,
    "op11_conversation_trie": convtrie.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_embedding_dedup": egojoin.ORACLE,
}
