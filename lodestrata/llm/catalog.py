"""The registered queries of the training-corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import align, chat, decontam, html, langid, lines, mixing, neardup, pii, quality, toxicity, trie, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_toxicity_chain": toxicity.op2_toxicity_chain,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_warc_archive": warc.op6_warc_archive,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_personal_data": pii.op12_personal_data,
    "op13_tokenizer_alignment": align.op13_tokenizer_alignment,
}
ORACLES = {"op1_chat_formatting": chat.OP1_SQL, "op3_minhash_near_dedup": neardup.OP3_SQL, "op6_warc_archive": warc.OP6_SQL, "op7_line_dedup": lines.OP7_SQL, "op10_decontamination": decontam.OP10_SQL, "op11_prefix_trie": trie.OP11_SQL}
