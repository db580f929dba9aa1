"""The queries of this subpackage and the SQL that some can be held against."""

from tracemill.llm import alignment, chat, decontaminate, jaccard, licenses, mixing, neighbours, pii, quality_model, quality_rules, url_rules, warc, whitening

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_warc": warc.op2_warc,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_pii_spans": pii.op5_pii_spans,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_chat_prefix": chat.op10_chat_prefix,
    "op11_whitening": whitening.op11_whitening,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op9_url_rules": url_rules.OP9_SQL,
    "op10_chat_prefix": chat.OP10_SQL,
}
