"""The queries of this subpackage, by name, and their SQL where it can say the same."""

from __future__ import annotations

from millrace.llm import bpe_query, chat, langid, license, media, mixing, neardup, substring, topk, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_chat": chat.op2_chat,
    "op3_bpe": bpe_query.op3_bpe,
    "op4_media": media.op4_media,
    "op5_substring": substring.op5_substring,
    "op6_topk": topk.op6_topk,
    "op7_license": license.op7_license,
    "op8_warc": warc.op8_warc,
    "op9_neardup": neardup.op9_neardup,
    "op10_mix": mixing.op10_mix,
}

ORACLES = {
    "op2_chat": chat.OP2_SQL,
    "op5_substring": substring.OP5_SQL,
    "op9_neardup": neardup.OP9_SQL,
    "op6_topk": topk.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_mix": mixing.OP10_SQL,
}
