"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, images, line_dedup, lm, mixing, packing, phrases, quality, set_join, simhash, spelling, warc

QUERIES = {
    "op1_image_copies": images.op1_image_copies,
    "op2_warc": warc.op2_warc,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_chat": chat.op5_chat,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_set_join": set_join.op7_set_join,
    "op8_lm": lm.op8_lm,
    "op9_quality": quality.op9_quality,
    "op10_packing": packing.op10_packing,
    "op11_simhash": simhash.op11_simhash,
    "op12_phrases": phrases.op12_phrases,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op12_phrases": phrases.OP12_SQL}
