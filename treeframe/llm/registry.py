"""The queries of this subpackage, and SQL for those that SQL can express."""

from treeframe.llm import chat, extraction, licenses, mixing, neighbours, packing, quality, repeats, simhash, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_warc": warc.op4_warc,
    "op5_repeats": repeats.op5_repeats,
    "op6_chat": chat.op6_chat,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_packing": packing.op8_packing,
    "op9_extraction": extraction.op9_extraction,
    "op10_mixing": mixing.op10_mixing,
}
SQL = {"op3_quality": quality.SQL, "op6_chat": chat.SQL, "op10_mixing": mixing.SQL}
