"""The queries of this subpackage and the SQL of those that SQL can express."""

from chronoloom.llm import alignment, gif, language, lattice, lengths, mixing, packing, quality, ranking, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_gif": gif.op1_gif,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_quality": quality.op5_quality,
    "op6_arc_to_warc": warc.op6_arc_to_warc,
    "op7_lattice": lattice.op7_lattice,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_length_histogram": lengths.op9_length_histogram,
    "op10_virtual_slots": sharding.op10_virtual_slots,
    "op11_ranking": ranking.op11_ranking,
    "op12_alignment": alignment.op12_alignment,
    "op13_language": language.op13_language,
}

SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op6_arc_to_warc": warc.OP6_SQL,
    "op11_ranking": ranking.OP11_SQL,
}
