"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from sharpfleet.llm import align, decontaminate, extract, license, lines, mixing, neardup, packing, quality, repair, substrings, toxicity, winnow

QUERIES = {
    "op1_html": extract.op1_html,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pack": packing.op4_pack,
    "op5_fingerprints": winnow.op5_fingerprints,
    "op6_licenses": license.op6_licenses,
    "op7_substrings": substrings.op7_substrings,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality": quality.op9_quality,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_alignment": align.op11_alignment,
    "op12_repair": repair.op12_repair,
    "op13_mixing": mixing.op13_mixing,
}
SQL = {"op8_line_dedup": lines.OP8_SQL, "op13_mixing": mixing.OP13_SQL}
