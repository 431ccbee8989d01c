"""The operators' queries, and SQL for those that SQL can express."""

from spanloom.llm import matrices, mixing, outliers, packing, pii, quality, simhash, sketches, url_lists, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_lists": url_lists.op2_url_lists,
    "op3_matrices": matrices.op3_matrices,
    "op4_outliers": outliers.op4_outliers,
    "op5_personal_data": pii.op5_personal_data,
    "op6_two_fit": packing.op6_two_fit,
    "op7_sketches": sketches.op7_sketches,
    "op8_warc": warc.op8_warc,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {"op2_url_lists": url_lists.OP2_SQL, "op8_warc": warc.OP8_SQL}
