"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from listwright.llm import langid, mixing, mpeg, packing, pii, rans, sharding, simhash, vectors, warc

QUERIES = {
    "op4_warc": warc.op4_warc,
    "op5_language": langid.op5_language,
    "op1_simhash": simhash.op1_simhash,
    "op2_vectors": vectors.op2_vectors,
    "op3_interleave": sharding.op3_interleave,
    "op6_rans": rans.op6_rans,
    "op7_surrogates": pii.op7_surrogates,
    "op8_mix": mixing.op8_mix,
    "op9_best_fit": packing.op9_best_fit,
    "op10_mpeg": mpeg.op10_mpeg,
}

#: DuckDB SQL of those queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op4_warc": warc.OP4_SQL}
