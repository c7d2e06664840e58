"""The queries of this folder and the SQL for their results, by name."""

from __future__ import annotations

from . import decontaminate, language, licenses, lm, mixing, sampling, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_lm": lm.query,
    "op3_mixing": mixing.query,
    "op4_sampling": sampling.query,
    "op5_language": language.query,
    "op6_licenses": licenses.query,
    "op7_toxicity": toxicity.query,
    "op8_decontaminate": decontaminate.query,
    "op9_simhash": simhash.query,
    "op10_warc": warc.query,
}

ORACLE_SQL = {
    "op1_sharding": sharding.oracle(),
    "op3_mixing": mixing.ORACLE,
    "op6_licenses": licenses.oracle(),
    "op8_decontaminate": decontaminate.oracle(),
}
