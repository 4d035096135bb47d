"""Queries of this subpackage and their SQL, by name."""
from __future__ import annotations

import corpus_pipeline
from pairlens.llm.op01_spotsigs import op1_spotsigs
from pairlens.llm.op02_permutation import op2_permutation
from pairlens.llm.op03_secrets import op3_secrets
from pairlens.llm.op04_langid import op4_langid
from pairlens.llm.op05_mixing import OP5_SQL, op5_mixing
from pairlens.llm.op06_repair import op6_repair
from pairlens.llm.op07_sharding import op7_sharding
from pairlens.llm.op08_transducer import op8_transducer
from pairlens.llm.op09_packing import op9_packing
from pairlens.llm.op10_simhash import op10_simhash
from pairlens.llm.op11_warc import OP11_SQL, op11_warc
from pairlens.llm.op12_merkle import OP12_SQL, op12_merkle
from pairlens.llm.op13_alignment import op13_alignment

QUERIES = {
    "op1_spotsigs": op1_spotsigs,
    "op2_permutation": op2_permutation,
    "op3_secrets": op3_secrets,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_repair": op6_repair,
    "op7_sharding": op7_sharding,
    "op8_transducer": op8_transducer,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_warc": op11_warc,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op5_mixing": OP5_SQL, "op11_warc": OP11_SQL, "op12_merkle": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
