"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from cadastra.llm.byte_bpe import op8_byte_bpe
from cadastra.llm.collocations import OP11_SQL, op11_collocations
from cadastra.llm.hnsw import OP1_SQL, op1_hnsw
from cadastra.llm.line_dedup import OP5_SQL, op5_line_dedup
from cadastra.llm.minhash_dedup import OP6_SQL, op6_minhash
from cadastra.llm.packing import op10_pack
from cadastra.llm.passage_dedup import op3_passages
from cadastra.llm.piece_bpe import op13_piece_bpe
from cadastra.llm.pivot_search import OP7_SQL, op7_pivot_topk
from cadastra.llm.quality import op4_quality
from cadastra.llm.spelling import op12_spelling
from cadastra.llm.toxicity import op9_toxicity
from cadastra.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_hnsw": op1_hnsw,
    "op2_warc": op2_warc,
    "op3_passages": op3_passages,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash": op6_minhash,
    "op7_pivot_topk": op7_pivot_topk,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_pack": op10_pack,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_piece_bpe": op13_piece_bpe,
}
ORACLE_SQL = {
    "op1_hnsw": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_minhash": OP6_SQL,
    "op7_pivot_topk": OP7_SQL,
    "op11_collocations": OP11_SQL,
}
