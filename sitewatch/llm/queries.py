"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as pipeline

from .ann import op6_ann
from .bpe import op1_bpe
from .chat import OP4_SQL, op4_chat
from .codes import OP13_SQL, op13_codes
from .decontam import OP11_SQL, op11_decontamination
from .langid import op9_langid
from .linededup import op10_line_dedup
from .packing import op5_packing
from .pii import op3_pii
from .quality import op2_quality
from .simhash import op8_simhash
from .topk import op7_topk
from .whitening import op12_whitening

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_chat": op4_chat,
    "op5_packing": op5_packing,
    "op6_ann": op6_ann,
    "op7_topk": op7_topk,
    "op8_simhash": op8_simhash,
    "op9_langid": op9_langid,
    "op10_line_dedup": op10_line_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_codes": op13_codes,
    "pipeline": pipeline,
}

ORACLE = {
    "op4_chat": OP4_SQL,
    "op11_decontamination": OP11_SQL,
    "op13_codes": OP13_SQL,
}
if PIPELINE_SQL:
    ORACLE["pipeline"] = PIPELINE_SQL
