"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, hardneg, jaccard, mixing, neardup, topk
from .ann import op5_nearest
from .packing import op10_packing
from .pii import op6_pii
from .ppm import op3_ppm
from .quality import op1_quality
from .sharding import op4_sharding
from .whitening import op13_whitening

QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_ppm": op3_ppm,
    "op4_sharding": op4_sharding,
    "op5_nearest": op5_nearest,
    "op6_pii": op6_pii,
    "op7_neardup": neardup.op7_neardup,
    "op8_topk": topk.op8_topk,
    "op9_chat": chat.op9_chat,
    "op10_packing": op10_packing,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_hardneg": hardneg.op12_hardneg,
    "op13_whitening": op13_whitening,
}

ORACLES = {"op2_mixing": mixing.ORACLE, "op9_chat": chat.ORACLE, "op7_neardup": neardup.ORACLE, "op8_topk": topk.ORACLE, "op11_jaccard": jaccard.ORACLE, "op12_hardneg": hardneg.ORACLE}
