"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op13
from .chat import OP2_SQL, op2
from .decontaminate import OP10_SQL, op10
from .langid import op5
from .licenses import OP8_SQL, op8
from .metricjoin import OP1_SQL, op1
from .pieces import op9
from .pseudolm import op4
from .quality import op3
from .repeats import op7
from .simhash import op6
from .tokenbin import op11
from .whitening import op12

LLM_QUERIES = {
    "op1_metricjoin": op1,
    "op2_chat": op2,
    "op3_quality": op3,
    "op4_pseudolm": op4,
    "op5_langid": op5,
    "op6_simhash": op6,
    "op7_repeats": op7,
    "op8_licenses": op8,
    "op9_pieces": op9,
    "op10_decontaminate": op10,
    "op11_tokenbin": op11,
    "op12_whitening": op12,
    "op13_alignment": op13,
}

LLM_ORACLE = {
    "op1_metricjoin": OP1_SQL,
    "op2_chat": OP2_SQL,
    "op8_licenses": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
}
