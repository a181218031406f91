"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import ORACLE_OP5, op5_chat
from .decontaminate import op8_decontaminate
from .html import op6_html
from .langid import op2_langid
from .mixing import op9_mixing
from .neardup import op7_neardup
from .packing import op4_packing
from .pii import op10_pii
from .quality import ORACLE_OP3, op3_quality
from .warc import ORACLE_OP1, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_langid, op3_quality, op4_packing, op5_chat, op6_html, op7_neardup, op8_decontaminate, op9_mixing, op10_pii)}
ORACLES = {"op1_warc": ORACLE_OP1, "op3_quality": ORACLE_OP3, "op5_chat": ORACLE_OP5}
