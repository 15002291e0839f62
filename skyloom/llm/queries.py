"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from skyloom.llm.bpe import op11_bpe
from skyloom.llm.conversations import OP12_SQL, op12_repair
from skyloom.llm.decontaminate import OP2_SQL, op2_decontaminate
from skyloom.llm.html_text import op5_html
from skyloom.llm.jaccard import op7_jaccard
from skyloom.llm.periodic import op13_periodic
from skyloom.llm.pieces import op1_sentencepiece
from skyloom.llm.pii import op10_pii
from skyloom.llm.quality import op6_quality
from skyloom.llm.token_store import op4_token_store
from skyloom.llm.url_rules import op9_url_rules
from skyloom.llm.vector_dedup import OP3_SQL, op3_vector_dedup
from skyloom.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontaminate": op2_decontaminate,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_token_store": op4_token_store,
    "op5_html": op5_html,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_warc": op8_warc,
    "op9_url_rules": op9_url_rules,
    "op10_pii": op10_pii,
    "op11_bpe": op11_bpe,
    "op12_repair": op12_repair,
    "op13_periodic": op13_periodic,
}
ORACLES = {
    "op2_decontaminate": OP2_SQL,
    "op3_vector_dedup": OP3_SQL,
    "op8_warc": OP8_SQL,
    "op12_repair": OP12_SQL,
}
