"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from groundweave.llm.chat import OP6_SQL, op6_chat
from groundweave.llm.fingerprints import op3_fingerprints
from groundweave.llm.html_text import op8_html
from groundweave.llm.jaccard import op7_jaccard
from groundweave.llm.langid import op1_langid
from groundweave.llm.licences import OP10_SQL, op10_licences
from groundweave.llm.merkle import OP11_SQL, op11_merkle
from groundweave.llm.packing import op9_packing
from groundweave.llm.pieces import op5_sentencepiece
from groundweave.llm.repeats import op4_repeats
from groundweave.llm.secrets import op13_secrets
from groundweave.llm.topk import OP2_SQL, op2_topk
from groundweave.llm.variants import OP12_SQL, op12_variants

QUERIES = {
    "op1_langid": op1_langid,
    "op2_topk": op2_topk,
    "op3_fingerprints": op3_fingerprints,
    "op4_repeats": op4_repeats,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_chat": op6_chat,
    "op7_jaccard": op7_jaccard,
    "op8_html": op8_html,
    "op9_packing": op9_packing,
    "op10_licences": op10_licences,
    "op11_merkle": op11_merkle,
    "op12_variants": op12_variants,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL = {
    "op2_topk": OP2_SQL,
    "op6_chat": OP6_SQL,
    "op10_licences": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op12_variants": OP12_SQL,
}
