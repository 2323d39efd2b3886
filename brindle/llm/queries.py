"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from brindle.llm.audit import OP13_SQL, op13_audit
from brindle.llm.bpe import op9_bpe
from brindle.llm.chat import OP5_SQL, op5_chat
from brindle.llm.decontaminate import op1_decontamination
from brindle.llm.fingerprint import op4_fingerprint
from brindle.llm.jaccard import OP3_SQL, op3_jaccard
from brindle.llm.langid import op2_langid
from brindle.llm.pii import op7_pii
from brindle.llm.ranked import OP11_SQL, op11_ranked
from brindle.llm.repeats import OP12_SQL, op12_repeats
from brindle.llm.secrets import op10_secrets
from brindle.llm.tokencount import op6_tokencount
from brindle.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_langid": op2_langid,
    "op3_jaccard": op3_jaccard,
    "op4_fingerprint": op4_fingerprint,
    "op5_chat": op5_chat,
    "op6_tokencount": op6_tokencount,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_secrets": op10_secrets,
    "op11_ranked": op11_ranked,
    "op12_repeats": op12_repeats,
    "op13_audit": op13_audit,
}

ORACLE_SQL: dict[str, str] = {"op3_jaccard": OP3_SQL, "op5_chat": OP5_SQL, "op11_ranked": OP11_SQL, "op12_repeats": OP12_SQL, "op13_audit": OP13_SQL}
