"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from .alignment import op13_alignment
from .bytebpe import op12_byte_bpe
from .decontaminate import OP8_SQL, op8_decontaminate
from .embeddings import OP7_SQL, op7_embeddings
from .html import op2_html
from .jaccard import OP9_SQL, op9_jaccard
from .language import op1_language
from .manifest import OP11_SQL, op11_manifest
from .mixture import OP5_SQL, op5_mixture
from .personal import op3_personal
from .quality import op6_quality
from .tokens import op4_tokens
from .toxicity import op10_toxicity

QUERIES = {
    "op1_language": op1_language,
    "op2_html": op2_html,
    "op3_personal": op3_personal,
    "op4_tokens": op4_tokens,
    "op5_mixture": op5_mixture,
    "op6_quality": op6_quality,
    "op7_embeddings": op7_embeddings,
    "op8_decontaminate": op8_decontaminate,
    "op9_jaccard": op9_jaccard,
    "op10_toxicity": op10_toxicity,
    "op11_manifest": op11_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_alignment": op13_alignment,
}
ORACLE = {
    "op5_mixture": OP5_SQL,
    "op7_embeddings": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_jaccard": OP9_SQL,
    "op11_manifest": OP11_SQL,
}
