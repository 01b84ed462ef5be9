"""The registered queries of this subpackage. Most have no SQL counterpart, as they work on bytes, models or graphs."""

from __future__ import annotations

from .bpe import op4_bpe
from .conversations import ORACLE as CONVERSATIONS
from .conversations import op12_conversation_repair
from .fracsketch import op6_fingerprints
from .langid import op7_langid
from .licences import op13_licence_scan
from .media import op8_media
from .packing import op2_packing
from .quality import op5_quality
from .simhash import op3_simhash
from .suffix_dedup import op1_suffix_array_dedup
from .token_counts import op9_token_counts
from .vector_codes import ORACLE as VECTOR_CODES
from .vector_codes import op11_vector_codes
from .warc import op10_warc_fixity

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_langid": op7_langid,
    "op8_media": op8_media,
    "op9_token_counts": op9_token_counts,
    "op10_warc_fixity": op10_warc_fixity,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_licence_scan": op13_licence_scan,
}
SQL: dict[str, str] = {"op11_vector_codes": VECTOR_CODES, "op12_conversation_repair": CONVERSATIONS}
