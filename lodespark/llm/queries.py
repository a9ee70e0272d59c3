"""Queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import chat, mixing, quality, secrets, urls
from .bagminhash import op1_minhash
from .langid import op4_language
from .packing import op6_packing
from .simhash import op8_simhash
from .toxicity import op2_toxicity

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_chat": chat.op3_chat,
    "op4_language": op4_language,
    "op5_secrets": secrets.op5_secrets,
    "op6_packing": op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_simhash": op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_urls": urls.op10_urls,
}
ORACLE = {"op3_chat": chat.ORACLE, "op5_secrets": secrets.ORACLE, "op7_quality": quality.ORACLE, "op9_mixing": mixing.ORACLE, "op10_urls": urls.ORACLE}
