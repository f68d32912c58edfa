"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, conversations, decontaminate, licenses, substrings, urls
from .ann import op2_ann
from .chat import op10_chat
from .collocations import op11_collocations
from .conversations import op12_conversations
from .decontaminate import op6_decontaminate
from .licenses import op3_license_scan
from .packing import op8_packing
from .quality import op7_quality
from .sharding import op1_sharding
from .simhash import op9_simhash
from .substrings import op13_substrings
from .toxicity import op5_toxicity
from .urls import op4_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_ann": op2_ann,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_chat": op10_chat,
    "op11_collocations": op11_collocations,
    "op12_conversations": op12_conversations,
    "op13_substrings": op13_substrings,
}

#: Counting splitters, searches, trained models, fingerprints and tokenizers are not SQL: tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": licenses.ORACLE,
    "op4_url_filter": urls.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_conversations": conversations.ORACLE,
    "op13_substrings": substrings.ORACLE,
}
