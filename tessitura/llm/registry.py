"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessitura.llm.bpe import op1_bpe
from tessitura.llm.chat import OP5_SQL, op5_chat
from tessitura.llm.decontaminate import op2_decontaminate
from tessitura.llm.filters import OP13_SQL, op13_filter_audit
from tessitura.llm.langid import op4_language_id
from tessitura.llm.media import op9_media
from tessitura.llm.pages import op7_pages
from tessitura.llm.pii import op6_pii
from tessitura.llm.quality import op12_quality
from tessitura.llm.ranking import OP11_SQL, op11_ranked_search
from tessitura.llm.sharding import op3_sharding
from tessitura.llm.simhash import op10_simhash
from tessitura.llm.suffixes import op8_repeats

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_chat": op5_chat,
    "op6_pii": op6_pii,
    "op7_pages": op7_pages,
    "op8_repeats": op8_repeats,
    "op9_media": op9_media,
    "op10_simhash": op10_simhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_quality": op12_quality,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op5_chat": OP5_SQL, "op11_ranked_search": OP11_SQL, "op13_filter_audit": OP13_SQL}
