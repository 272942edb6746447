"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from parlance.llm.byte_bpe import op8_byte_bpe
from parlance.llm.fim import OP12_SQL, op12_fim
from parlance.llm.language_id import op9_language
from parlance.llm.media import op10_media
from parlance.llm.mixing import OP6_SQL, op6_mixing
from parlance.llm.quality import op11_quality
from parlance.llm.search import OP13_SQL, op13_search
from parlance.llm.simhash import op3_simhash
from parlance.llm.surrogates import op4_pii
from parlance.llm.syncmers import op5_syncmers
from parlance.llm.token_counts import op2_token_counts
from parlance.llm.toxicity import op7_toxicity
from parlance.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_syncmers": op5_syncmers,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language": op9_language,
    "op10_media": op10_media,
    "op11_quality": op11_quality,
    "op12_fim": op12_fim,
    "op13_search": op13_search,
}

SQL = {
    "op1_warc": OP1_SQL,
    "op6_mixing": OP6_SQL,
    "op12_fim": OP12_SQL,
    "op13_search": OP13_SQL,
}
