"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestream.llm.bpe import op1_bpe
from lodestream.llm.collocations import OP12_SQL, op12_collocations
from lodestream.llm.conversations import op13_conversations
from lodestream.llm.language import op5_language
from lodestream.llm.licenses import op3_licenses
from lodestream.llm.mixing import op10_mixing
from lodestream.llm.near_dup import op9_near_dup
from lodestream.llm.packing import op11_packing
from lodestream.llm.quality import op7_quality
from lodestream.llm.token_file import op6_token_file
from lodestream.llm.top_k import OP2_SQL, op2_top_k
from lodestream.llm.toxicity import op8_toxicity
from lodestream.llm.url_filter import OP4_SQL, op4_url_filter

QUERIES = {"op1_bpe": op1_bpe, "op4_url_filter": op4_url_filter, "op7_quality": op7_quality, "op10_mixing": op10_mixing, "op6_token_file": op6_token_file, "op3_licenses": op3_licenses, "op5_language": op5_language, "op8_toxicity": op8_toxicity, "op9_near_dup": op9_near_dup, "op2_top_k": op2_top_k, "op11_packing": op11_packing, "op12_collocations": op12_collocations, "op13_conversations": op13_conversations}
ORACLE_SQL: dict[str, str] = {"op2_top_k": OP2_SQL, "op4_url_filter": OP4_SQL, "op12_collocations": OP12_SQL}
