"""The queries of this folder and the SQL that DuckDB can run for them."""

from __future__ import annotations

from .chat import OP13_SQL, op13_chat_format
from .embedding import op10_embedding
from .kmeans import OP11_SQL, op11_yinyang
from .langid import op3_language_id
from .minhash import op2_minhash
from .mixing import OP8_SQL, op8_mixing
from .oracles import OP1_SQL, OP2_SQL, OP4_SQL, OP10_SQL
from .packing import op6_packing
from .quality import op7_quality
from .secret_scan import op9_secret_scan
from .spotsigs import op5_spotsigs
from .substring import op1_substring
from .suffix import op4_suffix_array
from .trie import OP12_SQL, op12_prefix_trie

QUERIES = {
    "op1_substring": op1_substring,
    "op2_minhash": op2_minhash,
    "op3_language_id": op3_language_id,
    "op4_suffix_array": op4_suffix_array,
    "op5_spotsigs": op5_spotsigs,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_embedding": op10_embedding,
    "op11_yinyang": op11_yinyang,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}
ORACLE_SQL = {
    "op1_substring": OP1_SQL,
    "op2_minhash": OP2_SQL,
    "op4_suffix_array": OP4_SQL,
    "op8_mixing": OP8_SQL,
    "op10_embedding": OP10_SQL,
    "op11_yinyang": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
