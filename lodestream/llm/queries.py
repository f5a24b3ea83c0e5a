"""The queries of this subpackage and their SQL."""

from lodestream.llm.alignment import op12_alignment
from lodestream.llm.embedding_pairs import op1_embedding_pairs
from lodestream.llm.host_reputation import OP3_SQL, op3_host_reputation
from lodestream.llm.html_text import op5_html_text
from lodestream.llm.langid import op7_language_id
from lodestream.llm.mixing import OP6_SQL, op6_mixing
from lodestream.llm.packing import op9_packing, packed_conversations
from lodestream.llm.prefix_trie import op11_prefix_trie
from lodestream.llm.quality_rules import op8_quality_rules
from lodestream.llm.simhash import op4_simhash
from lodestream.llm.suffixes import op2_suffix_array
from lodestream.llm.token_counts import op13_token_counts
from lodestream.llm.token_files import op10_token_files

QUERIES = {
    "op1_embedding_pairs": op1_embedding_pairs,
    "op2_suffix_array": op2_suffix_array,
    "op3_host_reputation": op3_host_reputation,
    "op4_simhash": op4_simhash,
    "op5_html_text": op5_html_text,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_alignment": op12_alignment,
    "op13_token_counts": op13_token_counts,
    "packed_conversations": packed_conversations,
}
#: Oracles of what SQL can state; the others are held against brute force in the tests.
ORACLES = {"op3_host_reputation": OP3_SQL, "op6_mixing": OP6_SQL}
