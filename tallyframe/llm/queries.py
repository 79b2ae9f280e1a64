"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyframe.llm.collocations import OP13_SQL, op13_setm
from tallyframe.llm.mixing import op3_mixing
from tallyframe.llm.orderhash import op10_order_minhash
from tallyframe.llm.pieces import op9_pieces
from tallyframe.llm.quality import op7_quality
from tallyframe.llm.recompression import op11_recompression
from tallyframe.llm.secret_spans import op4_secrets
from tallyframe.llm.simhash import op5_simhash
from tallyframe.llm.suffixtree import op2_suffix_tree
from tallyframe.llm.suffixarrays import OP12_SQL, op12_suffix_arrays
from tallyframe.llm.toxicity import op8_toxicity
from tallyframe.llm.transducer import op6_token_counts
from tallyframe.llm.warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (
    op1_warc, op2_suffix_tree, op3_mixing, op4_secrets, op5_simhash, op6_token_counts, op7_quality, op8_toxicity, op9_pieces,
    op10_order_minhash, op11_recompression, op12_suffix_arrays, op13_setm,
)}
#: The other operators train models, walk graphs or follow tokenizer files, which SQL cannot express.
ORACLES = {"op1_warc": OP1_SQL, "op12_suffix_arrays": OP12_SQL, "op13_setm": OP13_SQL}
