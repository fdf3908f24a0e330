"""The queries of the training-data operators, and SQL for those that SQL can express."""

from tidemark.llm.decontaminate import op8_decontamination
from tidemark.llm.exact import OP3_SQL, op3_exact_dedup
from tidemark.llm.jaccard import op6_jaccard
from tidemark.llm.language import op2_language
from tidemark.llm.lines import op9_line_dedup
from tidemark.llm.lm import op4_lm_scoring
from tidemark.llm.packing import op1_packing
from tidemark.llm.spans import OP10_SQL, op10_substring
from tidemark.llm.toxicity import op5_toxicity
from tidemark.llm.warc import op7_warc

QUERIES = {f.__name__: f for f in (op1_packing, op2_language, op3_exact_dedup, op4_lm_scoring, op5_toxicity, op6_jaccard, op7_warc,
                                   op8_decontamination, op9_line_dedup, op10_substring)}

SQL = {"op3_exact_dedup": OP3_SQL, "op10_substring": OP10_SQL}
