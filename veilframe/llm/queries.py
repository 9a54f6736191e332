"""The queries of this subpackage and their SQL counterparts for DuckDB."""

from veilframe.llm.byte_bpe import op4_byte_bpe
from veilframe.llm.decontaminate import OP2_SQL, op2_decontamination
from veilframe.llm.digest_index import OP13_SQL, op13_exact_dedup
from veilframe.llm.html_text import op1_html_text
from veilframe.llm.language import op6_language_id
from veilframe.llm.near_duplicates import OP5_SQL, op5_near_duplicates
from veilframe.llm.quality import OP7_SQL, op7_quality_rules
from veilframe.llm.repeats import OP9_SQL, op9_substring_dedup
from veilframe.llm.secrets import op3_secret_scans
from veilframe.llm.token_counts import op8_token_counts
from veilframe.llm.toxicity import op10_toxicity
from veilframe.llm.vector_codes import OP12_SQL, op12_vector_codes
from veilframe.llm.whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_html_text, op2_decontamination, op3_secret_scans, op4_byte_bpe, op5_near_duplicates, op6_language_id, op7_quality_rules, op8_token_counts,
                                 op9_substring_dedup, op10_toxicity, op11_embedding_whitening, op12_vector_codes, op13_exact_dedup)}
ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op5_near_duplicates": OP5_SQL, "op7_quality_rules": OP7_SQL, "op9_substring_dedup": OP9_SQL,
              "op12_vector_codes": OP12_SQL, "op13_exact_dedup": OP13_SQL}
