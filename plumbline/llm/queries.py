"""The registered queries of the training-data operators, and DuckDB SQL where it can express one."""

from plumbline.llm.bpe import op1_bpe
from plumbline.llm.chat import OP12_SQL, op12_chat_format
from plumbline.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from plumbline.llm.language import op10_language
from plumbline.llm.mixing import OP5_SQL, op5_mix
from plumbline.llm.neardup_vectors import op2_near_vectors
from plumbline.llm.periodic import op11_periodic_runs
from plumbline.llm.quality import op4_quality
from plumbline.llm.secrets import op9_secrets
from plumbline.llm.simhash import op7_simhash
from plumbline.llm.token_counts import op8_token_counts
from plumbline.llm.toxicity import op3_toxicity
from plumbline.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f for f in (op1_bpe, op2_near_vectors, op3_toxicity, op4_quality, op5_mix, op6_exact_dedup, op7_simhash, op8_token_counts, op9_secrets, op10_language, op11_periodic_runs, op12_chat_format, op13_whitening)
}
ORACLE_SQL = {"op5_mix": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op12_chat_format": OP12_SQL}
