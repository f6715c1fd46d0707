"""The queries of this subpackage and their SQL. Those without SQL are held against plain versions in tests/llm."""

from __future__ import annotations

from txcompact.llm.align import op12_align
from txcompact.llm.ann import op10_nearest
from txcompact.llm.decontam import OP3_SQL, op3_decontaminate
from txcompact.llm.line_dedup import OP4_SQL, op4_line_dedup
from txcompact.llm.packing import op5_best_fit_packing
from txcompact.llm.ppm import op8_lm_score
from txcompact.llm.quality import op6_quality
from txcompact.llm.simhash import op7_simhash
from txcompact.llm.token_count import op9_token_count
from txcompact.llm.token_files import op13_token_ids
from txcompact.llm.toxicity import op2_toxicity
from txcompact.llm.url_filter import OP1_SQL, op1_url_filter
from txcompact.llm.whitening import op11_whitening

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_lm_score": op8_lm_score,
    "op9_token_count": op9_token_count,
    "op10_nearest": op10_nearest,
    "op11_whitening": op11_whitening,
    "op12_align": op12_align,
    "op13_token_ids": op13_token_ids,
}

SQL = {"op1_url_filter": OP1_SQL, "op3_decontaminate": OP3_SQL, "op4_line_dedup": OP4_SQL}
