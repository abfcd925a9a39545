"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from postsieve.llm.collocations import op13_collocations
from postsieve.llm.decontaminate import op1_decontamination
from postsieve.llm.hard_negatives import op11_hard_negatives
from postsieve.llm.jaccard_join import op12_jaccard_join
from postsieve.llm.licenses import op8_licenses
from postsieve.llm.lm_scoring import op3_lm_scoring
from postsieve.llm.near_dup import op7_near_dup
from postsieve.llm.oracles import ORACLES
from postsieve.llm.passages import op6_passages
from postsieve.llm.quality_rules import op9_quality_rules
from postsieve.llm.secrets import op2_secrets
from postsieve.llm.sentencepieces import op5_sentencepiece
from postsieve.llm.training_order import op10_training_order
from postsieve.llm.warc_zip import op4_warc_zip

_OPERATORS = (op1_decontamination, op2_secrets, op3_lm_scoring, op4_warc_zip, op5_sentencepiece, op6_passages, op7_near_dup, op8_licenses, op9_quality_rules, op10_training_order, op11_hard_negatives, op12_jaccard_join, op13_collocations)
LLM_QUERIES = {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}
LLM_ORACLES = ORACLES
