"""Importing this module registers every query of the subpackage."""

from trackguard.llm import (q_decontaminate, q_language, q_mixing, q_near_duplicates, q_prefix_trie, q_sentencepieces, q_spelling, q_substrings, q_token_count, q_token_files,  # noqa: F401
                            q_topk, q_toxicity, q_warc)  # noqa: F401
from trackguard.llm.catalog import ORACLES, QUERIES  # noqa: F401
