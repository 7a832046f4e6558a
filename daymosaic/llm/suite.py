"""Loads the operators, which register their queries."""

from daymosaic.llm import collocations, decontamination, hard_negatives, language_id, language_model, minhash, packing, secrets, simhash, substrings, topk, toxicity, url_filters  # noqa: F401
from daymosaic.llm.base import ORACLE, QUERIES  # noqa: F401
