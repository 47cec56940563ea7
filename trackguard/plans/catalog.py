"""Every registered query; importing a section registers its queries."""

from trackguard.plans import q_ingest, q_features, q_detect, q_eval, q_learn, q_live, q_stream  # noqa: F401
from trackguard.plans.registry import ORACLES, QUERIES  # noqa: F401
