"""Personal-data detection, treatment and risk measurement for Spark DataFrames."""

from veilframe.operators.corpus import corpus_findings, mask_text
from veilframe.operators.detect import by_category, by_entity_risk, candidates, dataset_summary, detect, explain, flagged
from veilframe.operators.report import compare_profiles, privacy_report, recommendations, verdict
from veilframe.operators.risk import assess_risk
from veilframe.operators.utility import assess_utility
from veilframe.plans.anonymize import anonymize
from veilframe.plans.entities import forget_entity, load_entities, register_entity
from veilframe.plans.config import build_config, override_config
from veilframe.plans.profiles import PROFILES
from veilframe.session import scratch

__all__ = [
    "PROFILES", "anonymize", "assess_risk", "assess_utility", "build_config", "by_category", "by_entity_risk",
    "candidates", "compare_profiles", "corpus_findings", "dataset_summary", "detect", "explain", "flagged", "forget_entity",
    "load_entities", "mask_text", "override_config", "privacy_report", "recommendations", "register_entity", "scratch", "verdict",
]
