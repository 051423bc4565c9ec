"""Imports every query module so the registry is complete."""

from annospark.plans import (  # noqa: F401
    audit_queries, contract_queries, knn_queries, label_queries, metric_queries, model_queries, ontology_queries, source_queries,
    stream_queries,
    submit_queries, text_queries)
from annospark.plans.registry import REGISTRY  # noqa: F401
