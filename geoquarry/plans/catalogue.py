"""All registered queries."""

from geoquarry.plans import (  # noqa: F401
    answer_queries, change_queries, dataset_queries, embed_queries, pixel_queries, result_queries, routing_queries, scene_queries, trace_queries,
)
from geoquarry.plans.registry import ORACLE, QUERIES  # noqa: F401
