"""The maintenance run."""

from __future__ import annotations

from fadegraph.config import MAINTENANCE_MERGE_SIMILARITY, SimilarityLimits
from fadegraph.operators.discover import discover_topics
from fadegraph.operators.graph import forgotten_orphans
from fadegraph.operators.merge import merge_similar
from fadegraph.operators.updates import AsOf, cascade, fade_edges, prune_edges, rescore_importance
from fadegraph.schema import Snapshot, clock


def maintain(snapshot: Snapshot, as_of: AsOf = None, limits: SimilarityLimits = SimilarityLimits()) -> Snapshot:
    """Fade and prune edges, discover, merge, rescore, remove orphans, in this order."""
    now = clock(as_of)
    snapshot = snapshot.with_tables(edges=prune_edges(fade_edges(snapshot.edges)))
    snapshot = discover_topics(snapshot, as_of=now, limits=limits)
    snapshot = merge_similar(snapshot, MAINTENANCE_MERGE_SIMILARITY, limits=limits)
    snapshot = snapshot.with_tables(instances=rescore_importance(snapshot.instances, snapshot.topics, now))
    return cascade(snapshot, forgotten_orphans(snapshot.topics, snapshot.edges))
