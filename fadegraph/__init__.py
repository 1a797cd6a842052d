"""Graph memory on Spark: topics that fade, instances, and weighted links.

Every operator takes DataFrames and returns DataFrames; the sub-packages are

* ``functions`` - column expressions (vectors, text, scores) and embedders,
* ``sources``   - readers and writers,
* ``operators`` - joins, groupings, graph and table-update operators,
* ``plans``     - operators chained into ingest, search and maintenance,
* ``streaming`` - the same plans under Structured Streaming.
"""

from fadegraph.config import SearchConfig, SimilarityLimits
from fadegraph.schema import Snapshot

__all__ = ["SearchConfig", "SimilarityLimits", "Snapshot"]
