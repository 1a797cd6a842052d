"""The graph export has no step that gathers all rows in one value."""

import inspect

from fadegraph.sources import tables


def test_export_is_rows_only():
    assert not hasattr(tables, "graph_json") and "collect_list" not in inspect.getsource(tables)
