import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CACHING = {"test_large_runs_look_at_their_own_texts_only"}  # tests that cache tables themselves


@pytest.fixture(autouse=True)
def own_caches_dropped(request):
    """Later tests count the caches that queries leave."""
    if request.node.name not in CACHING:
        yield
        return
    spark = request.getfixturevalue("spark")
    yield
    spark.catalog.clearCache()
