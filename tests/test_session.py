import os

from clubspark import session
from clubspark.session import materialize, release, shared_folder


def test_released_folders_are_gone(spark):
    """Only the folders handed out are deleted, whether or not something was written there."""
    others = session._made.copy()
    session._made.clear()
    try:
        kept = materialize(spark.range(5))
        assert sorted(r["id"] for r in kept.collect()) == list(range(5))
        written, unused = session._made[0], shared_folder(spark)
        assert os.path.exists(written) and not os.path.exists(unused)
        assert release(spark) == 2
        assert not os.path.exists(written) and os.path.exists(os.path.dirname(written))
        assert release(spark) == 0
    finally:
        session._made.extend(others)
