"""Intermediate tables of queries that run at once in one session."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from kinspark.plans import catalogue
from kinspark.sources import shared

DATA = "/root/testdata/sf0.001"


def test_queries_in_threads_keep_their_own_tables(spark):
    names = ["cascade_match", "connected_components", "member_match"] * 2
    alone = {n: sorted(map(str, catalogue.queries()[n](spark, DATA).collect())) for n in set(names)}
    with ThreadPoolExecutor(len(names)) as pool:
        found = list(pool.map(lambda n: sorted(map(str, catalogue.queries()[n](spark, DATA).collect())), names))
    assert found == [alone[n] for n in names]


def test_kept_tables_pass_outwards_and_the_rest_go(spark):
    with shared.passing(spark) as outer:
        with shared.passing(spark) as inner:
            gone, stays = (shared.settled(spark.range(n), "t") for n in (3, 4))
            inner.append(stays)
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            gone.collect()
        assert stays.count() == 4
        outer.append(stays)
    assert stays.count() == 4
    shared.release(stays)


def test_a_failing_block_deletes_its_tables_and_closes(spark):
    with pytest.raises(RuntimeError), shared.passing(spark):
        shared.settled(spark.range(2), "t")
        raise RuntimeError
    with shared.passing(spark) as kept:
        kept.append(after := shared.settled(spark.range(5), "t"))
    assert after.count() == 5
