"""Ids reserved by claims."""

import pytest

from shelfbook.sources import ranges, swap


def rows(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def test_ranges_follow_each_other_and_repeats_get_the_same(spark, tmp_path):
    path = str(tmp_path / "ids")
    held = spark.createDataFrame([(7,), (40,), (None,)], "id bigint")
    give = lambda claim, *keys: [tuple(r) for r in ranges.reserved_ids(path, claim, held, "id", rows(spark, *keys), ["k"], "id").orderBy("id").collect()]
    assert give("a", "y", "x") == [("x", 41), ("y", 42)]
    assert give("b", "z") == [("z", 43)]
    assert give("a", "x", "y") == [("x", 41), ("y", 42)]
    assert give("none") == [] and give("c", "q") == [("q", 44)]
    with pytest.raises(ValueError):
        give("a", "x")
    empty = str(tmp_path / "other")
    assert ranges.reserve(spark, empty, "a", 5, held.limit(0), "id") == 1


def test_runs_at_the_same_time_get_ranges_of_their_own(spark, tmp_path, monkeypatch):
    path, held = str(tmp_path / "ids"), spark.createDataFrame([(9,)], "id bigint")
    plain, others = swap.Folder.write_new, iter(["b", "c"])

    def late(self, name, text):
        """Another run makes its claim between the look and the file."""
        if other := next(others, None):
            monkeypatch.setattr(swap.Folder, "write_new", plain)
            ranges.reserve(spark, path, other, 3, held, "id")
            monkeypatch.setattr(swap.Folder, "write_new", late)
        return plain(self, name, text)

    monkeypatch.setattr(swap.Folder, "write_new", late)
    assert ranges.reserve(spark, path, "a", 2, held, "id") == 16
    assert [(c["claim"], c["first"], c["count"]) for c in ranges.claims(spark, path)] == [("b", 10, 3), ("c", 13, 3), ("a", 16, 2)]
    assert not [n for n in swap.Folder(spark, path).names() if n.startswith(swap.STAGED)]
