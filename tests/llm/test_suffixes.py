import random

import numpy as np
import pyarrow as pa

from wedgeworks.llm import substrings
from wedgeworks.llm.suffixes import sort_within


def test_suffixes_are_sorted_by_their_bytes():
    rng = random.Random(3)
    raw = np.frombuffer(bytes(rng.choices(b"ab\xff", k=200)) + b"a" * 300 + bytes(range(256)), np.uint8)
    at = np.array([rng.randrange(len(raw) - 50) for _ in range(2000)])
    group = np.array([rng.randrange(-2, 5) for _ in at])
    order, new = sort_within(raw, at, group, 50)
    keys = [(g, raw[a : a + 50].tobytes()) for g, a in zip(group.tolist(), at.tolist(), strict=True)]
    assert sorted(range(len(at)), key=keys.__getitem__) == order.tolist()  # equal ones keep their order
    assert new.tolist() == [i == 0 or keys[order[i]] != keys[order[i - 1]] for i in range(len(at))]


def test_texts_are_hashed_twice_and_not_again(docs, monkeypatch):
    """By bucket once for the hashes of anchors and once for contexts; the last step works from the bucket's note."""
    plan = substrings.removed_strings(docs)._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2
    assert plan.count("FlatMapGroupsInArrow") == 3  # hashes, what is shared, strings of earlier documents: each once


def test_larger_tables_get_larger_buckets_first(spark, docs, monkeypatch):
    """Messages are as many as buckets times places, so their number must not rise by the square of all input."""
    assert substrings.BUCKET_BYTES >= 8 << 20
    small = [sorted(map(tuple, substrings.removed_strings(docs, bucket_bytes=b).drop("starts", "ends").collect()), key=str) for b in (3000, 8 << 20)]
    assert small[0] == small[1]


def test_places_hold_near_equal_numbers_of_anchors():
    """An anchor's hash is the least of some thirty, so its own high bits would send most anchors to the first places."""
    raw = bytes(random.Random(4).choices(range(97, 123), k=200_000))
    rows = pa.table({"sha": pa.array([b"x", b"x"], pa.binary()), "doc": [None, 1], "text": pa.array([raw, None], pa.binary())})
    held = np.bincount(substrings._to(substrings.Anchors(substrings.Texts(rows)).hash, 50), minlength=50)
    assert held.max() < 1.3 * held.mean()
