"""Suffix arrays in numpy and as DataFrame steps, and the removal of repeats in small blocks."""

from __future__ import annotations

from random import Random

import numpy as np
import pytest

from moveloom.llm import difference_cover, substrings
from moveloom.llm.suffix_array import suffix_array, window_groups

from .fixtures import some_texts
from .test_documents import removed_by_hand


def order_by_hand(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_by_hand():
    rng = Random(5)
    for n in [*range(0, 30), 60, 200]:
        for kinds in (1, 2, 5, 300):
            s = [rng.randint(1, kinds) for _ in range(n)]
            assert suffix_array(np.array(s, np.int64)).tolist() == order_by_hand(s)


def test_windows_are_grouped_by_content():
    rng = Random(6)
    text = np.array([rng.randint(2, 3) for _ in range(400)], np.int64)
    starts = np.arange(0, 390)
    groups = window_groups(text, starts, 6)
    assert len(set(groups.tolist())) == len({tuple(text[i : i + 6]) for i in starts})
    by = {}
    for i, g in zip(starts, groups, strict=True):
        assert by.setdefault(int(g), tuple(text[i : i + 6])) == tuple(text[i : i + 6])


@pytest.mark.parametrize("n, kinds", [(1, 1), (7, 1), (41, 2)])
def test_distributed_ranks_by_hand(spark, monkeypatch, n, kinds):
    monkeypatch.setattr(difference_cover, "BLOCK_POSITIONS", 7)
    rng = Random(n)
    s = [rng.randint(1, kinds) for _ in range(n)]
    got = difference_cover.suffix_ranks(spark, spark.createDataFrame(list(enumerate(s)), "pos long, a long"), n).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.rank)] == order_by_hand(s) and sorted(r.rank for r in got) == list(range(1, n + 1))


def test_repeats_in_small_blocks_chunks_and_buckets(spark, monkeypatch):
    for name, value in (("BLOCK", 300), ("CHUNK_ANCHORS", 40), ("BUCKET_BYTES", 200)):
        monkeypatch.setattr(substrings, name, value)
    rows = [*some_texts(40, 8), (300, "ab" * 200), (301, "ba" * 150), (302, "x" * 120), (303, "é漢" * 40)]
    got = substrings.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(removed_by_hand(rows))


def test_ids_that_are_equal_or_null(spark):
    """Rows of one id never take each other's bytes; a null id counts as larger than any other."""
    one, two = "a passage that two rows of one identifier have in common, word for word", "and this is the text that a row without an id repeats from another one"
    rows = [(5, one + " first"), (5, one + " second"), (7, two), (None, two + " end"), (None, two + " other")]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5, len(one) + 6] == 0 and got[5, len(one) + 7] == 0 and got[7, len(two)] == 0
    assert got[None, len(two) + 4] == len(two) and got[None, len(two) + 6] == len(two)
