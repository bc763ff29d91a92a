import random

import numpy as np
import pyarrow as pa
import pytest

from tidewise.llm.licence_scan import scan_licences
from tidewise.llm.near_duplicates import drop_near_duplicates, near_duplicate_classes
from tidewise.llm.words import chunks, hash_word, identities, second_hashes, words


def thue_morse(n, a, b):
    """The word whose letters at places with an even number of ones are a, the others b; it and its complement collide in polynomial hashes modulo 2^64."""
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_collide_in_polynomials(n):
    a, b = thue_morse(n, "a", "b").encode(), thue_morse(n, "b", "a").encode()
    assert hash_word(a) != hash_word(b) and hash_word(a) == hash_word(a.upper())


def test_two_classes_of_such_words(spark):
    rows = [(1, thue_morse(1024, "a", "b")), (2, thue_morse(1024, "b", "a")), (3, "under the mit license " + thue_morse(1024, "b", "a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicate_classes(docs).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert drop_near_duplicates(docs).count() == 3
    assert sorted((r.doc_id, r.n_base) for r in scan_licences(docs, ["doc_id"]).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_hashes_of_words_of_all_lengths():
    rng = random.Random(5)
    known = {bytes(rng.choices(b"abcdefgh0123456789\xc3\xa9", k=n)) for n in range(1, 300) for _ in range(8)}
    known |= {b"a" * n for n in range(1, 200)} | {b"a" * n + b"b" for n in range(1, 200)}
    texts = [b" ".join(known), b"-".join(sorted(known, reverse=True))]
    for _, _, data, offsets in chunks(pa.array(texts, pa.binary())):
        h, rows, starts, ends = words(data, offsets)
        other = second_hashes(data, starts, ends)
        found = {}
        for i, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            found.setdefault(data[lo:hi].tobytes(), set()).add((int(h[i]), int(other[i])))
        assert found.keys() == known and all(len(x) == 1 for x in found.values())
        pairs = {next(iter(x)) for x in found.values()}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(known) and not any(a == b for a, b in pairs)
        assert all(hash_word(w) == next(iter(found[w]))[0] for w in list(known)[:50])
        assert np.array_equal(np.diff(rows), [len(known)] * 2)


def test_identities_are_pairs():
    first, second = np.array([5, 5, 7, 5, 7, 1], np.uint64), np.array([1, 2, 3, 1, 3, 1], np.uint64)
    got = identities(first, second)
    want = list(zip(first.tolist(), second.tolist(), strict=True))
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(6) for j in range(6)) and sorted(set(got.tolist())) == [0, 1, 2, 3]
