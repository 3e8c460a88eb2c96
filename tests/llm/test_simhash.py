"""SimHash near-duplicates against plain Python."""

import random
from collections import defaultdict

import pytest
import xxhash

from manyview.llm import simhash
from manyview.llm.scratch import Scratch


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=2):
    """fingerprint -> all that can be reached from it."""
    left, out = set(prints), {}
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            todo += near
        out |= dict.fromkeys(seen, frozenset(seen))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked(spark, prints, **how):
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    pairs = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, Scratch(spark, "t"), **how).collect()}
    assert all(a != b and (a ^ b).bit_count() <= how.get("distance", 2) for a, b in pairs)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, left = {}, set(prints)
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += near[x] & left
            left -= near[x]
        out |= dict.fromkeys(seen, frozenset(seen))
    return out


@pytest.fixture(scope="module")
def prints():
    rng = random.Random(3)
    found = {rng.getrandbits(64) for _ in range(60)}
    for p in list(found)[:30]:
        for _ in range(6):
            flipped = p
            for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
                flipped ^= 1 << rng.randrange(64)
            found.add(flipped)
    # many that agree in all but a few bits, so that a key is hot
    base = rng.getrandbits(64)
    found |= {base ^ (rng.getrandbits(14) << 30) for _ in range(200)}
    return sorted(found | {0, 2**64 - 1})


@pytest.mark.parametrize("paired", [0, 3, 64, 10_000])
def test_links(spark, prints, paired):
    """Keys that are paired up and keys that are named through neighbours give the same components."""
    assert linked(spark, prints, paired=paired) == components(prints)


@pytest.mark.parametrize("segments", [3, 5, 9])
def test_other_rings(spark, prints, segments):
    assert linked(spark, prints, segments=segments) == components(prints)


def test_wider_distance(spark, prints):
    assert linked(spark, prints, distance=4, paired=20) == components(prints, 4)


def test_chains_have_budgets():
    for start in range(7):
        budgets = [b for _, b in simhash.chains(start, 7, 2)]
        assert budgets == [0, 0, 0, 1, 1, 1, 2] and simhash.chains(start, 7, 2)[-1][0] == 2**64 - 1
    with pytest.raises(ValueError):
        simhash.links(None, None, distance=3)


def test_against_plain(spark, documents, corpus):
    out = simhash.near_duplicates(documents.withColumnRenamed("id", "__x"), ["doc_id", "source"]).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["__fingerprint"] % 2**64, r["__component"]) for r in out)
    prints = [(i, plain_print(t)) for i, t in corpus]
    reach = components({p for _, p in prints})
    ids = defaultdict(list)
    for i, p in prints:
        ids[p].append(i)
    least = {p: min((i for q in reach[p] for i in ids[q] if i is not None), default=None) for p in ids}
    assert got == sorted((i is None, i or 0, p, least[p]) for i, p in prints)
    assert len({r["__component"] for r in out if not r["__fingerprint"]}) == 1


def test_nothing(spark, nothing):
    assert simhash.near_duplicates(nothing, ["doc_id"]).count() == 0
