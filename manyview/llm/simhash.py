"""Near duplicates by SimHash, found with a pigeonring filter.

Fingerprints of 64 bits are cut into a ring of segments. If two differ in at most
``distance`` bits, then at one segment of the ring every chain of the next l segments
differs in at most l * distance / segments bits, for all l. The chains whose budget is
below one bit must agree, so that they are the key of a hash join; the longer chains
are held against their budgets one after another before the whole is compared.

A key that very many different fingerprints share is not paired up. There, every
fingerprint names itself and its neighbours at half the distance; those that name the
same one are linked to the smallest of them. Two fingerprints that name the same one are
within the distance, and two within the distance name a common one, so that nothing is
lost or added, and rows grow with the fingerprints and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyview.llm.components import label_components
from manyview.llm.scratch import Scratch
from manyview.llm.worker_code import ship

WIDTH, SHINGLE, SEED = 64, 3, 42
#: Bits in which linked fingerprints may differ, segments of the ring, and fingerprints of a key up to which they are paired.
DISTANCE, SEGMENTS, PAIRED = 2, 7, 64
#: Shingles of a long text that are counted at a time.
BLOCK = 1 << 16


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """Bits that are set in more than half of the shingles' XXH64; zero without words.

    Words are lower-cased in A-Z and parted by ASCII white space; with fewer words than a
    shingle has, all of them are the one shingle. Repeated shingles count each time.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()[size - 1 :] or [len(joined)]
    n = len(ends)
    counts = np.zeros(WIDTH, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[i : i + BLOCK], ends[i : i + BLOCK], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], carried: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint_of(t.as_py()) for t in batch.column(carried)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:carried], pa.array(found.view(np.int64))], [*batch.schema.names[:carried], "__fingerprint"])


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and ``__fingerprint`` (the 64 bits as a signed long) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(*carry, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _fingerprints(it, len(carry)), f"{fields}, __fingerprint long")


def ring(segments: int) -> list[int]:
    """Masks of the segments, alike in width but for a bit."""
    cuts = [i * WIDTH // segments for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chains(start: int, segments: int, distance: int) -> list[tuple[int, int]]:
    """(mask, budget) of the chains from a segment on, shortest first."""
    masks, out, mask = ring(segments), [], 0
    for length in range(1, segments + 1):
        mask |= masks[(start + length - 1) % segments]
        out.append((mask, length * distance // segments))
    return out


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << WIDTH) if mask >> (WIDTH - 1) else mask).cast("long")


def links(prints: DataFrame, scratch: Scratch, distance: int = DISTANCE, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """(a, b) between distinct fingerprints (column ``fp``), enough to connect all that differ in at most ``distance`` bits.

    Every pair within a key of up to ``paired`` fingerprints is there that is near enough;
    of larger keys, a star for each common neighbour, of links that are all near enough.
    """
    if distance % 2 or not 0 < distance < segments:
        raise ValueError("the distance is even, and there are more segments than that")
    agreeing = _same_masks(segments, distance)
    every = [F.struct(F.lit(start).alias("start"), F.col("fp").bitwiseAND(_long(same)).alias("same")) for start, same in enumerate(agreeing)]
    keyed = scratch.table(prints.select("fp", F.explode(F.array(*every)).alias("k")).select("fp", "k.start", "k.same"), "keyed")
    sizes = keyed.groupBy("start", "same").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.table(keyed.join(sizes, ["start", "same"]), "met")

    few = met.where(F.col("n") <= paired)
    a, b = few.select("start", "same", F.col("fp").alias("a")), few.select("start", "same", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    near = F.lit(False)
    for start in range(segments):
        held = F.col("start") == start
        for mask, budget in chains(start, segments, distance):
            if budget:
                held &= F.bit_count(differ.bitwiseAND(_long(mask))) <= budget
        near |= held
    pairs = a.join(b, ["start", "same"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()

    many = met.where(F.col("n") > paired).select("start", "same", "fp")
    steps = _within(distance // 2)
    free = F.array(*[F.array(*[_long(m) for m in steps if not m & same]) for same in agreeing])
    named = many.select("start", "same", "fp", F.explode(free[F.col("start")]).alias("step"))
    named = named.select("start", "same", "fp", F.col("fp").bitwiseXOR(F.col("step")).alias("name"))
    least = scratch.table(named.groupBy("start", "same", "name").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "names")
    stars = named.join(least.drop("n"), ["start", "same", "name"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def _same_masks(segments: int, distance: int) -> list[int]:
    """For each start, the bits of the longest chain in which none may differ."""
    return [max((m for m, budget in chains(s, segments, distance) if not budget), key=int.bit_count) for s in range(segments)]


def _within(bits: int) -> list[int]:
    """Differences of at most ``bits`` bits, none first."""
    out = {0}
    for _ in range(bits):
        out |= {m | (1 << i) for m in out for i in range(WIDTH)}
    return sorted(out)


def near_duplicates(docs: DataFrame, carry: list[str], distance: int = DISTANCE, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """``carry`` (with ``doc_id``), ``__fingerprint`` and ``__component`` for every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; the component
    is the smallest id that can be reached. Texts that are null, empty or without a word
    have the fingerprint zero, and are linked with each other like any others. Rows
    without an id are members too, but give a component its name only if it has no other
    (null). Repeated rows and ids are rows of their own. An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, carry), "prints")
    prints = scratch.table(rows.groupBy(F.col("__fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    found = scratch.table(links(prints.select("fp"), scratch, distance, segments, paired), "links")
    roots = label_components(found, scratch).select(F.col("class").alias("fp"), "root")
    named = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.table(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("__component"))
    told = named.join(least, "root").select(F.col("fp").alias("__fingerprint"), "__component")
    return rows.join(told, "__fingerprint").select(*carry, "__fingerprint", "__component")
