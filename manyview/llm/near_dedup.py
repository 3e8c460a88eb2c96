"""Near-duplicate documents by MinHash and sequential Bayesian verification.

Documents with the same set of word shingles form a class, found by two independent
digests of the set; only classes are compared. Signatures are cut into bands; classes
that agree in a band share a bucket. Each bucket is put under its most central member,
the one with the most neighbours over all bands, so that the buckets of one group of
copies, forty or so, become one cluster under few centres instead of forty lists of
the same pairs.

A pair is compared signature batch by batch. After each batch, the posterior of its
similarity given the agreements so far decides: if the chance that the similarity
reaches the threshold is below ``miss``, the pair is dropped. What survives is verified
on the words of both texts.

1. Members of a cluster are compared with its centre, in parts of bounded bytes. That
   joins nearly all that there is to join, and no cluster costs more than its texts.
2. Members that are not joined with most of their cluster are compared with the rest
   by signatures alone, block against block.
3. Texts are sent only for those that survive there, and their pairs are verified.

No task gives back more than the links that join what was apart, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.llm.components import label_components
from manyview.llm.scratch import Scratch
from manyview.llm.text_columns import row_key
from manyview.llm.word_arrays import LOWER, Chunk, Runs, binary_column, chunks, mix, signed, word_digests, words
from manyview.llm.worker_code import ship

SHINGLE = 5
#: Values in a band, and the chance that two documents at the threshold agree in no band.
ROWS, APART = 8, 3e-6
BATCHES = (32, 64, 128, 224, 320)
#: Members of a block of signatures, of which a task holds two; bytes of text in a part or a block of texts.
BLOCK, TEXT_BYTES = 1000, 512 << 10
SIGNATURES = "id long, row long, n long, class long, check long, bytes long, bands array<long>, sig binary"


def bands_at(percent: int) -> int:
    """The fewest bands with which documents at the threshold miss each other with at most ``APART``: 40 at 85, 70 at 80."""
    agree = (percent / 100) ** ROWS
    return max(1, math.ceil(math.log(APART) / math.log1p(-agree))) if agree < 1 else 1


def hashes(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of the hash functions."""
    rng = np.random.default_rng(85)
    a = rng.integers(0, 1 << 32, bands * ROWS, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, bands * ROWS, dtype=np.uint32)


def batch_ends(bands: int) -> list[int]:
    return [*[end for end in BATCHES if end < bands * ROWS], bands * ROWS]


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a chunk, by two digests, sorted by text, and each text's number of them."""
    w = words(chunk)
    texts = len(chunk.offsets) - 1
    count = np.diff(w.offsets)
    short = np.flatnonzero((count > 0) & (count < size))
    n = max(0, len(w.starts) - size + 1)
    inside = np.flatnonzero(w.text[:n] == w.text[size - 1 :]) if n else np.zeros(0, np.int64)
    both = []
    for which in (0, 1):
        runs = Runs(word_digests(chunk, w, lower=True, which=which))
        both.append(np.concatenate([runs.every(size)[inside], runs.of(w.offsets[short], w.offsets[short + 1])]))
    h, text = both[0], np.concatenate([w.text[inside], short]).astype(np.uint64)
    bits = np.uint64(max(1, texts.bit_length()))
    key = (text << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return h[order][new], both[1][order][new], np.bincount(text[order][new].astype(np.int64), minlength=texts)


def shingles_of(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, as words."""
    w = text.translate(LOWER.tobytes()).split()
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(size)], strict=False))


def signatures(batches: Iterator[pa.RecordBatch], size: int, count: int) -> Iterator[pa.RecordBatch]:
    factors, addends = hashes(count)
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            sets, seconds, n = shingle_sets(chunk, size)
            some = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[some]
            sig = np.zeros((len(some), count * ROWS), np.uint32)
            kind, check = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                x = (sets >> np.uint64(32)).astype(np.uint32)
                v = np.empty_like(x)
                for i in range(count * ROWS):
                    np.multiply(x, factors[i], out=v)
                    np.add(v, addends[i], out=v)
                    sig[:, i] = np.minimum.reduceat(v, begin)
                kind[some] = mix(np.add.reduceat(mix(sets), begin) + n[some].astype(np.uint64))
                check[some] = mix(np.add.reduceat(mix(seconds), begin) + n[some].astype(np.uint64))
            parts = sig.reshape(len(some), count, ROWS).view(np.uint64)
            key = np.broadcast_to(np.arange(count, dtype=np.uint64), (len(some), count)).copy()
            for i in range(parts.shape[2]):
                key = mix(key ^ parts[:, :, i])
            full = np.zeros(len(n), np.int64)
            full[some] = count
            here = np.full(len(n), -1)
            here[some] = np.arange(len(some))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).slice(chunk.first, chunk.last - chunk.first) for i in (0, 1)],
                    pa.array(n.astype(np.int64)),
                    *[pa.array(signed(x)) for x in (kind, check)],
                    pa.array(np.diff(chunk.offsets)),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full)]).astype(np.int32), signed(key.reshape(-1))),
                    binary_column(sig.astype(np.uint16)).take(pa.array(here, mask=here < 0)),
                ],
                names=["id", "row", "n", "class", "check", "bytes", "bands", "sig"],
            )


def least_matches(threshold: float, miss: float, ends: Sequence[int] = BATCHES) -> list[int]:
    """For each batch end, the fewest agreements with which the similarity, uniform
    before and binomially observed, reaches ``threshold`` with probability ``miss``."""
    j = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in ends:
        for m in range(n + 1):
            log = m * np.log(j) + (n - m) * np.log1p(-j)
            p = np.exp(log - log.max())
            if p[j >= threshold].sum() >= miss * p.sum():
                out.append(m)
                break
    return out


class Joined:
    """Which members of a task are joined already."""

    def __init__(self, root: np.ndarray):
        self.root = root.copy()

    def join(self, a: int, b: int) -> bool:
        x, y = self.root[a], self.root[b]
        if x == y:
            return False
        self.root[self.root == max(x, y)] = min(x, y)
        return True


class Task:
    """Classes of one task: what is asked of each, and which are joined already."""

    def __init__(self, task: pa.Table, percent: int, ends: list[int], least: list[int]):
        _, one = np.unique(task["class"].to_numpy(), return_index=True)
        task = task.take(pa.array(one))
        self.kind, self.n = (task[c].to_numpy() for c in ("class", "n"))
        self.side = task["side"].to_numpy() if "side" in task.column_names else None
        self.sig = np.frombuffer(b"".join(task["sig"].to_pylist()), np.uint16).reshape(len(self.kind), -1)
        self.texts = task["text"].combine_chunks() if "text" in task.column_names else None
        self.percent, self.ends, self.least = percent, ends, least
        _, first = np.unique(task["root"].to_numpy(), return_inverse=True) if "root" in task.column_names else (None, self.places())
        self.joined = Joined(first)

    def places(self) -> np.ndarray:
        return np.arange(len(self.kind))

    def others(self, i: int) -> np.ndarray:
        """Later members that may be compared with ``i``: two of the rest of a cluster are not."""
        later = self.places()[i + 1 :]
        return later if self.side[i] else later[self.side[later] > 0]

    def surviving(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that no batch drops, the most alike first."""
        n = self.n
        small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
        others = others[(100 * small >= self.percent * large) & (self.joined.root[others] != self.joined.root[i])]
        agree, done = np.zeros(len(others), np.int64), 0
        for end, enough in zip(self.ends, self.least, strict=True):
            if not len(others):
                break
            agree = agree + (self.sig[others, done:end] == self.sig[i, done:end]).sum(1)
            others, agree, done = others[agree >= enough], agree[agree >= enough], end
        return others[np.argsort(-agree, kind="stable")]

    def link(self, i: int, others: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """Links of ``i`` to those of ``others`` that its words confirm."""
        own = None
        for j in self.surviving(i, others):
            if self.joined.root[i] == self.joined.root[j]:
                continue
            if own is None:
                own = shingles_of(self.texts[i].as_buffer().to_pybytes(), size)
            theirs = shingles_of(self.texts[int(j)].as_buffer().to_pybytes(), size)
            both = len(own & theirs)
            if 100 * both >= self.percent * (len(own) + len(theirs) - both) and self.joined.join(i, int(j)):
                yield self.kind[i], self.kind[j]


def table_of(links: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def star(task: pa.Table, centre: int, size: int, *how) -> pa.Table:
    """Links of a cluster's centre to a part of its members."""
    t = Task(task, *how)
    (middle,) = np.flatnonzero(t.kind == centre)
    return table_of(list(t.link(int(middle), np.delete(t.places(), middle), size)))


def candidates(task: pa.Table, key: tuple, *how) -> pa.Table:
    """The classes of a pair of blocks that are in any pair that survives."""
    t = Task(task, *how)
    found = np.zeros(len(t.kind), bool)
    for i in t.places():
        near = t.surviving(int(i), t.others(i))
        found[near] = True
        found[i] |= len(near) > 0
    n = int(found.sum())
    return pa.table({"centre": np.full(n, key[0]), "lo": np.full(n, key[1], np.int32), "hi": np.full(n, key[2], np.int32), "class": t.kind[found]})


def links_of(task: pa.Table, size: int, *how) -> pa.Table:
    """Links that join members of two blocks (or of one with itself)."""
    t = Task(task, *how)
    return table_of([x for i in t.places() for x in t.link(int(i), t.others(i), size)])


def dealt(clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """(centre, class, root, side, lo, hi): members of clusters that are not joined
    throughout, for every pair of blocks in which they are compared. ``side`` is 0 for
    the largest part that is joined, whose members need not be compared with each other."""
    parts = scratch.table(clusters.groupBy("centre", "root").agg(F.count("*").alias("n")), "parts")
    most = parts.groupBy("centre").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    most = most.select("centre", F.col("most.root").alias("main"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("n") - F.col("most.n")).alias("others"))
    placed = clusters.join(scratch.table(most, "most"), "centre").withColumn("side", (F.col("root") != F.col("main")).cast("int"))
    # blocks of the others are numbered first, then those of the main part
    own = F.when(F.col("side") == 1, F.pmod(F.xxhash64("class"), "others")).otherwise(F.col("others") + F.pmod(F.xxhash64("class"), "mains")).cast("int")
    partners = F.when(F.col("side") == 1, F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))
    placed = placed.withColumn("block", own).withColumn("other", F.explode(partners))
    return placed.select("centre", "class", "root", "side", F.least("block", "other").cast("int").alias("lo"), F.greatest("block", "other").cast("int").alias("hi"))


def near_duplicates(
    docs: DataFrame, *, shingle: int = SHINGLE, percent: int = 85, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """For every row: ``id``, ``row`` (which tells rows of an id apart), ``n`` (its
    distinct shingles), ``component`` (the smallest id that it is linked with, over
    any number of links) and ``keeper`` (true for one row of each component, but for
    rows equal in id and text, which are true together).

    Documents are linked if 100 times the shared shingles are at least ``percent``
    times those of either, which is confirmed on the words. A text of fewer words than a shingle has one shingle, all
    of it; null and empty texts have none and are linked with nothing. Null ids never
    are the smallest unless a component has no others. Very long texts are parts of
    their own where texts are compared. An empty table gives an empty result. A link can be missed if its
    documents meet in no band (3e-6 at ``percent``, less above) or are dropped by a batch
    (``miss``). Only the id and text of ``docs`` are read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    ship(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    bands = bands_at(percent)
    ends = batch_ends(bands)
    every = scratch.table(keyed.mapInArrow(lambda it: signatures(it, shingle, bands), SIGNATURES), "signatures")
    # sets that agree in one digest only are two classes
    clash = every.groupBy("class").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("class", F.lit(True).alias("clash"))
    clash = scratch.table(clash, "clash")
    if not clash.isEmpty():
        apart = F.when(F.col("clash"), F.xxhash64("class", "check")).otherwise(F.col("class"))
        every = scratch.table(every.join(clash, "class", "left").withColumn("class", apart).select(every.columns), "signatures")
    banded = every.select("class", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("band")
    members = scratch.table(banded.join(scratch.table(full, "buckets"), "band", "left_semi").distinct(), "members")
    sizes = scratch.table(members.groupBy("band").agg(F.count("*").alias("size")), "sizes")
    degree = scratch.table(members.join(sizes, "band").groupBy("class").agg(F.sum("size").alias("degree")), "degree")
    # the degree leads; among equal ones, digests decide, the same in all bands
    rank = F.col("degree") * F.lit(1 << 20) + F.col("class").bitwiseAND(F.lit((1 << 20) - 1))
    centres = scratch.table(members.join(degree, "class").groupBy("band").agg(F.max_by("class", rank).alias("centre")), "centres")
    clusters = scratch.table(members.join(centres, "band").select("centre", "class").distinct(), "clusters")
    scratch.drop(members, sizes, degree, centres)
    # one row stands for its class
    asked = scratch.table(clusters.select("class").distinct(), "asked")
    one = every.join(asked, "class", "left_semi").groupBy("class").agg(F.min(F.struct("id", "row")).alias("one"))
    one = one.select("class", "one.*")
    sig = every.select("class", "id", "row", "n", "bytes", "sig").alias("s")
    chosen = one.alias("o").join(sig, F.expr("o.class = s.class AND o.id <=> s.id AND o.row = s.row")).select("o.class", "o.id", "o.row", "n", "bytes", "sig")
    chosen = scratch.table(chosen.dropDuplicates(["class"]), "chosen")
    items = chosen.alias("c").join(keyed.alias("k"), F.expr("c.id <=> k.id AND c.row = k.row")).select("class", "n", "bytes", "sig", "text")
    # rows equal in id and text are one
    items = scratch.table(items.dropDuplicates(["class"]), "items")
    how = (percent, ends, least_matches(percent / 100, miss, ends))
    stored = clusters.join(chosen.select("class", "bytes"), "class")
    loads = stored.groupBy("centre").agg(F.ceil(F.sum("bytes") / F.lit(TEXT_BYTES)).cast("int").alias("parts"))
    loads = scratch.table(loads.withColumn("parts", F.greatest("parts", F.lit(1))), "loads")
    members = clusters.where("class <> centre").join(loads, "centre").select("centre", "class", F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"))
    middles = loads.select("centre", F.col("centre").alias("class"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    stars = members.unionByName(middles).join(items, "class").groupBy("centre", "part")
    links = scratch.table(stars.applyInArrow(lambda key, t: star(t, key[0].as_py(), shingle, *how), "a long, b long"), "links")
    labels = label_components(links, scratch)
    rooted = clusters.join(labels, "class", "left").select("centre", "class", F.coalesce("root", "class").alias("root"))
    pairs = scratch.table(dealt(scratch.table(rooted, "rooted"), scratch), "dealt")
    near = pairs.join(chosen.select("class", "n", "sig"), "class").groupBy("centre", "lo", "hi")
    near = near.applyInArrow(lambda key, t: candidates(t, tuple(k.as_py() for k in key), *how), "centre long, lo int, hi int, class long")
    near = pairs.join(scratch.table(near, "candidates"), ["centre", "lo", "hi", "class"], "left_semi")
    found = near.join(items, "class").groupBy("centre", "lo", "hi").applyInArrow(lambda t: links_of(t, shingle, *how), "a long, b long")
    found = scratch.table(found, "more_links")
    if not found.isEmpty():
        labels = label_components(links.unionByName(found), scratch)
    scratch.drop(clusters, asked, chosen, items)
    # the smallest id of each class, then of each component, with the row to keep
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = scratch.table(every.where("n > 0").groupBy("class").agg(first.alias("first")), "classes")
    rooted = classes.join(labels, "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = scratch.table(rooted, "rooted")
    roots = scratch.table(rooted.groupBy("root").agg(F.min("first").alias("first")), "roots")
    best = scratch.table(rooted.select("class", "root").join(roots, "root").select("class", "first"), "best")
    out = every.select("id", "row", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(best, "class", "left")
    return out.select(
        "id",
        "row",
        "n",
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component"),
        (F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row")))).alias("keeper"),
    )
