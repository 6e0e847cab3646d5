"""Near-duplicate documents by MinHash bands, odd sketches and full shingle sets.

1. Each text gives its set of word shingles, MinHash samples of it, band hashes of these, and an odd sketch: a bitmap in
   which every sample toggles one bit. Documents with equal sets are one node from here on.
2. Nodes that share a band hash are candidates. In a bucket of at most ``BUCKET`` nodes those are joined whose sketches and
   sizes allow the similarity, so texts that share a passage by chance make no families that grow faster than the input; a
   larger bucket is a star around its least node. Either gives at most one edge for each node; their components are families.
3. Only nodes in families of two or more get their full sets, once each. Families are dealt into blocks of at most
   ``BLOCK`` nodes; each block meets a hub of the family's nodes, and in a block two nodes that are not linked yet are
   compared: first the exclusive-or of their sketches, whose population count estimates high similarities precisely,
   then their full sets. A block gives at most one edge for each node.
4. In families of more than one block, what is outside of the family's largest component then meets every block.
   So every pair of a family whose sketches allow the similarity is compared in full or linked already.

Chance enters by the bands alone: with 28 bands of 4 samples a pair at similarity 0.85 shares none with probability 1e-9,
at 0.8 with 4e-7; the sketch's limit is more than five standard deviations away from either.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.llm.components import components
from millrace.llm.shared import drop_staged, staged

BANDS, ROWS, SKETCH_BITS, BLOCK, HUB, BUCKET = 28, 4, 512, 256, 64, 1 << 14
_R = np.random.default_rng(7)
_A, _B = (_R.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_NULL_ID = -(2**63)


def shingles(w: words.Words, grams: np.ndarray, text: int, k: int) -> np.ndarray:
    """The sorted set of hashes of a text's shingles of ``k`` words; the whole text is one where it has fewer.

    ``grams``: the hashes of ``k`` words from each word on.
    """
    a, b = int(w.first[text]), int(w.first[text + 1])
    if b - a >= k:
        return np.unique(grams[a : b - k + 1])
    return words.spans(w.hashes, np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def minhash(shingle_set: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples: the least value of each hash function over the set."""
    out = np.full(len(_A), 2**32 - 1, np.uint32)
    for at in range(0, len(shingle_set), 4096):
        part = shingle_set[at : at + 4096]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, (low[None, :] * _A[:, None] ^ high[None, :] * _B[:, None]).min(axis=1), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    rows, out = samples.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = words.mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as bytes."""
    place = words.mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32)))
    return np.packbits(np.bincount((place % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1)


def most_odd_bits(percent: int) -> int:
    """The population count up to which two sketches may belong to sets of this similarity: five deviations more."""
    k, j = BANDS * ROWS, percent / 100
    least = max(0.0, j - 5.5 * math.sqrt(j * (1 - j) / k))
    mean = SKETCH_BITS / 2 * (1 - math.exp(-4 * k * (1 - least) / SKETCH_BITS))
    return math.ceil(mean + 10)


_FEATURES = "__id long, __h long, n_shingles long, set binary, bands array<long>, sketch binary"


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in words.of(batches, 2, lower=True):
            grams, n, digests, all_bands, sketches = words.windows(w.hashes, k), [], [], [], []
            for i in range(batch.num_rows):
                s = shingles(w, grams, i, k)
                samples = minhash(s)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                all_bands.append(bands(samples) if len(s) else np.zeros(0, np.int64))
                sketches.append(odd_sketch(samples).tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in all_bands])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_bands)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), listed, pa.array(sketches, pa.binary())],
                ["__id", "__h", "n_shingles", "set", "bands", "sketch"],
            )

    return run


def _members(k: int):
    """A row listed often is one set: the join before brings its copies to one task, or to few where it is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in words.of(words.once(batches, 0), 3, lower=True):
            grams = words.windows(w.hashes, k)
            sets = [shingles(w, grams, i, k).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], ["node", "family", "sketch", "shingles"])

    return run


def _whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables that hold whole groups of equal keys, with the places where groups begin, and the end."""

    def starts(values: list[np.ndarray]) -> np.ndarray:
        changed = np.any([v[1:] != v[:-1] for v in values], axis=0)
        return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(values[0])]])

    def table(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts)
        return t, starts([t.column(k).to_numpy() for k in keys])

    last, held = None, []  # the group that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        if held and last != [v[0] for v in values]:
            yield table(held)
            held = []
        at = int(starts(values)[-2])
        if at:
            yield table([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
        last = [v[-1] for v in values]
    if held:
        yield table(held)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], ["a", "b"])


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _odd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1)


def _alike(percent: int):
    """Edges that join the nodes of one bucket that pairs which may be linked connect: one for each node but one of every component.

    All of a bucket are compared with its first node at once, and what is not alike to it with what is, until nothing is left.
    """
    most = most_odd_bits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _whole(batches, ["band"]):
            node, size, sketch = t.column("node").to_numpy(), t.column("n_shingles").to_numpy(), _matrix(t.column("sketch").to_pylist())

            def may(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
                return (_odd(sketch[x], sketch[y]) <= most) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))

            head = np.repeat(at[:-1], np.diff(at))
            near = may(np.arange(len(node)), head)
            with_head = near & (head != np.arange(len(node)))
            a, b = [node[with_head]], [node[head[with_head]]]
            for bucket in np.flatnonzero((np.diff(at) > 2) & (np.add.reduceat(~near, at[:-1]) > 0)).tolist():
                rows = np.arange(at[bucket], at[bucket + 1])
                left, todo = rows[~near[rows]], rows[near[rows]][1:].tolist()
                while len(left):
                    if not todo:
                        todo, left = [int(left[0])], left[1:]
                    i = todo.pop()
                    hit = may(left, i)
                    if hit.any():
                        found = left[hit]
                        a.append(node[found])
                        b.append(np.full(len(found), node[i]))
                        todo += found.tolist()
                        left = left[~hit]
            yield _edges(a, b)

    return run


def _links(node: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], root: np.ndarray, percent: int, most: int) -> tuple[list, list]:
    """Edges of different nodes that join those which are linked and have another root: one for each but one of every component."""
    sizes = np.array([len(s) for s in sets])
    a, b = [], []
    for i in range(len(node)):
        may = root[i + 1 :] != root[i]
        if not may.any():
            continue
        odd = _odd(sketch[i + 1 :], sketch[i])
        least, largest = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        may &= (odd <= most) & (100 * least >= percent * largest)
        for j in (np.flatnonzero(may)[np.argsort(odd[may], kind="stable")] + i + 1).tolist():
            if root[i] == root[j]:
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                a.append(node[i])
                b.append(node[j])
                root[root == root[j]] = root[i]
    return a, b


def _linked(percent: int, keys: list[str]):
    """The edges of each block of rows with equal ``keys``; rows come sorted by them, so that one batch may hold many small families."""
    most = most_odd_bits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _whole(batches, keys):
            a, b = [], []
            for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
                own = t.slice(first, end - first)
                node, once = np.unique(own.column("node").to_numpy(), return_index=True)
                if len(node) < 2:
                    continue
                own = own.take(pa.array(once)) if len(once) < end - first or (np.diff(once) < 0).any() else own
                root = own.column("root").to_numpy().copy() if "root" in t.column_names else node.copy()
                sets = [np.frombuffer(s, np.uint64) for s in own.column("shingles").to_pylist()]
                some = _links(node, _matrix(own.column("sketch").to_pylist()), sets, root, percent, most)
                for edges, new in zip((a, b), some):
                    edges.append(np.array(new, np.int64))
            yield _edges(a, b)

    return run


def _compared(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(percent, list(keys)), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``.

    Words are runs without ASCII white space, A to Z lower-cased; texts with fewer than ``shingle`` words are one shingle.
    Rows are linked where 100 * intersection >= percent * union of their sets; component_id is the least id reachable.
    Null and empty texts have no shingles and no links. Rows with equal ids and other texts are nodes of their own, but
    the least id names their components. A null id counts as less than any other. Repeated rows are linked, and each
    has ``kept`` where its id is the component's; but one of them is compared with others. Other columns are not read. No rows give no rows.
    """
    feats, named = _named(docs, id_col, text_col, shingle, percent)
    least = named.groupBy("label").agg(F.min("__id").alias("component_id"))
    named = named.join(least, "label").select(F.col("set").alias("__set"), "component_id")
    out = feats.select("__id", "n_shingles", "set").join(named, (F.col("set") == F.col("__set")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", "__id")
    real = lambda c: F.when(c != _NULL_ID, c)
    return out.select(
        real(F.col("__id")).alias(id_col), "n_shingles", real(component).alias("component_id"), (F.col("__id") == component).alias("kept")
    )


def _keys(id_col: str, text_col: str) -> list[Column]:
    """What tells a document from others: its id and its text's hash."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("__id"), F.xxhash64(text_col).alias("__h")]


def _named(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The features of all rows; and set, the least __id and __h that have it, and its component's label, for each set."""
    keyed = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("__text"))
    feats = staged(keyed.mapInArrow(_features(shingle), _FEATURES), "features")
    sets = (
        feats.where("n_shingles > 0").groupBy("set")
        .agg(F.min(F.struct("__id", "__h")).alias("__one"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
        .select("set", "__one.*", "bands", "sketch", "n_shingles")
    )
    sets = staged(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    labels = _components(keyed, sets, shingle, percent)
    named = sets.select("set", "node", "__id", "__h").join(labels, "node", "left")
    return feats, named.withColumn("label", F.coalesce("label", "node"))


def _components(keyed: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, label of all nodes that are linked to any other."""
    banded = staged(sets.select("node", F.explode("bands").alias("band")), "bands")
    stars = banded.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("__band"), "b", "n")
    shared = staged(banded.join(stars, F.col("band") == F.col("__band")).select("band", "node", "b", "n"), "shared")
    drop_staged(banded)
    sketches = sets.select(F.col("node").alias("__s"), "sketch", "n_shingles")
    sieved = shared.where(F.col("n") <= BUCKET).join(sketches, F.col("node") == F.col("__s")).select("band", "node", "sketch", "n_shingles")
    sieved = sieved.repartition("band").sortWithinPartitions("band").mapInArrow(_alike(percent), "a long, b long")
    families = components(sieved.unionByName(shared.where(F.col("n") > BUCKET).select(F.col("node").alias("a"), "b")))
    drop_staged(shared)
    sized = families.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("__l"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    wanted = sets.select("node", "__id", "__h", "sketch").join(families, "node").select("node", F.col("label").alias("family"), "sketch", "__id", "__h")
    one_text = keyed.withColumnsRenamed({"__id": "__ki", "__h": "__kh"}).join(wanted, (F.col("__id") == F.col("__ki")) & (F.col("__h") == F.col("__kh")))
    members = one_text.select("node", "family", "sketch", "__text").mapInArrow(_members(shingle), "node long, family long, sketch binary, shingles binary")
    members = staged(members.join(sized, F.col("family") == F.col("__l")).drop("__l"), "members")
    hubs = F.col("blocks") > 1, F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("blocks") * BLOCK / HUB)) == 0
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    dealt = members.withColumn("block", F.explode(F.when(hubs[0] & hubs[1], F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    links = staged(_compared(dealt, percent, "family", "block"), "links")
    labels, large = components(links), members.where("blocks > 1")
    if large.isEmpty():
        drop_staged(members, links)
        return labels
    large = large.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node")).drop("label")
    counted = large.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    counted = counted.select(F.col("family").alias("__f"), F.col("m.root").alias("giant"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("rest"))
    large = large.join(counted.where("rest > 0"), F.col("family") == F.col("__f"))
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rest").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("rest") - 1)
    rest = F.col("root") != F.col("giant")
    meets = large.withColumn("block", F.explode(own)).withColumn("other", F.explode(every))
    visits = large.where(rest).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", mine)
    more = meets.unionByName(visits).select("node", "family", "sketch", "shingles", "root", "block", "other")
    joined = components(links.unionByName(_compared(more, percent, "family", "block", "other")))
    drop_staged(members, links)
    return joined


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, as it is: of the least id, a null id being the least, and of its texts one.

    Of rows that repeat that id and text any one stays. Rows without shingles are no copies of anything and all stay.
    Repeats are combined before they are dealt out, so a row repeated often makes no large task.
    """
    _, named = _named(docs, id_col, text_col, shingle, percent)
    kept = named.groupBy("label").agg(F.min(F.struct("__id", "__h")).alias("k")).select("k.*")
    worded = F.coalesce(F.rlike(text_col, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    rows = docs.where(worded).select(*_keys(id_col, text_col), F.struct("*").alias("row"))
    rows = rows.groupBy("__id", "__h").agg(F.first("row").alias("row")).join(kept, ["__id", "__h"], "left_semi")
    return rows.select("row.*").unionByName(docs.where(~worded))
