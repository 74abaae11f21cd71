"""Exact n-gram Jaccard join by a token-group matrix.

A document is the set of its 5-word shingles. Two link when their sets' Jaccard
similarity reaches the threshold. The result is exact up to collisions of
``BITS``-bit token hashes:

1. Tasks send their sets' tokens, packed and sorted, to buckets of tokens. A
   bucket counts in how many sets each token is and answers with the tokens that
   several sets hold. Others cannot be in an overlap, so a set needs no more
   than its shared tokens and its size; one with too few of them links with none.
2. Of sets in order of rarity of their tokens, two that link share one among the
   first ``n - ceil(t n) + 1`` (prefix filter; tokens of one set alone come
   first). Sets that share such a token are compared with the one whose tokens
   are most shared. What gathers around such leaders is a group of similar
   documents; what links to them is a part of it.
3. A set that shares a prefix token with another part meets that part's group,
   kept as blocks of a token-group matrix: the block's token union bounds the
   overlap with any member, and only blocks that reach the bound are opened.

Nulls and texts without words have an empty set and link with nothing; fewer
than five words are one shingle. Repeated rows, and texts with equal sets, link; a row
without an id stays one, and names no class that it could be the smallest of. Columns
other than doc_id and text do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import id_text, slices, written
from .words import mix, shingles, word_hashes

THRESHOLD = 80  # in a hundred
BITS = 48  # of a token's hash; more for corpora of over 1e12 tokens
FLUSH = 1 << 20  # tokens that a task gathers before it sends them
BUCKET = 4 << 20  # tokens that a bucket is made for, whatever the corpus: packets get smaller as buckets get more
BLOCK = 1024  # sets in a block of a group
_INDEX = 20  # bits of a node that count within what a task sends at once
_CODEC = "zstd"


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    offsets, hashes = shingles(*word_hashes(texts))
    hashes = hashes >> np.uint64(64 - BITS)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def set_id(tokens: np.ndarray) -> int:
    """An id of a set of tokens, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens ^ np.uint64(0x5E7)).sum() + np.uint64(len(tokens))]))[0].view(np.int64))


def similar(both, n, m, threshold: int = THRESHOLD):
    """Whether sets of n and m tokens with ``both`` in common reach the threshold."""
    return 100 * both >= threshold * (n + m - both)


def prefix_size(n, threshold: int = THRESHOLD):
    """Tokens of which a set of n must share one with any set that it links with."""
    return n - (threshold * n + 99) // 100 + 1


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers byte plane by byte plane, compressed; the first one, in order, as steps."""
    out = [np.uint32(len(columns[0])).tobytes()]
    for i, c in enumerate(columns):
        c = np.diff(c, prepend=c.dtype.type(0)) if i == 0 else c
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T
        used = max((k + 1 for k in range(len(planes)) if planes[k].any()), default=0)
        out += [np.uint32(used).tobytes(), np.ascontiguousarray(planes[:used]).tobytes()]
    raw = b"".join(out)
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    size = int(np.frombuffer(data[:4], np.uint32)[0])
    raw = pa.decompress(data[4:], decompressed_size=size, codec=_CODEC, asbytes=True)
    n, at, out = int(np.frombuffer(raw[:4], np.uint32)[0]), 4, []
    for i, kind in enumerate(kinds):
        used = int(np.frombuffer(raw[at : at + 4], np.uint32)[0])
        planes = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
        planes[:used] = np.frombuffer(raw[at + 4 : at + 4 + used * n], np.uint8).reshape(used, n)
        at += 4 + used * n
        c = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(np.cumsum(c, dtype=kind) if i == 0 else c)
    return out


def _sent(texts: DataFrame, buckets: int) -> DataFrame:
    """Packets (bucket, flush, data): tokens and indexes by bucket, and, in a negative bucket, the documents of a flush.

    A flush is what a task sends at once; its different sets are numbered by indexes.
    """
    shift = np.uint64(BITS - (buckets - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        total, seen = 0, {}
        docs: list[tuple] = []  # doc_id, whether it is null, set_id, size, index

        def packets() -> pa.RecordBatch:
            sizes = [len(s) for s in held]
            tokens, index = np.concatenate([np.zeros(0, np.uint64), *held]), np.repeat(np.arange(len(held)), sizes).astype(np.uint32)
            order = np.argsort(tokens, kind="stable")
            tokens, index = tokens[order], index[order]
            bucket = (tokens >> shift).astype(np.int64)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))  # of the buckets that get any
            data = [_packed(tokens[a:b], index[a:b]) for a, b in zip(starts, np.append(starts, len(tokens))[1:], strict=True)]
            data.append(np.array(docs, np.int64).tobytes())
            if number >> 20 or part >> 22:
                raise OverflowError("a task sends too often for its numbers; use more partitions")
            flush = part << 20 | number
            return pa.RecordBatch.from_arrays(
                [pa.array([*bucket[starts].tolist(), -1 - (part * 7919 + number) % buckets], pa.int32()), pa.array([flush] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "flush", "data"]
            )

        for batch in slices(batches, "text", 1 << 20):
            for doc, s in zip(batch.column("doc_id").to_pylist(), sets_of(batch.column("text")), strict=True):
                own = set_id(s) if len(s) else 0
                at = -1
                if len(s) and own not in seen:
                    at = seen[own] = len(held)
                    held.append(s)
                    total += len(s)
                docs.append((doc or 0, doc is None, own, len(s), at))
            if total > FLUSH or len(docs) > 1 << (_INDEX - 1):
                yield packets()
                held, docs, total, seen, number = [], [], 0, {}, number + 1
        if docs:
            yield packets()

    return texts.mapInArrow(run, "bucket int, flush long, data binary")


def _answered(packets: DataFrame) -> DataFrame:
    """(flush, docs, data): of each flush the tokens that other sets have too, with their number of sets, and its documents."""

    def count(key, table):
        flushes, data = table.column("flush").to_pylist(), table.column("data").to_pylist()
        if key[0].as_py() < 0:
            return pa.table({"flush": pa.array(flushes, pa.int64()), "docs": pa.array([True] * len(data)), "data": pa.array(data, pa.binary())})
        parts = [_unpacked(d, np.uint64, np.uint32) for d in data]
        tokens = np.concatenate([p[0] for p in parts])
        order = np.argsort(tokens, kind="stable")
        new = np.concatenate(([True], np.diff(tokens[order]) != 0)) if len(tokens) else np.zeros(0, bool)
        times = np.diff(np.append(np.flatnonzero(new), len(tokens)))
        often = np.empty(len(tokens), np.int64)
        often[order] = np.repeat(times, times)
        out, at = [], 0
        for t, i in parts:
            own = often[at : at + len(t)]
            keep = own > 1
            out.append(_packed(t[keep], i[keep], np.minimum(own[keep], 2**31).astype(np.uint32)))
            at += len(t)
        return pa.table({"flush": pa.array(flushes, pa.int64()), "docs": pa.array([False] * len(data)), "data": pa.array(out, pa.binary())})

    return packets.groupBy("bucket").applyInArrow(count, "flush long, docs boolean, data binary")


def _candidates(answers: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, set_id, n, node, score, tokens, prefix) of each document; the last three for sets that can link at all, once a flush.

    tokens are the shared ones in order, score how often they are shared, prefix the
    rarest of them that the filter needs.
    """

    def collect(key, table):
        flush, docs, parts = key[0].as_py(), None, []
        for is_docs, data in zip(table.column("docs").to_pylist(), table.column("data").to_pylist(), strict=True):
            if is_docs:
                docs = np.frombuffer(data, np.int64).reshape(-1, 5)
            else:
                parts.append(_unpacked(data, np.uint64, np.uint32, np.uint32))
        tokens, index, often = (np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]) for k, kind in enumerate((np.uint64, np.uint32, np.uint32)))
        order = np.argsort(index, kind="stable")
        tokens, index, often = tokens[order], index[order], often[order].astype(np.int64)
        cuts = np.searchsorted(index, np.arange(int(docs[:, 4].max()) + 2)).tolist()
        rows: list[tuple] = []
        for doc, null, own_id, n, i in docs.tolist():
            row = (None if null else doc, own_id if n else None, n, flush << _INDEX | i if i >= 0 else None)
            a, b = (cuts[i], cuts[i + 1]) if i >= 0 else (0, 0)
            if a == b or 100 * (b - a) < threshold * n:
                rows.append((*row, None, None, None))
                continue
            own, count = tokens[a:b], often[a:b]
            least = prefix_size(n, threshold) - (n - (b - a))
            rare = np.lexsort((own, count))[: max(least, 0)]
            rows.append((*row, float(count.sum()) / n, np.sort(own).tobytes(), own[rare].view(np.int64)))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("doc_id", "set_id", "n", "node", "score", "tokens", "prefix"), columns, kinds, strict=True)})

    return answers.groupBy("flush").applyInArrow(collect, "doc_id long, set_id long, n long, node long, score double, tokens binary, prefix array<long>")


def _leaders(postings: DataFrame, threshold: int) -> DataFrame:
    """(a, b): each set and the leader that most of its prefix tokens name: the most shared set of a token whose size allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, leaders = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for t, node, n in zip(*(batch.column(c).to_pylist() for c in ("token", "node", "n")), strict=True):
                if t != token:
                    token, leaders = t, []
                for leader, m in leaders:
                    if 100 * min(n, m) >= threshold * max(n, m):
                        out.append((node, leader))
                        break
                else:
                    # No leader of a size near: at most one for each step of sizes.
                    leaders.append((node, n))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = postings.repartition("token").sortWithinPartitions("token", F.desc("score"), "node")
    counted = dealt.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("times"))
    return counted.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def _verified(stars: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                keep.append(bool(similar(_overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), n, m, threshold)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    a_side = sets.select(F.col("node").alias("a"), "n", F.col("tokens").alias("x"))
    b_side = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    return stars.join(b_side, "b").join(a_side, "a").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _met(asked: DataFrame, members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of sets (node, group) with members of the groups that they ask, block by block of the groups' matrix.

    ``members`` has node, group and part; a part's own sets are linked already, and one link to each other part will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for group, block, asks, node, part, n, data in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "asks", "node", "part", "n", "tokens")), strict=True):
                if (group, block) != key:
                    key, held, index = (group, block), [], None
                tokens = np.frombuffer(data, np.uint64)
                if not asks:
                    held.append((node, part, n, tokens))
                elif held:
                    if index is None:
                        nodes, parts, sizes = (np.array([h[k] for h in held], np.int64) for k in range(3))
                        flat, own = np.concatenate([h[3] for h in held]), np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
                        order = np.argsort(flat, kind="stable")
                        flat, own = flat[order], own[order]
                        first = np.flatnonzero(np.concatenate(([True], np.diff(flat) != 0)))
                        index = (flat[first], first, np.append(first[1:], len(flat)), own, nodes, parts, sizes)
                    union, low, high, own, nodes, parts, sizes = index
                    at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                    at = at[union[at] == tokens]
                    # J >= t needs an overlap of t / (1 + t) of both sizes' sum at least.
                    if len(at) * (100 + threshold) < threshold * (n + int(sizes.min())):
                        continue
                    size = (high - low)[at]
                    spots = np.arange(size.sum()) + np.repeat(low[at] - (np.cumsum(size) - size), size)
                    both = np.bincount(own[spots], minlength=len(sizes))
                    found = np.flatnonzero(similar(both, n, sizes, threshold) & (parts != part))
                    _, one = np.unique(parts[found], return_index=True)
                    out += [(node, x) for x in nodes[found[one]].tolist()]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    wanted = asked.select("group").distinct()
    size = members.join(wanted, "group").groupBy("group").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    held = members.join(size, "group").select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "node", "part")
    asks = asked.join(size, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "node", "part")
    rows = held.union(asks).join(sets.select("node", "n", "tokens"), "node")
    dealt = rows.repartition("group", "block").sortWithinPartitions("group", "block", "asks", "node")
    return dealt.select("group", "block", "asks", "node", "part", "n", "tokens").mapInArrow(run, "a long, b long")


def _asked(postings: DataFrame, members: DataFrame) -> DataFrame:
    """(node, part, group): sets and the groups in which a set of another part shares a prefix token.

    Within a group, sets of its largest part need not ask, for the others do. Of two
    groups, the sets of the smaller one ask the larger; of equal ones, those of the later.
    """
    sizes = members.groupBy("group", "part").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("size"), F.max_by("part", F.struct("n", -F.col("part"))).alias("main"))
    placed = postings.select("token", "node").join(members, "node")
    mixed = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token")
    left = placed.join(mixed, "token").join(groups, "group")
    there = left.groupBy("token", F.col("group").alias("other")).agg(F.min("part").alias("low"), F.max("part").alias("high"), F.first("size").alias("other_size"))
    # Where a token is in one group alone, its largest part's sets have nothing to ask.
    alone = there.groupBy("token").agg(F.count("*").alias("groups"))
    asking = left.join(alone, "token").where((F.col("groups") > 1) | (F.col("part") != F.col("main")))
    larger = F.struct(F.col("other_size"), -F.col("other")) > F.struct(F.col("size"), -F.col("group"))
    own = (F.col("other") == F.col("group")) & (F.col("part") != F.col("main")) & ((F.col("low") != F.col("part")) | (F.col("high") != F.col("part")))
    met = asking.join(there, "token").where(own | ((F.col("other") != F.col("group")) & larger))
    return met.select("node", "part", F.col("other").alias("group")).distinct()


def _buckets(docs: DataFrame) -> int:
    """A power of two: as many as keep a bucket's tokens bounded when the input grows, and every task busy."""
    tokens = (docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // 6
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(30, max(4, (tasks - 1).bit_length(), (tokens // BUCKET).bit_length()))


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each document."""
    buckets = _buckets(docs)
    stored = written(_candidates(_answered(_sent(id_text(docs), buckets)), threshold), "candidates")
    rows = stored.select("doc_id", "set_id", "n", "node")
    # Equal sets of different flushes are one: the smallest node stands for them.
    nodes = rows.where("set_id is not null").groupBy("set_id").agg(F.min("node").alias("node"), F.min("doc_id").alias("first"))
    sets = stored.where("tokens is not null").select("node", "n", "tokens")
    chosen = stored.where("tokens is not null").select("node", "n", "score", "prefix").join(nodes.select("node"), "node", "left_semi")
    postings = chosen.select("node", "n", "score", F.explode("prefix").alias("token"))

    stars = written(_leaders(postings, threshold), "stars")
    edges = written(_verified(stars, sets, threshold), "links")
    groups = components(edges)

    # A group holds what its leaders gathered, linked or not; its parts are linked.
    gathered = components(stars).withColumnRenamed("component", "group")
    members = chosen.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    members = written(members.join(gathered, "node", "left").select("node", "part", F.coalesce("group", "node").alias("group")), "members")
    more = written(_met(written(_asked(postings, members), "asked"), members, sets, threshold), "links")
    final = components(edges.union(more))

    placed = nodes.join(final, "node", "left").select("set_id", "first", F.coalesce("component", "node").alias("part"))
    least = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    by_set = placed.join(least, "part").select(F.col("set_id").alias("found"), "component_id")
    out = rows.join(by_set, F.col("set_id") == F.col("found"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component; rows that share a doc_id, or have none, stay together."""
    kept = jaccard_components(docs, threshold).where("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")
