"""N-gram Jaccard join: T-occurrence search with DivideSkip, and the components of its links.

A document's set holds its different shingles of `shingle` words as 64-bit hashes; documents with equal sets are one node. Two
sets with 100 * common >= percent * union share at least T = ceil(percent / 100 * n) of the n shingles of either, so they meet in
S = shared_lists(percent) inverted lists of the n - T + S rarest; a document that meets others in fewer lists has no link. Rarity
comes from a count of all shingles in counters(bytes of text) buckets, which bounds every list's length from above; its order is
the same everywhere, which is all that exactness needs. The counters grow with the text, so that about as many shingles share
one at any size, up to MOST_COUNTERS (some 30 GB of text): each is one byte by then, a step of the count's logarithm, so a
worker holds 64 MB at most. Beyond that size counters fill up and only a shingle's excess over the others' mean tells it apart:
results stay right, lists grow longer. The rare (short) lists are spread over the cluster, and lists of one document vanish.

Lists with the same smallest node make one group. First each node is searched in one of its groups; groups are cut into
blocks of about BLOCK nodes and BLOCK_SHINGLES shingles. In a block the T-occurrence search runs on the block's own lists:
the short ones are merged by a heap that skips what can't reach T - L any more, and what reaches it is probed in the L long
ones by binary search. Links give components. Then only groups that still hold several components are left; in those every
node outside the group's largest component is searched among all its nodes, block by block. Pairs are never emitted: a block
yields a spanning forest of its links. So copies cost time in proportion to their number, and no link between different
components is lost. What grows faster is a group of many nodes that share rare shingles but don't link.

Null texts, and texts without words, have no shingles and no links (component: their own id); fewer than `shingle` words make
one shingle; very long texts are whole; repeated rows are equal sets; null ids take part in links but never are a component's
id, unless all of its ids are null; an empty table gives an empty result. Other columns are ignored. Nodes are known by 128
bits of hash: 64 are a node's name, and of nodes whose names agree while the other 64 bits differ all but one get new names.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Forest, HashedWords, Scratch, batch_of, components, groups_of, mix, need, odd_numbers, rows_of, slices, text_key, texts, trimmed

#: Words of a shingle and least similarity, where a caller names no others.
SHINGLE, PERCENT = 4, 85
#: Bytes of text for each counter, the fewest and the most counters; counters are summed in chunks, from FLUSH shingles at a time.
COUNTER_BYTES, LEAST_COUNTERS, MOST_COUNTERS = 384, 1 << 12, 1 << 26
CHUNK, FLUSH = 1 << 16, 1 << 22
#: Steps of a counter's byte for each doubling of its count.
STEPS = 7
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Blocks to which one row sends a set, and bytes of sets in one Arrow batch.
SENT, SENT_BYTES = 1 << 12, 32 << 20
#: Nodes of equal names that are renamed; at n documents about n**2 / 2**65 are expected.
MOST_RENAMED = 100_000
#: Shingles that linked sets share at least in their rare parts, where sets that differ can't share fewer altogether.
SHARED = 6
#: Lists that can't be longer than this by the sketch are found with a window over the list; longer ones by partial sums.
SHORT_LIST = 20_000

@functools.cache
def factors(shingle: int) -> np.ndarray:
    return odd_numbers(shingle, 31)


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different shingle hashes of one whole text."""
    wh = HashedWords(raw, lower=True).hashes
    if not len(wh):
        return wh
    k, c = min(shingle, len(wh)), factors(shingle)
    h = np.full(len(wh) - k + 1, k, U64)
    for i in range(k):
        h += wh[i : i + len(h)] * c[i]
    return np.unique(mix(h))


def node_of(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two 64-bit hashes of a set, independent of order; the first, of which so many bits are used, is its name."""
    sums = np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)], U64)
    name, other = mix(sums + U64(len(s))).view(np.int64).tolist()
    return name >> 64 - bits, other


def shared_lists(percent: int) -> int:
    """At most SHARED; sets that differ and link have a union above their common part, so 100 c >= percent (c + 1)."""
    return min(SHARED, -(-percent // (100 - percent))) if percent < 100 else SHARED


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Linked sets that differ share shared_lists(percent) of so many of either's rarest shingles."""
    least = (percent * n + 99) // 100
    return n - least + min(shared_lists(percent), least)


def counters(size: int) -> int:
    """How many counters a corpus of so many bytes of text has: a power of two."""
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (size // COUNTER_BYTES).bit_length()))


def steps(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that rise with them: 0 for none and for one, then STEPS for each doubling."""
    return np.minimum(STEPS * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


def sets_of(docs: DataFrame, count: int, shingle: int = SHINGLE, bits: int = 64) -> DataFrame:
    """Per document (doc_id, k1, k2, n, node, other: see node_of), node null without shingles; and, in rows of their own,
    chunk, places and counts of the `count` counters that a task has gathered."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("chunk", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    chunk, flush = min(CHUNK, count), FLUSH

    def gathered(found: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([np.zeros(0, np.uint32), *found])
        found.clear()
        every.sort()  # in place: np.unique takes several times the memory
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        at, times = every[first], np.diff(first, append=len(every))
        del every, first
        edges = np.flatnonzero(np.diff(at // chunk, prepend=-1, append=-1)) if len(at) else np.zeros(1, np.int64)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        none = pa.nulls(len(spans), pa.int64())
        places, times = (at % chunk).astype("<u2"), times.astype("<u4")
        return batch_of(schema, [none, none, none, none, none, none, [int(at[i]) // chunk for i, _ in spans], [places[i:j].tobytes() for i, j in spans], [times[i:j].tobytes() for i, j in spans]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            n, nodes = [], []
            for raw in texts(b, "text"):
                s = shingles(raw, shingle)
                n.append(len(s))
                nodes.append(node_of(s, bits) if len(s) else (None, None))
                found.append((s & U64(count - 1)).astype(np.uint32))
                held += len(s)
                if held >= flush:
                    yield gathered(found)
                    found, held = [], 0
            empty = pa.nulls(len(n), pa.binary())
            yield batch_of(schema, [b.column("doc_id"), b.column("k1"), b.column("k2"), n, [x for x, _ in nodes], [y for _, y in nodes], pa.nulls(len(n), pa.int32()), empty, empty])
        yield gathered(found)

    return docs.mapInArrow(trimmed(run), "doc_id long, k1 long, k2 long, n long, node long, other long, chunk int, places binary, counts binary")


def sketch_of(sets: DataFrame, count: int) -> np.ndarray:
    """The whole corpus's counters as bytes (see steps): partial sums in groups of tasks, then one row for each chunk. At most
    MOST_COUNTERS bytes come to the driver, whatever the corpus."""
    size = min(CHUNK, count)

    def add(batches: Iterable[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        for (chunk, _), rows in itertools.groupby(rows_of(batches, ["chunk", "part", "places", "counts"]), key=lambda r: r[:2]):
            total = np.zeros(size, np.int64)
            for *_, places, counts in rows:  # one after the other: a corpus has many tasks
                total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<u4")
            place = np.flatnonzero(total)
            told = steps(total) if last else np.minimum(total[place], (1 << 32) - 1).astype("<u4")
            yield batch_of(schema, [[chunk], [b"" if last else place.astype("<u2").tobytes()], [told.tobytes()]])

    schema = pa.schema([("chunk", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    parts = sets.where("chunk is not null").select("chunk", "places", "counts")
    for groups in (64, 1):
        part = F.pmod(F.xxhash64("places"), F.lit(groups)).alias("part")
        parts = parts.select("chunk", part, "places", "counts").repartition("chunk", "part").sortWithinPartitions("chunk", "part")
        parts = parts.mapInArrow(trimmed(lambda b, last=groups == 1: add(b, last)), "chunk int, places binary, counts binary")
    out = np.zeros((count // size, size), np.uint8)
    for r in parts.collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def renamed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """New names of nodes whose name another node has too."""
    twice = rows.where("node is not null").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").select("node", F.col("x").alias("first"))
    found = rows.join(twice, "node").where("other <> first").select("node", "other").distinct().limit(MOST_RENAMED + 1).collect()
    if len(found) > MOST_RENAMED:
        raise ValueError(f"more than {MOST_RENAMED} different sets share 64-bit hashes")
    return {(r["node"], r["other"]): int(mix(np.array([r["node"], r["other"]], np.int64).view(U64)).sum(dtype=U64).view(np.int64)) for r in found}


def postings(docs: DataFrame, sketch: np.ndarray, names: dict[tuple[int, int], int], shingle: int = SHINGLE, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """(token, node, n, long) of each document's prefix_length rarest shingles; n is its set's size, and the list can be
    longer than SHORT_LIST only if long."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("long", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast((sketch, names))  # MOST_COUNTERS bytes and MOST_RENAMED names at most
    long_from = steps(np.array([SHORT_LIST]))[0]  # what has fewer steps has a shorter list

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = shared.value
        for b in batches:
            raw = texts(b, "text")
            for i, j in slices(map(len, raw)):
                parts: list[list] = [[], [], [], []]
                for r in range(i, j):
                    if len(s := shingles(raw[r], shingle)):
                        size = counts[(s & U64(len(counts) - 1)).astype(np.int64)]
                        at = np.lexsort((s, size))[: prefix_length(len(s), percent)]
                        name = node_of(s, bits)
                        for p, v in zip(parts, (s[at], np.full(len(at), names.get(name, name[0])), np.full(len(at), len(s), np.int32), size[at] >= long_from), strict=True):
                            p.append(v)
                if parts[0]:
                    token, node, n, long = map(np.concatenate, parts)
                    yield batch_of(schema, [token.view(np.int64), node, n, long])

    return need(docs, "text").mapInArrow(trimmed(run), "token long, node long, n int, long boolean")


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, times) of those that stand in `least` of the sorted lists or more, by a heap of the lists' heads.

    What is popped fewer times than that is passed over: the heads of `least` - 1 lists go together, and their lists skip to
    the next head, as nothing before it can be in enough lists.
    """
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield value, len(popped)
            for k in popped:
                at[k] += 1
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            for k in popped:
                at[k] = bisect.bisect_left(lists[k], heap[0][0], at[k])
        for k in popped:
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def search(sets: list[np.ndarray], queries: list[int], members: list[int], group: list[int], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of queries with members, on top of group (equal numbers are connected already).

    T-occurrence over the members' inverted lists: for a query of n shingles, T = ceil(percent / 100 * n); its L longest
    lists are put aside, the others merged, and members met T - L times or more are looked up in the long lists.
    """
    first, forest = {}, Forest(len(sets))
    for i, g in enumerate(group):
        forest.join(i, first.setdefault(g, i))
    apart = len(first)
    sizes = np.array([len(sets[i]) for i in members])
    every, token = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
    lists, bounds = np.repeat(np.arange(len(members)), sizes)[np.argsort(token, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(every)))])
    for q in queries:
        if apart == 1:
            return
        n = len(sets[q])
        least = (percent * n + 99) // 100
        own = np.searchsorted(every, sets[q])
        own = own[every[np.minimum(own, len(every) - 1)] == sets[q]]
        if len(own) < least:
            continue
        length = bounds[own + 1] - bounds[own]
        own = own[np.argsort(length, kind="stable")]
        put = min(least - 1, int(least / (0.01 * np.log2(max(2, int(length.max()))) + 1)))
        short, long = own[: len(own) - put], own[len(own) - put :]
        met = list(merge_skip([lists[a:b].tolist() for a, b in zip(bounds[short].tolist(), bounds[short + 1].tolist(), strict=True)], least - put))
        root = forest.find(q)
        met = [(i, c) for i, c in met if forest.find(members[i]) != root]
        found, count = (np.array([x[k] for x in met], np.int64) for k in (0, 1))
        alike = 100 * np.minimum(sizes[found], n) >= percent * np.maximum(sizes[found], n)
        found, count = found[alike], count[alike]
        for done, t in enumerate(long, 1):
            if not len(found):
                break
            run = lists[bounds[t] : bounds[t + 1]]
            count += run[np.minimum(np.searchsorted(run, found), len(run) - 1)] == found
            if done % 16 == 0:  # what can't reach T any more
                alive = count + (put - done) >= least
                found, count = found[alive], count[alive]
        for i, c in zip(found.tolist(), count.tolist(), strict=True):
            if 100 * c >= percent * (n + int(sizes[i]) - c) and forest.join(q, members[i]):
                apart -= 1
                yield q, members[i]


def search_blocks(met: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) within blocks. met: (g, block, node, set, comp, query, member): queries are searched among members."""
    names = ["g", "block", "node", "set", "comp", "query", "member"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches, 2, names):
            if len({r[4] for r in rows}) < 2:
                continue
            seen: dict[int, list] = {}
            for _, _, node, packed, comp, query, member in rows:
                x = seen.setdefault(node, [packed, comp, False, False])
                x[2] |= query
                x[3] |= member
            nodes = list(seen)
            which = [[i for i, x in enumerate(nodes) if seen[x][k]] for k in (2, 3)]
            edges = list(search([np.frombuffer(seen[x][0], U64) for x in nodes], *which, [seen[x][1] for x in nodes], percent)) if all(which) else []
            if edges:
                yield batch_of(schema, [[nodes[i] for i, _ in edges], [nodes[j] for _, j in edges]])

    return met.select(*names).repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(trimmed(run), "a long, b long")


def routed(docs: DataFrame, firsts: DataFrame, places: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(g, block, node, comp, query, member, set): the set of each node in places, sent where it is to be searched.

    firsts (node, id, k1, k2) names one document of each node, so that a text that many documents share is sent once.
    """
    part = F.floor(F.col("block") / SENT).alias("part")
    to = places.groupBy("node", part).agg(F.collect_list(F.struct("g", "block", "comp", "query", "member")).alias("places"))  # SENT for each of a node's lists
    to = to.join(firsts, "node").select("id", "k1", "k2", "node", "places")
    kinds = [("g", pa.int64()), ("block", pa.int64()), ("comp", pa.int64()), ("query", pa.bool_()), ("member", pa.bool_())]
    schema = pa.schema([*kinds, ("node", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, nodes, where = texts(b, "text"), b.column("node"), b.column("places").to_pylist()
            for i, j in slices(map(len, raw)):
                packed = [shingles(x, shingle).tobytes() for x in raw[i:j]]
                sent = [(r, p) for r, w in enumerate(where[i:j]) for p in w]
                for x, y in slices((len(packed[r]) for r, _ in sent), SENT_BYTES):
                    row = pa.array([r for r, _ in sent[x:y]], pa.int64())
                    yield batch_of(schema, [*([p[k] for _, p in sent[x:y]] for k, _ in kinds), nodes[i:j].take(row), pa.array(packed, pa.large_binary()).take(row).cast(pa.binary())])

    joined = docs.withColumn("id", id_key()).join(to.hint("shuffle_hash"), ["id", "k1", "k2"]).select("text", "node", "places")
    return joined.mapInArrow(trimmed(run), "g long, block long, comp long, query boolean, member boolean, node long, set binary")


def id_key() -> Column:
    """doc_id as a join key: null becomes the smallest long."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def parts(nodes: str, shingles: str, times: int = 1) -> Column:
    """Into how many blocks a group of so many nodes with so many shingles is cut."""
    return F.ceil(F.greatest(F.col(nodes) / (times * BLOCK), F.col(shingles) / (times * BLOCK_SHINGLES))).cast("int")


def part_of(c: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), c).cast("int")


def each(c: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), c - 1))


def join_components(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """Per document: doc_id, k1, k2 (text key), n_shingles, component_id, and comp, the component itself whatever its ids (null
    without shingles). bits: of a node's name, fewer only to see that equal names do no harm."""
    k1, k2 = text_key(F.col("text"))
    keyed = need(docs, "doc_id", "text").select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    size = keyed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if not size["rows"]:
        return docs.sparkSession.createDataFrame([], "doc_id long, k1 long, k2 long, n_shingles long, component_id long, comp long")
    count = counters(size["bytes"])
    sets = scratch.keep(sets_of(keyed, count, shingle, bits), "sets")
    sketch = sketch_of(sets, count)
    rows = sets.where("chunk is null").select("doc_id", "k1", "k2", "n", "node", "other")
    if names := renamed(rows):
        new = docs.sparkSession.createDataFrame([(*k, v) for k, v in names.items()], "node long, other long, new long")
        rows = rows.join(new, ["node", "other"], "left").withColumn("node", F.coalesce("new", "node"))
    rows = rows.select("doc_id", "k1", "k2", "n", "node")

    posted = scratch.keep(postings(keyed, sketch, names, shingle, percent, bits), "posted")
    # Sets of a list that differ too much in size can't link: the list, ordered by size, is cut where the next is too large.
    rising = Window.partitionBy("token").orderBy("n", "node")
    cut = F.coalesce(100 * F.lag("n").over(rising) < percent * F.col("n"), F.lit(False)).cast("int")
    short = posted.where("not long").select("token", "node", "n").withColumn("cut", cut).withColumn("run", F.sum("cut").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    over = Window.partitionBy("token", "run")
    short = short.select("node", "n", F.min("node").over(over).alias("low"), F.max("node").over(over).alias("high"), "token").where("low <> high").select("token", "node", "n", "low")
    long = posted.where("long").select("token", "node", "n")
    ends = long.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token", "low")
    ends = scratch.keep(ends, "long")  # joins of two written tables can split hot keys
    shared = scratch.keep(short.union(long.join(ends, "token").select("token", "node", "n", "low")), "shared")
    often = scratch.keep(shared.select("token", "node").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= shared_lists(percent)).select("node"), "often")
    # Lists with the same smallest node make one group: its nodes meet once, not once for each list they share.
    lists = scratch.keep(shared.select(F.col("low").alias("g"), "node", "n").distinct().join(often, "node"), "lists")
    firsts = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(id_key().alias("id"), "k1", "k2")).alias("k")).join(often, "node").select("node", "k.*")
    firsts = scratch.keep(firsts, "firsts")
    scratch.drop("shared", "posted")

    low = scratch.keep(lists.groupBy("node", "n").agg(F.min("g").alias("g")), "low")
    groups = scratch.keep(low.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")), "groups")
    blocked = low.join(groups, "g").select("g", part_of(parts("m", "w")).alias("block"), "node")
    heads = groups.select("g", each(parts("m", "w")).alias("block"), F.col("g").alias("node"))
    places = blocked.union(heads).select("g", F.col("block").cast("long"), "node", F.col("node").alias("comp"), F.lit(True).alias("query"), F.lit(True).alias("member"))
    edges = scratch.keep(search_blocks(routed(keyed, firsts, places, shingle), percent), "edges-1")
    scratch.drop()
    comps = components(edges, scratch, "cc-1")

    held = lists.join(comps, "node", "left").select("g", "node", "n", F.coalesce("root", "node").alias("comp"))
    held = scratch.keep(held, "held")
    mixed = held.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("t")).where("x <> y")
    mixed = scratch.keep(mixed.groupBy("m", "w", "s", "t").agg(F.min("g").alias("g")).select("g", "m", "w"), "mixed")  # groups of the same nodes once
    sizes = held.join(mixed, "g").groupBy("g", "comp", "m", "w").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("sum"))
    largest = sizes.groupBy("g", "m", "w").agg(F.max(F.struct("size", "sum", "comp")).alias("top"))
    largest = largest.select("g", "m", "w", F.col("top.comp").alias("main"), (F.col("m") - F.col("top.size")).alias("u"), (F.col("w") - F.col("top.sum")).alias("v"))
    largest = scratch.keep(largest, "largest")
    inside = held.join(largest, "g").withColumns({"mb": parts("m", "w"), "ub": parts("u", "v", 4)})
    members = inside.select("g", "node", "comp", "ub", part_of(F.col("mb")).alias("b"), each(F.col("ub")).alias("k")).withColumns({"query": F.lit(False), "member": F.lit(True)})
    asking = inside.where("comp <> main").select("g", "node", "comp", "ub", each(F.col("mb")).alias("b"), part_of(F.col("ub"), 1).alias("k")).withColumns({"query": F.lit(True), "member": F.lit(False)})
    places = members.union(asking).select("g", (F.col("b").cast("long") * F.col("ub") + F.col("k")).alias("block"), "node", "comp", "query", "member")
    more = scratch.keep(search_blocks(routed(keyed, firsts, places, shingle), percent), "edges-2")
    scratch.drop("low", "held", "mixed", "largest", "groups", "lists", "often")
    if not more.isEmpty():
        comps = components(edges.union(more), scratch, "cc-2")

    named = rows.join(comps, "node", "left").select("doc_id", "k1", "k2", "n", "node", F.coalesce("root", "node").alias("comp"))
    named = scratch.keep(named, "named")
    ids = scratch.keep(named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "ids")
    return named.join(ids, "comp", "left").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "comp")
