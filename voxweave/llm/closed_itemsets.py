"""Frequent baskets: closed itemsets and their rules, from prefix trees with pre-order and post-order codes.

Items are ordered by falling support (ties: by number), so each itemset has a last item, its rarest. A suffix class holds the itemsets
with one last item x: its transactions are, for each basket with x, the items before x that are frequent together with x, and equal
ones are one row with a count before any class is formed. A class is a task of its own: its rows make a prefix tree whose nodes get
pre-order and post-order numbers; an item's N-list is its nodes' numbers and counts, and merging two lists in one pass gives the list and
the support of the larger set. The search adds items from the rarest on, takes in at once what is in all baskets of a set, and
leaves a branch whose set some found set with the same support contains: so it finds the sets that are closed among the items up to x.

Two facts make the rest joins on equal keys. A set P that is closed up to its last item but not at all is the beginning, in the order of items,
of a found set with equal support; and all beginnings of a found set are found sets. So P goes if a found set has
P and one more item behind it with P's support, and a set without its last item, which lies in another class, is looked up by key.

Pairs of items are counted before classes are formed. Baskets of very many frequent items would make a square of pairs: the few largest ones
(fewer than half the least support) are set apart, pairs are counted in the others down to the least support less their number, and only those pairs
are looked up in the large ones. A class of more than `most_rows` different rows is dealt by its sets' last item but one
as well. Nothing that grows with the input goes to the driver, to one task or into a broadcast: the driver sees the number
of baskets and their sizes by powers of two, a task a tree of different transactions of one item or pair.

Rows with a null basket or item don't count, nor do repeated ones; baskets of one item count; an empty table gives an empty result; other columns
are ignored. Items and baskets are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, groups_of

LEAST, PER, CONFIDENCE = 5, 20_000, 60
#: Baskets of fewer items than 2 ** this are never set apart; different rows of one class.
SMALL_BITS, MOST_ROWS = 5, 200_000

NList = list[tuple[int, int, int]]


def merged(above: NList, below: NList) -> NList:
    """The nodes of `above` that have nodes of `below` in their subtrees, with the sums of those nodes' counts; one pass over both."""
    out: NList = []
    i, last, many = 0, -1, len(above)
    for pre, post, count in below:
        while i < many and above[i][1] < post:
            i += 1
        if i == many:
            break
        a, b, _ = above[i]
        if a < pre:
            if last == i:
                out[-1] = (a, b, out[-1][2] + count)
            else:
                out.append((a, b, count))
                last = i
    return out


def total(nodes: NList) -> int:
    return sum(n[2] for n in nodes)


def n_lists(rows: Iterable[tuple[tuple[int, ...], int]]) -> dict[int, NList]:
    """The N-list of every item of a prefix tree over rows of ascending items with counts."""
    root: dict = {}
    for row, count in rows:
        at = root
        for item in row:
            node = at.get(item)
            if node is None:
                node = at[item] = [0, {}]
            node[0] += count
            at = node[1]
    out: dict[int, NList] = {}
    pre = post = 0
    stack = [(None, 0, 0, iter(root.items()))]
    while stack:
        item, begin, count, children = stack[-1]
        for child, (n, below) in children:
            pre += 1
            stack.append((child, pre, n, iter(below.items())))
            break
        else:
            stack.pop()
            if item is not None:
                out.setdefault(item, []).append((begin, post, count))
                post += 1
    for nodes in out.values():
        nodes.sort()
    return out


class Class:
    """One suffix class: rows of items before the last one, as numbers in the order of items, with counts.

    support: of the suffix. second: the number of the last item but one, where the class is only of sets with it, which all rows
    then contain; else None.
    """

    def __init__(self, rows: Iterable[tuple[tuple[int, ...], int]], support: int, least: int, second: int | None = None):
        self.support, self.least, self.second = support, least, second
        rows, count = list(rows), {}
        for row, n in rows:
            for item in row:
                count[item] = count.get(item, 0) + n
        keep = {i for i, n in count.items() if n >= least and i != second}
        self.lists = n_lists((tuple(i for i in row if i in keep), n) for row, n in rows)
        self.between = [i for i in self.lists if second is not None and i > second]

    def support_of(self, items: list[int]) -> int:
        """Of ascending items together with the suffix."""
        if not items:
            return self.support
        nodes = self.lists.get(items[-1], [])
        for i in reversed(items[:-1]):
            nodes = merged(self.lists.get(i, []), nodes)
        return total(nodes)

    def closed(self) -> Iterator[tuple[list[int], int]]:
        """(items without the suffix, support) of all sets closed among the items up to the suffix; the suffix alone only with `second`."""
        found: dict[int, list[frozenset]] = {}
        # Of a level: the set so far, what is in all its baskets besides, its support, and (item, N-list) still to add, rarest last.
        first = [(i, self.lists[i]) for i in sorted(self.lists) if self.second is None or i < self.second]
        levels = [self._level((), frozenset(), self.support, first)]
        if self.second is not None and (own := self._own(levels[0], found)) is not None:
            yield own
        elif levels[0][1]:  # the suffix is never without these
            if self.second is None:
                yield sorted(levels[0][1]), self.support
                found.setdefault(self.support, []).append(levels[0][1])
        while levels:
            chain, besides, _, open_ = levels[-1]
            if not open_:
                levels.pop()
                continue
            item, nodes = open_.pop()
            support = total(nodes)
            level = self._level((*chain, item), besides, support, [(i, x) for i, other in open_ if total(x := merged(other, nodes)) >= self.least])
            if (own := self._own(level, found)) is not None:
                yield own
                levels.append(level)

    @staticmethod
    def _level(chain: tuple, besides: frozenset, support: int, more: list[tuple[int, NList]]) -> tuple:
        always = {i for i, x in more if total(x) == support}
        return chain, besides | always, support, [(i, x) for i, x in more if i not in always]

    def _own(self, level: tuple, found: dict[int, list[frozenset]]) -> tuple[list[int], int] | None:
        """The level's set, unless one with equal support contains it."""
        chain, besides, support, _ = level
        mine = besides.union(chain)
        if any(mine <= x for x in found.get(support, ())):
            return None
        items = sorted(mine)
        if any(self.support_of([*items, b]) == support for b in self.between):
            return None
        found.setdefault(support, []).append(mine)
        return items, support


_SET = "items array<long>, counts array<long>, support long, rests array<long>"


def mined(classes: DataFrame, least: int) -> DataFrame:
    """classes (x, xk, y, support, row, n; sorted by x and y in each partition): the sets closed up to their last items, with their items' supports
    and those of the set without each of its items (null: the last one, and `y`)."""
    schema = pa.schema([(c, pa.list_(pa.int64()) if c != "support" else pa.int64()) for c in ("items", "counts", "support", "rests")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x, y), rows in groups_of(batches, 2, ["x", "y", "xk", "support", "row", "n"]):
            order = sorted({(e["k"], e["item"]) for r in rows for e in r[4]})
            number = {e[1]: k for k, e in enumerate(order)}
            mine = Class((([number[e["item"]] for e in r[4]], r[5]) for r in rows), rows[0][3], least, None if y is None else number[y])
            out: list[list] = [[], [], [], []]
            for own, support in mine.closed():
                rests = [mine.support_of(own[:k] + own[k + 1 :]) for k in range(len(own))]
                if y is not None:
                    own, rests = [*own, number[y]], [*rests, None]
                out[0].append([*(order[k][1] for k in own), x])
                out[1].append([*(-order[k][0] for k in own), -rows[0][2]])
                out[2].append(support)
                out[3].append([*rests, None])
            if out[0]:
                yield batch_of(schema, out)

    return classes.mapInArrow(run, _SET)


def _pairs(b: Column) -> Column:
    """(x, y) of each two items of an ordered array, y before x."""
    return F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.transform(F.slice(b, F.lit(1), i), lambda y: F.struct(b[i].alias("x"), y.alias("y"))))))


def closed_itemsets(lines: DataFrame, scratch: Scratch, basket: str, item: str, least: int = LEAST, per: int = PER, confidence: int = CONFIDENCE, most_rows: int = MOST_ROWS) -> DataFrame:
    """items (array, ascending), support, rules (array of item, without, alone, by item) of every closed itemset that at least `least` baskets
    hold, and one in `per`. A rule concludes `item` from the others: `without` is their support, `alone` that of item; support is
    confidence % of `without` at least, and more than it would be if both were independent. baskets: the number of all."""
    whole = ("bigint", "int", "smallint", "tinyint", "void")
    if bad := [c for c in (basket, item) if dict(lines.dtypes)[c] not in whole]:
        raise ValueError(f"{', '.join(bad)} must hold whole numbers")
    rows = lines.select(F.col(basket).cast("long").alias("b"), F.col(item).cast("long").alias("item")).where("b is not null and item is not null")
    baskets = rows.select("b").distinct().count()
    least = max(least, -(-baskets // per))
    # Repeated rows only make these counts too large.
    maybe = scratch.keep(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("item"), "maybe")
    held = scratch.keep(rows.join(maybe, "item").distinct(), "held")
    items = scratch.keep(held.groupBy("item").agg((-F.count(F.lit(1))).alias("k")).where(F.col("k") <= -least), "items")
    held = scratch.keep(held.join(items, "item").select("b", F.struct("k", "item").alias("e")), "ordered")
    sizes = held.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b", F.floor(F.log2("n") + 1e-9).cast("int").alias("bits"))
    sizes = scratch.keep(sizes, "sizes")
    by_bits, apart, bits = {r["bits"]: r["count"] for r in sizes.groupBy("bits").count().collect()}, 0, 64  # a row for each power of two
    while bits > SMALL_BITS and 2 * (apart + by_bits.get(bits - 1, 0)) < least:
        bits -= 1
        apart += by_bits.get(bits, 0)
    large = scratch.keep(sizes.where(F.col("bits") >= bits).select("b"), "large")
    small = held.join(large, "b", "left_anti") if apart else held
    small = scratch.keep(small.groupBy("b").agg(F.array_sort(F.collect_list("e")).alias("w")).where(F.size("w") > 1), "small")
    near = small.select(_pairs(F.col("w")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least - apart)
    pairs = near = scratch.keep(near.select("p.x", "p.y", "n"), "near")
    if apart:
        lists = scratch.keep(held.join(large, "b", "left_semi"), "lists")
        found = near.select("x", "y").join(lists.select("b", F.col("e").alias("x")), "x").join(lists.select("b", F.col("e").alias("y")), ["b", "y"])
        found = scratch.keep(found.select("b", "x", "y"), "found")
        pairs = near.union(found.groupBy("x", "y").agg(F.count(F.lit(1)))).groupBy("x", "y").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        pairs = scratch.keep(pairs, "pairs")
    both = small.select("b", _pairs(F.col("w")).alias("p")).select("b", "p.x", "p.y")
    both = (both.union(found) if apart else both).join(pairs.select("x", "y"), ["x", "y"])
    classes = both.groupBy("b", "x").agg(F.array_sort(F.collect_list("y")).alias("row")).groupBy("x", "row").agg(F.count(F.lit(1)).alias("n"))
    classes = scratch.keep(classes.select("x.item", "x.k", "row", "n"), "classes")
    scratch.drop("maybe", "ordered", "sizes", "small")
    wide = scratch.keep(classes.groupBy("item").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most_rows).select("item"), "wide")
    split = not wide.isEmpty()
    plain = classes.join(wide, "item", "left_anti") if split else classes
    plain = plain.select(F.col("item").alias("x"), F.lit(None).cast("long").alias("y"), F.col("k").alias("xk"), (-F.col("k")).alias("support"), "row", "n")
    if split:
        dealt = classes.join(wide, "item", "left_semi").select(F.col("item").alias("x"), F.col("k").alias("xk"), "row", "n", F.explode("row").alias("e"))
        dealt = dealt.join(pairs.select(F.col("x.item").alias("x"), F.col("y").alias("e"), F.col("n").alias("support")), ["x", "e"])
        plain = plain.union(dealt.select("x", "e.item", "xk", "support", "row", "n"))
    first = items.join(pairs.where("n = -x.k").select("x.item").distinct(), "item", "left_anti")  # no item before it is in all its baskets
    first = first.select(F.array("item").alias("items"), F.array(-F.col("k")).alias("counts"), (-F.col("k")).alias("support"), F.array(F.lit(None).cast("long")).alias("rests"))
    sets = scratch.keep(first.union(mined(plain.repartition("x", "y").sortWithinPartitions("x", "y"), least)), "sets")
    shorter = F.slice("items", 1, F.size("items") - 1)
    longer = sets.where(F.size("items") > 1).select(shorter.alias("items"), "support")
    out = sets.join(longer, ["items", "support"], "left_anti").withColumn("begin", shorter)
    out = out.join(sets.select(F.col("items").alias("begin"), F.col("support").alias("rest")), "begin", "left")
    rests = F.concat(F.slice("rests", 1, F.size("rests") - 1), F.array("rest"))
    if split:
        # Without its last item but one, a set is closed among the items before that one and the last: a beginning of a found set and its last item.
        keys = sets.where(F.size("items") > 1).join(wide, F.element_at("items", -1) == wide["item"], "left_semi")
        keys = keys.select("support", F.explode(F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda k: F.concat(F.slice("items", F.lit(1), k), F.slice("items", -1, 1)))).alias("key"))
        keys = keys.groupBy("key").agg(F.max("support").alias("other"))
        out = out.withColumn("key", F.when(F.size("items") > 1, F.concat(F.slice("items", 1, F.size("items") - 2), F.slice("items", -1, 1)))).join(keys, "key", "left")
        gap = F.when(F.size("items") == 2, F.element_at("counts", -1)).otherwise(F.col("other"))
        rests = F.concat(F.slice("rests", 1, F.greatest(F.lit(0), F.size("rests") - 2)), F.when(F.size("rests") > 1, F.array(F.coalesce(F.element_at("rests", -2), gap))).otherwise(F.array().cast("array<bigint>")), F.array("rest"))
    rules = F.filter(F.zip_with(F.zip_with("items", rests, lambda c, a: F.struct(c.alias("item"), a.alias("without"))), "counts", lambda r, s: F.struct(r["item"], r["without"], s.alias("alone"))), lambda r: r["without"].isNotNull() & (100 * F.col("support") >= confidence * r["without"]) & (F.col("support") * F.lit(baskets).cast("long") > r["without"] * r["alone"]))
    return out.select(F.array_sort("items").alias("items"), "support", F.array_sort(rules).alias("rules"), F.lit(baskets).cast("long").alias("baskets"))
