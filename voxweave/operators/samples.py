"""Training samples: messages, token arrays, packing, collation and balance."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def messages(*parts: tuple[str, Column]) -> Column:
    """role and content pairs as messages; only the assistant's count in the loss."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content"), F.lit(int(r == "assistant")).cast("long").alias("loss_mask")) for r, c in parts))


def normalize_messages(raw: Column) -> Column:
    """Roles default to user; a mask that isn't a number defaults to whether the assistant speaks; null entries go."""

    def one(m: Column) -> Column:
        role = F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("user"))
        mask = F.coalesce(m["loss_mask"].try_cast("long"), (role == "assistant").cast("long"))
        return F.struct(role.alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), mask.alias("loss_mask"))

    return F.transform(F.filter(raw, lambda m: m.isNotNull()), one)


#: Opening and closing text of each role (fixed values of the public chat formats); system text stands alone in llama2.
TEMPLATES: dict[str, Callable[[Column, Column], Column]] = {
    "chatml": lambda role, text: F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n")),
    "default": lambda role, text: F.concat(F.initcap(role), F.lit(": "), text, F.lit("\n")),
    "llama2": lambda role, text: F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(role == "system", F.concat(F.lit("<<SYS>>\n"), text, F.lit("\n<</SYS>>\n\n"))).otherwise(F.concat(text, F.lit("</s>"))),
    "janus": lambda role, text: F.when(role == "system", F.concat(text, F.lit("\n\n"))).otherwise(F.concat(F.lit("<|"), F.initcap(role), F.lit("|>: "), text, F.lit("\n\n"))),
}


def word_tokens(text: Column) -> Column:
    """Stand-in tokenizer: the lengths of words, as ids."""
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.length(w).cast("long"))


def token_chunks(rows: DataFrame, tokens: Column, size: int, end: int) -> DataFrame:
    """1 to N: tokens and the end id, cut into pieces of at most size; labels are the ids."""
    from ..functions.text import chunks

    return rows.select("*", F.posexplode(chunks(F.concat(tokens, F.array(F.lit(end).cast("long"))), size)).alias("chunk", "input_ids")).withColumn("labels", F.col("input_ids"))


def labelled_turns(turns: DataFrame, doc: str, ord: str, role: str, tokens: Column, most: int) -> DataFrame:
    """Per document ids and labels of all turns in order, the last `most` kept; only the assistant's tokens are labels."""
    part = F.struct(F.col(ord).alias("o"), tokens.alias("ids"), F.when(F.col(role) == "assistant", tokens).otherwise(F.transform(tokens, lambda _: F.lit(IGNORED).cast("long"))).alias("labels"))
    joined = turns.groupBy(doc).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    flat = joined.select(doc, F.flatten(F.transform("parts", lambda p: p["ids"])).alias("_ids"), F.flatten(F.transform("parts", lambda p: p["labels"])).alias("_labels"))
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - most + 1), F.lit(most))
    return flat.select(doc, tail("_ids").alias("input_ids"), tail("_labels").alias("labels"))


def classification(ids: Column, label: Column, most: int) -> tuple[Column, Column]:
    """The first `most` ids; all labels ignored but the last one."""
    head = F.slice(ids, 1, most)
    return head, F.transform(head, lambda _, i: F.when(i == F.size(head) - 1, label.cast("long")).otherwise(F.lit(IGNORED).cast("long")))


def next_fit(sizes: list[int], budget: int) -> list[int]:
    """Batch of each sample in order; a batch ends where the next sample doesn't fit. -1: over the budget, dropped."""
    out, batch, used = [], 0, 0
    for n in sizes:
        if n > budget:
            out.append(-1)
            continue
        if used + n > budget:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


def pack_sequential(rows: DataFrame, shard: str, order: str, size: str, budget: int) -> DataFrame:
    """Batches of neighbouring samples, none above the budget; samples over the budget go."""
    return _packed(rows, shard, order, size, lambda sizes: next_fit(sizes, budget))


def warmed_budget(step: Column, budget: int, warmup: int, first: int) -> Column:
    """Tokens of a batch: from `first` in equal steps to the budget over the warm-up, then the budget."""
    rising = F.floor((budget - first) * step / F.lit(max(1, warmup))) + first
    return F.when((F.lit(warmup) > 0) & (step <= warmup), rising).otherwise(budget).cast("long")


def first_fit(sizes: list[int], budget: int, buffer: int, force: bool) -> list[int]:
    """Batch of each sample (-1: dropped). A batch is taken once `buffer` samples or more with `budget` tokens or more
    wait, or at the end: in order of arrival all that fit; with force the first is taken whatever its size."""
    out, waiting, batch = [-1] * len(sizes), [], 0

    def take() -> None:
        nonlocal waiting, batch
        used, rest = 0, []
        for i in waiting:
            if used + sizes[i] <= budget or force and not used:
                out[i], used = batch, used + sizes[i]
            else:
                rest.append(i)
        waiting, batch = rest, batch + 1

    for i, n in enumerate(sizes):
        if n > budget and not force:
            continue
        waiting.append(i)
        while len(waiting) >= buffer and sum(sizes[k] for k in waiting) >= budget:
            take()
    while waiting:
        take()
    return out


def _packed(rows: DataFrame, shard: str, order: str, size: str, assign: Callable[[list[int]], list[int]]) -> DataFrame:
    """(shard, order, size, batch): only keys and sizes go through Python; shards bound what a task holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(batch=assign(pdf[size].tolist()))[[shard, order, size, "batch"]]

    packed = rows.select(F.col(shard).cast("long"), F.col(order).cast("long"), F.col(size).cast("long")).groupBy(shard).applyInPandas(run, f"{shard} long, {order} long, {size} long, batch long")
    return packed.where("batch >= 0")


def pack_first_fit(rows: DataFrame, shard: str, order: str, size: str, budget: int, buffer: int = 8, force: bool = False) -> DataFrame:
    """Order-dependent packing of each shard, as the token-budget loader packs."""
    return _packed(rows, shard, order, size, lambda sizes: first_fit(sizes, budget, buffer, force))


def collate(rows: DataFrame, keys: list[str], order: str, ids: str) -> DataFrame:
    """Per batch concatenated ids, labels (the first token of every sample but the first is ignored), positions from 0 in
    each sample, cumulative lengths and the longest length."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, ids))).alias("all")).select(*keys, F.transform("all", lambda x: x[ids]).alias("_parts"))
    places = F.flatten(F.transform("_parts", lambda p: F.transform(p, lambda _, i: i.cast("long"))))
    got = got.select(*keys, F.flatten("_parts").alias("input_ids"), places.alias("position_ids"), F.transform("_parts", lambda p: F.size(p).cast("long")).alias("_sizes"))
    label = lambda x, i: F.when((F.get("position_ids", i) == 0) & (i > 0), F.lit(IGNORED).cast("long")).otherwise(x)
    ends = F.transform("_sizes", lambda _, i: F.aggregate(F.slice("_sizes", 1, i + 1), F.lit(0).cast("long"), lambda s, n: s + n))
    return got.select(*keys, "input_ids", F.transform("input_ids", label).alias("labels"), "position_ids", F.concat(F.array(F.lit(0).cast("long")), ends).alias("cu_seq_lens"), F.array_max("_sizes").alias("max_length"))


def padded_to(batches: DataFrame, length: int) -> DataFrame:
    """Packed batches of a fixed length: ids 0, ignored labels, positions from 0; cumulative lengths and the longest length
    count the padding as a sample."""
    short = (F.lit(length) - F.size("input_ids")).cast("int")
    fill = lambda v: F.array_repeat(F.lit(v).cast("long"), short)
    more = F.when(short > 0, F.array(F.lit(length).cast("long"))).otherwise(F.array().cast("array<long>"))
    places = F.when(short > 0, F.transform(F.sequence(F.lit(0), F.greatest(short - 1, F.lit(0))), lambda i: i.cast("long"))).otherwise(F.array().cast("array<long>"))
    return batches.where(short >= 0).withColumns(
        {"input_ids": F.concat("input_ids", fill(0)), "labels": F.concat("labels", fill(IGNORED)), "position_ids": F.concat("position_ids", places), "cu_seq_lens": F.concat("cu_seq_lens", more), "max_length": F.greatest("max_length", short.cast("long"))}
    )


def padded(rows: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """Every row as long as the longest of its batch (keys): input_ids filled with 0, labels with ignored, mask 0."""
    longest = rows.groupBy(*keys).agg(F.max(F.size(ids)).alias("_most"))
    short = F.col("_most") - F.size(ids)
    fill = lambda v: F.array_repeat(F.lit(v).cast("long"), short)
    ones = F.array_repeat(F.lit(1).cast("long"), F.size(ids))
    return rows.join(longest, keys).withColumns({"attention_mask": F.concat(ones, fill(0)), "labels": F.concat(F.col(ids), fill(IGNORED)), "input_ids": F.concat(F.col(ids), fill(0))}).drop("_most")


def unpacked(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The samples of packed batches again: (keys, place, input_ids)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("cu_seq_lens") - 1), lambda i: F.slice("input_ids", (F.get("cu_seq_lens", i - 1) + 1).cast("int"), (F.get("cu_seq_lens", i) - F.get("cu_seq_lens", i - 1)).cast("int")))
    return batches.select(*keys, F.posexplode(pairs).alias("place", "input_ids"))


def loader(rows: DataFrame, place: str, batch: int, micro: int, drop_last: bool = True) -> DataFrame:
    """step and micro batch of each row by its place (from 0) in the epoch's order; an incomplete last step goes."""
    made = rows.withColumns({"step": F.floor(F.col(place) / batch), "micro": F.floor(F.col(place) % batch / (batch // micro))})
    if not drop_last:
        return made
    full = rows.agg(F.floor(F.count(F.lit(1)) / batch).alias("_full"))  # one row
    return made.crossJoin(F.broadcast(full)).where(F.col("step") < F.col("_full")).drop("_full")


def stepped(batches: DataFrame, place: str, micro: int, length: int) -> DataFrame:
    """Batches (places from 0) as micro batches of `length` steps: the batches start again from the first one until all
    steps are full; those of the second and later rounds are copies and have padding_flag."""
    total = batches.agg(F.count(F.lit(1)).alias("_total"))  # one row
    rounds = F.sequence(F.lit(0), F.ceil(F.lit(length * micro) / F.col("_total")).cast("int") - 1)
    made = batches.crossJoin(F.broadcast(total)).withColumn("_round", F.explode(rounds)).withColumn("_at", F.col("_round") * F.col("_total") + F.col(place))
    return made.where(F.col("_at") < length * micro).withColumns({"step": F.floor(F.col("_at") / micro), "micro": F.col("_at") % micro, "padding_flag": F.col("_round") > 0}).drop("_round", "_at", "_total")


def drop_history_spans(ids: Column, key: Column, start_id: int, end_id: int, percent: int, most: float, skip: int = 0, seed: int = 0) -> Column:
    """In each span between start_id and end_id, with a chance of `percent`, one run of tokens goes: up to `most` of the
    span behind its first `skip` tokens, which always stay. All choices come from digests of key, seed and the span's place."""
    from ..functions.text import digits

    n = F.size(ids)
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: F.get(ids, i) == start_id)
    nothing = F.array().cast("array<struct<a:int,b:int>>")

    def span(i: Column) -> Column:
        end = F.array_min(F.filter(places, lambda j: (j > i) & (F.get(ids, j) == end_id)))
        low = F.least(i + 1 + skip, end)
        cut = F.floor((end - low) * most * (digits(key, F.lit(seed), i, F.lit("size")) % 1000) / 1000 + 0.5).cast("int")
        cut = F.when(digits(key, F.lit(seed), i, F.lit("drop")) % 100 < percent, F.least(cut, end - low)).otherwise(0)
        at = (low + digits(key, F.lit(seed), i, F.lit("at")) % (end - low - cut + 1)).cast("int")
        return F.when(end.isNull() | (cut == 0), F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))).otherwise(F.struct(at.alias("a"), (at + cut).alias("b")))

    spans = F.when(n > 0, F.transform(starts, span)).otherwise(nothing)
    return F.flatten(F.transform(F.array(spans), lambda s: F.filter(ids, lambda _, i: ~F.exists(s, lambda x: (i >= x["a"]) & (i < x["b"])))))


def cu_seq_lens(position_ids: Column) -> Column:
    """Where positions start again, and the total."""
    starts = F.filter(F.transform(position_ids, lambda p, i: F.when(p == 0, i.cast("long"))), lambda x: x.isNotNull())
    return F.concat(starts, F.array(F.size(position_ids).cast("long")))


def shard_sequence(rows: DataFrame, ids: str, positions: str, ranks: int, pad: int = 0) -> DataFrame:
    """rank, shard_ids, shard_labels: labels shifted by one (each sample's last is ignored), both padded to a multiple and
    cut by rank."""
    size = F.ceil(F.size(ids) / ranks).cast("int")
    fill = lambda v: F.array_repeat(F.lit(v).cast("long"), size * ranks - F.size(ids))
    label = lambda _, i: F.when(F.coalesce(F.get(positions, i + 1), F.lit(0)) == 0, F.lit(IGNORED).cast("long")).otherwise(F.get(ids, i + 1))
    whole = rows.withColumns({"_labels": F.concat(F.transform(ids, label), fill(IGNORED)), "_ids": F.concat(F.col(ids), fill(pad)), "_size": size})
    at = F.col("rank") * F.col("_size") + 1
    made = whole.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    return made.select(*rows.columns, "rank", F.slice("_ids", at, F.col("_size")).alias("shard_ids"), F.slice("_labels", at, F.col("_size")).alias("shard_labels"))


def gathered(shards: DataFrame, keys: list[str], size: str, ids: str = "shard_ids") -> DataFrame:
    """Shards put together again in the order of their ranks, without the padding."""
    parts = shards.groupBy(*keys, size).agg(F.array_sort(F.collect_list(F.struct("rank", ids))).alias("_all"))
    return parts.select(*keys, F.slice(F.flatten(F.transform("_all", lambda x: x[ids])), F.lit(1), F.col(size).cast("int")).alias("input_ids"))


def balance(rows: DataFrame, group: str, key: str, size: str, bins: int) -> DataFrame:
    """bin: longest first, each to the bin with the smallest sum of squared lengths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, load, got = pdf.sort_values([size, key], ascending=[False, True]), [0] * bins, []
        for n in pdf[size].tolist():
            b = min(range(bins), key=lambda i: (load[i], i))
            load[b] += n * n
            got.append(b)
        return pdf.assign(bin=got)

    return rows.select(F.col(group).cast("long"), F.col(key).cast("long"), F.col(size).cast("long")).groupBy(group).applyInPandas(run, f"{group} long, {key} long, {size} long, bin long")
