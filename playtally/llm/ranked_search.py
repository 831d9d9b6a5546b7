"""Ranked search of many queries at once, where terms that queries share are added up once per document.

The items of a query set are dealt into blocks of bounded size, and every block becomes a plan in one
task: the two members with the most terms in common, repeats included, are found; the terms in common
become a member of their own, which takes their place in both; and so on until no two members share two
terms. Members are items and shared sets alike, so the result is a directed acyclic graph: a shared set is a
sum of terms and other shared sets, an item is the sum of what is left of it.

Documents are read twice at most. The first pass counts the terms of each document that the query set can
hold, by a bit table of fixed size, and stores them; document frequencies are counted from there, combined before the
shuffle. In the second, documents are dealt by number into shards of bounded size, and a shard meets the plan of
each block. There the contributions of the terms are one row of numbers each, over some hundred documents;
the sums of the graph are made once, in an order in which parts come first, and items add them up.
A shard passes on its best documents of an item only, and the best of all shards are the answer.

Terms are maximal runs of digits, letters and non-ASCII characters after lower-casing A-Z. The weight of a
term is floor(1000 ln((2 N + 2) / (2 df + 1))); it counts weight * (10**9 tf div (1000 tf + 8 m)) for each time that it
stands in the item, with m = 25 + (75 n N) div L of the document.

Defined cases: null and empty texts have no terms; they are not ranked and not counted in N; an item
without terms, or whose terms no document has, has no rows; items of equal id are ranked each for itself, and
so are documents; documents of equal score are ordered by id, those without id last; empty tables give
no rows; other columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtally.llm.store import stored

BEST = 10
#: Items and terms of a block, on average.
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 14
#: Counted terms of a shard, on average.
SHARD_TERMS = 1 << 19
#: Numbers that a shard holds at a time, for all terms and sums of a plan.
HELD = 1 << 22
#: Bits of the table that tells terms no query has.
BITS = 1 << 20
#: Terms that are worth a sum of their own.
MIN_SHARED = 2

_TERM_BYTES = bytes(
    x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256)
)
_ITEMS = "query long, item_id long, terms array<string>"
_COUNTED = "row long, doc_id long, n long, terms array<string>, counts array<long>"
_PLAN = (
    "block long, terms array<string>, sums array<array<int>>, queries array<long>, item_ids array<long>,"
    " items array<array<int>>"
)
_FOUND = "query long, item_id long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split() if text else []


def share(items: list[Counter]) -> tuple[list[list[int]], list[list[int]], int]:
    """Sums and items in terms of symbols: a number below `first` is a term, `first` + k is sum k.

    Terms are numbered from 0 in `items`; `first` is the third result. A sum comes behind the sums in it.
    """
    first = 1 + max((x for item in items for x in item), default=-1)
    members = [Counter(x) for x in items]
    holders: dict[int, set[int]] = defaultdict(set)
    for k, own in enumerate(members):
        for symbol in own:
            holders[symbol].add(k)

    def partner(k: int) -> tuple[int, int, int]:
        """(symbols in common, negated; member; the member it has most in common with)"""
        common: Counter = Counter()
        for symbol, times in members[k].items():
            for other in holders[symbol]:
                common[other] += min(times, members[other][symbol])
        del common[k]
        other = min(common, key=lambda x: (-common[x], x), default=-1)
        return -common[other], k, other

    queue = [partner(k) for k in range(len(members))]
    heapq.heapify(queue)
    while queue and -queue[0][0] >= MIN_SHARED:
        _, a, _ = known = heapq.heappop(queue)
        now = partner(a)
        if now[0] != known[0]:
            heapq.heappush(queue, now)
            continue
        b = now[2]
        shared, new = members[a] & members[b], len(members)
        members.append(shared)
        symbol = first + new - len(items)
        for k in (a, b):
            for x in shared:
                if members[k][x] == shared[x]:
                    del members[k][x]
                    holders[x].discard(k)
                else:
                    members[k][x] -= shared[x]
            members[k][symbol] = 1
            holders[symbol].add(k)
        for x in shared:
            holders[x].add(new)
        heapq.heappush(queue, partner(a))
        heapq.heappush(queue, partner(new))
    flat = [sorted(x.elements()) for x in members]
    sums, order = flat[len(items) :], []
    seen: set[int] = set()
    for k in range(len(sums)):
        stack = [k]
        while stack:
            top = stack[-1]
            missing = [x - first for x in sums[top] if x >= first and x - first not in seen]
            if missing:
                stack += missing
            else:
                stack.pop()
                if top not in seen:
                    seen.add(top)
                    order.append(top)
    place = {first + k: first + i for i, k in enumerate(order)}
    renamed = [[place.get(x, x) for x in own] for own in [*(sums[k] for k in order), *flat[: len(items)]]]
    return renamed[: len(sums)], renamed[len(sums) :], first


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    query = TaskContext.get().partitionId() << 33
    for batch in batches:
        own = [[x.decode() for x in terms(text)] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(query, query + len(own))), batch.column(0), pa.array(own, pa.list_(pa.string()))],
            ["query", "item_id", "terms"],
        )
        query += len(own)


def _plan(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.sort_by("query").to_pylist()
    names = sorted({x for row in rows for x in row["terms"]})
    number = {x: i for i, x in enumerate(names)}
    sums, items, _ = share([Counter(number[x] for x in row["terms"]) for row in rows])
    lists = pa.list_(pa.list_(pa.int32()))
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int64()),
            "terms": pa.array([names], pa.list_(pa.string())),
            "sums": pa.array([sums], lists),
            "queries": pa.array([[x["query"] for x in rows]], pa.list_(pa.int64())),
            "item_ids": pa.array([[x["item_id"] for x in rows]], pa.list_(pa.int64())),
            "items": pa.array([items], lists),
        }
    )


def plans(items: DataFrame) -> DataFrame:
    """One row per block of (query, item_id, terms): its terms, sums and items."""
    size = items.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_TERMS))
    return (
        items.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("long"))
        .groupBy("block")
        .applyInArrow(_plan, _PLAN)
    )


def _bit_table(names: DataFrame) -> bytes:
    """A bit for the checksum of every term, of fixed size whatever the number of terms."""
    bit = F.crc32(F.col("term").cast("binary")).bitwiseAND(BITS - 1) + 1
    rows = (
        names.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    width = (1 << 15) // 8
    table = bytearray(BITS // 8)
    for row in rows:
        table[(row.bucket - 1) * width : row.bucket * width] = row.bits
    return bytes(table)


def _count(table: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").tobytes()
        row, crc, last = TaskContext.get().partitionId() << 33, zlib.crc32, BITS - 1
        for batch in batches:
            sizes, ends, names, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                own = terms(text)
                sizes.append(len(own))
                for term, times in Counter(own).items():
                    if known[crc(term) & last]:
                        names.append(term)
                        counts.append(times)
                ends.append(len(names))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(sizes))),
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(names, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                ],
                ["row", "doc_id", "n", "terms", "counts"],
            )
            row += len(sizes)

    return run


def _score(best: int):
    def run(docs: pa.Table, plan: pa.Table) -> pa.Table:
        if not docs.num_rows or not plan.num_rows:
            return _found([], [], [], [])
        plan = plan.slice(0, 1)
        ids = docs.column("doc_id").combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_end")
        docs, ids = docs.take(order), ids.take(order)
        terms, counts = docs.column("terms").combine_chunks(), docs.column("counts").combine_chunks()
        names = plan.column("terms").combine_chunks().flatten()
        at = pc.index_in(terms.flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        asked = at >= 0
        at, doc, times = at[asked], doc[asked], counts.flatten().to_numpy(zero_copy_only=False)[asked]
        weight = plan.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = docs.column("m").to_numpy()
        value = weight[at] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
        sums, items = plan.column("sums")[0].as_py(), plan.column("items")[0].as_py()
        first = len(names)
        width = max(1, HELD // (first + len(sums)))
        top_score = np.zeros((len(items), 0), np.int64)
        top_doc = np.zeros((len(items), 0), np.int64)
        for a in range(0, len(ids), width):
            low, high = np.searchsorted(doc, [a, a + width])
            n = min(width, len(ids) - a)
            held = np.zeros((first + len(sums), n), np.int64)
            held[at[low:high], doc[low:high] - a] = value[low:high]
            for k, parts in enumerate(sums):
                held[parts].sum(axis=0, out=held[first + k])
            score = np.empty((len(items), n), np.int64)
            for k, parts in enumerate(items):
                held[parts].sum(axis=0, out=score[k])
            # Documents come by id, and earlier ones first, so a stable order breaks ties by id.
            score = np.concatenate((top_score, score), axis=1)
            places = np.concatenate((top_doc, np.broadcast_to(np.arange(a, a + n), (len(items), n))), axis=1)
            keep = np.argsort(-score, axis=1, kind="stable")[:, :best]
            top_score, top_doc = np.take_along_axis(score, keep, 1), np.take_along_axis(places, keep, 1)
        item, column = np.nonzero(top_score > 0)
        queries = plan.column("queries").combine_chunks().flatten().take(pa.array(item))
        item_ids = plan.column("item_ids").combine_chunks().flatten().take(pa.array(item))
        return _found(queries, item_ids, ids.take(pa.array(top_doc[item, column])), top_score[item, column])

    return run


def _found(*columns) -> pa.Table:
    names = ["query", "item_id", "doc_id", "score"]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], names)


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The `best` documents of every item with a score above 0: item_id, rank (from 1), doc_id, score."""
    asked = items.select(F.col(item_column).cast("long"), F.col(item_text_column).cast("string"))
    planned = stored(plans(stored(asked.mapInArrow(_read_items, _ITEMS))))
    names = planned.select("block", F.posexplode("terms").alias("at", "term"))
    texts = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    counted = stored(texts.mapInArrow(_count(_bit_table(names)), _COUNTED))
    size = counted.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))
    ).first()
    with_terms, all_terms, kept_terms = size
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * with_terms + 2) / (2.0 * F.coalesce("df", F.lit(0)) + 1)))
    weights = (
        names.join(frequency, "term", "left")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("at", weight.cast("long").alias("weight")))).alias("weights"))
        .select(F.col("block").alias("of"), F.col("weights.weight").alias("weights"))
    )
    shards = max(1, -(-kept_terms // SHARD_TERMS))
    # Every shard meets every block.
    blocks = (planned.agg(F.max("block")).first()[0] or 0) + 1
    weighted = planned.join(weights, F.col("block") == F.col("of")).drop("of")
    m = F.expr(f"25L + (75L * n * {with_terms}L) div {max(1, all_terms)}L")
    dealt = counted.where(F.size("terms") > 0).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard"),
        "doc_id",
        m.alias("m"),
        "terms",
        "counts",
    )
    each_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    plan_of_shard = weighted.withColumn("shard", each_shard)
    found = (
        dealt.groupBy("block", "shard")
        .cogroup(plan_of_shard.groupBy("block", "shard"))
        .applyInArrow(_score(best), _FOUND)
    )
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= best)
        .select("item_id", "rank", "doc_id", "score")
    )
