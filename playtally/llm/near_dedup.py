"""Near-duplicate documents by a chosen-path similarity join over minwise signatures.

The set of a document are its distinct shingles. Documents with equal sets form a class, and one of each
class goes on. In each of several independent trees a document takes `BRANCHES` minwise tokens of the
root and goes down the branch of each token's value. A node of at most `LEAF` documents is compared
exhaustively. A larger node compares every member with at most `HEADS` of them, which is linear, and unless half
turn out to be near copies of one, sends all on along further tokens. Nodes of near copies, and those that are
still large after `DEEP` levels, hold documents that agree in many tokens. What the confirmed links leave apart
among their members is joined exactly, see `unlinked`. Two documents of similarity s share one value with probability s; at
0.85, `TREES` = 4 trees of 2 branches miss a pair in a small node with a chance of 0.15 ** 8.

Comparing signatures only proposes pairs. A pair is linked if the full sets confirm it; links then become
components. Among near copies whose signatures agree almost entirely, only a spanning star is proposed,
so large groups of copies give as many pairs as members.

Shuffled are keys, signatures of `TOKENS` bytes of those that share a node, once the texts (to meet the
documents that some pair names), and the sets of those. Nothing grows on the driver.

Defined cases: null, empty and blank texts have an empty set, no links, and are kept; a text with fewer
words than a shingle has its whole sequence as the only one; repeated ids are one document to the
links, each row with its own set; a row without id has no links, no component, and is kept; an empty
table gives no rows; other columns are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtally.llm import hashing, native
from playtally.llm.components import components
from playtally.llm.store import stored

SHINGLE = 3
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
TOKENS = 96
TREES = 4
BRANCHES = 2
LEAF = 48
#: Members of a larger node that all its members are compared with.
HEADS = 24
#: Levels with BRANCHES branches; below them a member follows one, and nodes still large at DEEP are joined exactly.
WIDE_LEVELS = 2
DEEP = 4
#: Shares of equal tokens, in standard errors from the link threshold: below MAYBE no pair is proposed, from
#: SURELY on, documents count as near copies when pairs are chosen; a node is not sent on but left to the exact
#: join if at least half of its members reach CLOSE with a head.
MAYBE, SURELY, CLOSE = -5.2, 2.75, 0.55
#: Counters that put shingles in order, rare ones first; any order is exact.
BUCKETS = 1 << 20
#: Documents of a block of one shingle; two blocks meet in a task.
BLOCK = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _share(errors: float, percent: int) -> float:
    """The share of equal tokens so many standard errors from `percent`."""
    return percent / 100 + errors * (percent * (100 - percent) / TOKENS) ** 0.5 / 100


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, roots array<long>"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; A-Z count as small letters."""
    for _, buffer, at in hashing.pieces(texts):
        buffer = _LOWER[buffer]
        starts, ends, row = hashing.words(buffer, at)
        word = hashing.word_hashes(buffer, starts, ends)
        windows = hashing.window_hashes(word, size)
        begin = np.searchsorted(row, np.arange(len(at)))
        for r in range(len(at) - 1):
            a, b = int(begin[r]), int(begin[r + 1])
            if b - a >= size:
                yield np.unique(windows[a : b - size + 1])
            elif b > a:
                yield hashing.stretch_hashes(word[a:b], np.array([0]), np.array([b - a]), hashing.WORD_BASE)
            else:
                yield np.zeros(0, np.uint64)


def _seeds(name: int, n: int) -> np.ndarray:
    return hashing.mix(np.arange(n, dtype=np.uint64) + np.uint64(name << 32)) | np.uint64(1)


#: Shingles that are hashed in one go, so that they stay in a processor's cache.
TOGETHER = 1 << 15


def _minwise(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minwise values of every set; none is empty."""
    own = np.concatenate(sets)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    tokens = np.empty((len(sets), TOKENS), np.uint64)
    mixed, high = np.empty_like(own), np.empty_like(own)
    for t, (factor, shift) in enumerate(zip(_seeds(1, TOKENS), _seeds(2, TOKENS), strict=True)):
        np.multiply(own, factor, out=mixed)
        np.right_shift(mixed, np.uint64(32), out=high)
        np.bitwise_xor(mixed, high, out=mixed)
        np.multiply(mixed, shift, out=mixed)
        tokens[:, t] = np.minimum.reduceat(mixed, begin)
    return hashing.mix(tokens)


def _together(sets: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    some, held = [], 0
    for own in sets:
        some.append(own)
        held += len(own)
        if held >= TOGETHER:
            yield some
            some, held = [], 0
    if some:
        yield some


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = (np.arange(TREES * BRANCHES) * 7) % TOKENS
        names = _seeds(3, TREES * BRANCHES)
        for batch in batches:
            n, k1, k2, sig, roots = [], [], [], [], []
            for sets in _together(shingle_sets(batch.column(1), size)):
                full = [own for own in sets if len(own)]
                tokens = iter(_minwise(full)) if full else iter(())
                for own in sets:
                    n.append(len(own))
                    k1.append(int(hashing.mix(own).sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(np.bitwise_xor.reduce(hashing.mix(own * np.uint64(3)), initial=np.uint64(0)).view(np.int64)))
                    if not len(own):
                        sig.append(None)
                        roots.append(None)
                        continue
                    values = next(tokens)
                    sig.append((values & np.uint64(255)).astype(np.uint8).tobytes())
                    roots.append(hashing.mix(values[chosen] ^ names).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(k1, pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.array(sig, pa.binary()),
                    pa.array(roots, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "sig", "roots"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(TOKENS))
    return np.frombuffer(fixed.buffers()[1], np.uint8).reshape(-1, TOKENS)[fixed.offset : fixed.offset + len(fixed)]


PAIRS = "a long, b long"


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare_leaves(maybe: float, surely: float):
    """All pairs of a small node that may be similar; near copies by a spanning star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column("members").to_pylist():
                members.sort(key=lambda x: x["doc_id"])
                ids = [x["doc_id"] for x in members]
                sig = np.frombuffer(b"".join(x["sig"] for x in members), np.uint8).reshape(-1, TOKENS)
                equal = (sig[:, None, :] == sig[None, :, :]).mean(axis=2)
                head: list[int] = []
                for i in range(len(ids)):
                    near = next((j for j in range(i) if head[j] == j and equal[i, j] >= surely), i)
                    head.append(near)
                    for j in range(i):
                        if j == near or (head[j] != near and equal[i, j] >= maybe):
                            left.append(ids[j])
                            right.append(ids[i])
            yield _pairs(left, right)

    return run


def _compare_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the head of its node that a member shares most tokens with, and that share; a head looks at those
    before it, so that the likest heads make a tree, and the first has itself."""
    for batch in batches:
        # Short slices, as every row brings all heads of its node.
        for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
            doc, heads = part.column("doc_id").to_numpy(), part.column("heads")
            n = heads.value_lengths().to_numpy()
            begin = np.cumsum(n) - n
            flat = heads.flatten()
            head, row = flat.field("doc_id").to_numpy(), np.repeat(np.arange(len(n)), n)
            share = (_matrix(part.column("sig"))[row] == _matrix(flat.field("sig"))).mean(axis=1)
            own = np.where(head == doc[row], np.arange(len(row)), len(row))
            share[np.arange(len(row)) >= np.minimum.reduceat(own, begin)[row]] = -1
            best = np.maximum.reduceat(share, begin)
            at = np.minimum.reduceat(np.where(share == best[row], np.arange(len(row)), len(row)), begin)
            alone = best < 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node"),
                    part.column("doc_id"),
                    pa.array(np.where(alone, doc, head[at])),
                    pa.array(np.where(alone, 1.0, best)),
                ],
                ["node", "doc_id", "head", "share"],
            )


def _descend(level: int):
    branches = BRANCHES if level <= WIDE_LEVELS else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            sig = _matrix(batch.column("sig"))
            for k in range(branches):
                # The node chooses the tokens, so all its members choose alike.
                token = hashing.mix(node + np.uint64(977 * level + k + 1)) % np.uint64(TOKENS)
                value = sig[np.arange(len(sig)), token.astype(np.int64)].astype(np.uint64)
                child = hashing.mix(hashing.mix(node ^ (token << np.uint64(20))) + value + np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), batch.column("doc_id")], ["node", "doc_id"]
                )

    return run


def candidates(sketches: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of documents that may be similar, from all trees, and the documents (doc_id) of nodes that
    were not compared exhaustively; sketches: doc_id, sig, roots."""
    maybe, surely, close = (_share(x, percent) for x in (MAYBE, SURELY, CLOSE))
    signatures = sketches.select("doc_id", "sig")
    frontier = sketches.select(F.explode("roots").alias("node"), "doc_id")
    pairs, rest, level = None, None, 0
    while True:
        level += 1
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = stored(frontier.join(sizes, "node").join(signatures, "doc_id").select("node", "n", "doc_id", "sig"))
        small = (
            members.where(F.col("n") <= LEAF)
            .groupBy("node")
            .agg(F.collect_list(F.struct("doc_id", "sig")).alias("members"))
            .select("members")
            .mapInArrow(_compare_leaves(maybe, surely), PAIRS)
        )
        large = members.where(F.col("n") > LEAF)
        # One of every slot, so that no task sorts or gathers a node.
        mixed = F.xxhash64("node", "doc_id")
        chosen = large.groupBy("node", F.pmod(mixed, F.lit(HEADS)).alias("slot")).agg(
            F.min(F.struct(mixed, "doc_id"))["doc_id"].alias("doc_id")
        )
        heads = chosen.join(signatures, "doc_id").groupBy("node").agg(
            F.array_sort(F.collect_list(F.struct("slot", "doc_id", "sig"))).alias("heads")
        )
        compared = stored(
            large.join(heads, "node")
            .select("node", "doc_id", "sig", "heads")
            .mapInArrow(_compare_heads, "node long, doc_id long, head long, share double")
        )
        star = compared.where((F.col("share") >= maybe) & (F.col("head") != F.col("doc_id"))).select(
            F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b")
        )
        found = small.unionByName(star).distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
        near = F.count_if(F.col("share") >= close).alias("near")
        open_nodes = compared.groupBy("node").agg(near, F.count(F.lit(1)).alias("n")).where("2 * near < n")
        left = large.join(open_nodes.select("node"), "node", "left_semi").select("node", "doc_id", "sig")
        # A share is an estimate, so the members of a closed node are not done either.
        ended = large if level == DEEP else large.join(open_nodes.select("node"), "node", "left_anti")
        ended = ended.select("doc_id").distinct()
        rest = ended if rest is None else rest.unionByName(ended)
        if level == DEEP or open_nodes.isEmpty():
            return pairs.distinct(), rest.distinct()
        # Cut, as the next level reads it twice, for the sizes of nodes and for their members.
        frontier = stored(left.mapInArrow(_descend(level), "node long, doc_id long").distinct())


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                low, high = sorted((len(x), len(y)))
                if 100 * low < percent * high:
                    keep.append(False)
                    continue
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield _pairs(
                batch.column("a").filter(pa.array(keep, pa.bool_())).to_pylist(),
                batch.column("b").filter(pa.array(keep, pa.bool_())).to_pylist(),
            )

    return run


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (hashing.mix(tokens) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data in batch.column(0):
            np.add.at(counts, _buckets(np.frombuffer(data.as_py(), np.uint64)), 1)
    bucket = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(counts[bucket])], ["bucket", "n"])


PREFIX = "token long, doc_id long, component long, n long, place long"


def _prefixes(percent: int, counts: np.ndarray):
    """The shingles of a set, in the common order, of which a set that is similar enough shares at least one."""
    names = [x.split()[0] for x in PREFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for batch in batches:
            for doc, component, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = np.frombuffer(data.as_py(), np.uint64)
                n = len(own)
                first = own[np.lexsort((own, counts[_buckets(own)]))[: n + percent * -n // 100 + 1]]
                fixed = [np.full(len(first), x, np.int64) for x in (doc.as_py(), component.as_py(), n)]
                some.append([first.view(np.int64), *fixed, np.arange(len(first))])
                held += len(first)
                if held >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*some, strict=True)], names)
                    some, held = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*some, strict=True)], names)

    return run


def _apart(prefix: DataFrame) -> DataFrame:
    """Rows of shingles that more than one component has, with the largest of them and the numbers of rows."""
    shingles = (
        prefix.groupBy("token", "component")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("least"))
        .groupBy("token")
        .agg(
            F.max(F.struct("rows", "component")).alias("major"),
            F.sum("rows").alias("all"),
            F.min("least").alias("least"),
            F.count(F.lit(1)).alias("parts"),
        )
        .where("parts > 1")
        .drop("parts")
    )
    return prefix.join(shingles, "token")


def _compare_blocks(percent: int):
    """Pairs across two blocks of one shingle whose components differ and that may share enough behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members").to_pylist():
                doc, component, n, place, block = (
                    np.array([x[k] for x in members]) for k in ("doc_id", "component", "n", "place", "block")
                )
                shared = np.minimum.outer(n - place, n - place)
                able = (100 + percent) * shared >= percent * np.add.outer(n, n)
                able &= component[:, None] != component
                if block.min() != block.max():
                    able &= block[:, None] != block
                i, j = np.nonzero(np.triu(able))
                if len(i):
                    yield _pairs(np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]))

    return run


def unlinked(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that may be similar; sets: doc_id, component, set.

    An exact prefix filter: with shingles in one order, similar sets share one among the first of either, and
    the places of the first shared one bound how many more they can share. A shingle of many documents is cut
    into blocks that meet pair by pair, those of the largest component only with the others.
    """
    counted = sets.select("set").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.uint32)
    counts[counted.column("bucket").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 32) - 1)
    prefix = stored(sets.select("doc_id", "component", "set").mapInArrow(_prefixes(percent, counts), PREFIX))
    # Most shared shingles fall here: no partner leaves room for enough behind them.
    able = stored(
        _apart(prefix).where((100 - percent) * F.col("n") >= 100 * F.col("place") + percent * F.col("least")).select(prefix.columns)
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    mixed, largest = F.xxhash64("doc_id"), F.col("component") == F.col("major.component")
    cells = (
        _apart(able)
        .withColumn("k", blocks(F.col("major.rows")))
        .withColumn("q", blocks(F.col("all") - F.col("major.rows")))
        .withColumn("block", F.when(largest, F.pmod(mixed, "k")).otherwise(F.col("k") + F.pmod(mixed, "q")))
        .withColumn("other", F.explode(F.sequence(F.when(largest, F.col("k")).otherwise(F.lit(0).cast("long")), F.col("k") + F.col("q") - 1)))
        .groupBy("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .agg(F.collect_list(F.struct("doc_id", "component", "n", "place", "block")).alias("members"))
    )
    return cells.select("members").mapInArrow(_compare_blocks(percent), PAIRS).distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id), kept."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sketches = stored(texts.mapInArrow(_sketch(shingle), SKETCH))
    named = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("head"))
    member = named.join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "head")
    heads = named.join(classes, ["k1", "k2", "n_shingles"]).where("doc_id = head").select(
        "doc_id", "k1", "k2", "sig", "roots"
    ).dropDuplicates(["doc_id", "k1", "k2"])
    pairs, rest = candidates(heads, percent)
    pairs, rest = stored(pairs.where("a <> b")), stored(rest)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(rest).distinct()
    sets = stored(texts.join(wanted.hint("merge"), "doc_id").mapInArrow(_sets(shingle), "doc_id long, set binary"))
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    confirmed = lambda pairs: (
        pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), PAIRS)
    )
    # A class is a star around its head; a repeated id ties its classes together.
    alike = member.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    found = components(confirmed(pairs).unionByName(alike))
    if not rest.isEmpty():
        placed = (
            sets.join(rest, "doc_id")
            .join(found, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", F.coalesce("component", "doc_id").alias("component"), "set")
        )
        more = stored(confirmed(unlinked(stored(placed), percent)))
        if not more.isEmpty():
            found = components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return (
        sketches.join(found, F.col("doc_id") == F.col("node"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, shingle: int, percent: int, id_column: str = "doc_id") -> DataFrame:
    """The documents that `near_duplicates` keeps, with all their columns."""
    name = native.free_name(docs.columns, "_gone")
    gone = (
        near_duplicates(docs, shingle, percent, id_column)
        .where("NOT kept")
        .select(F.col("doc_id").alias(name))
        .distinct()
    )
    return docs.join(gone.hint("merge"), F.col(id_column) == F.col(name), "left_anti")
