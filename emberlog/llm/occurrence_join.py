"""Jaccard self-join of documents on word n-grams by T-occurrence search.

Two sets of sizes n and m have Jaccard similarity of p % exactly if they share T = ceil(p (n + m) / (100 + p))
shingles. For a query set, DivideSkip takes the inverted lists of its shingles, merges the short ones, keeps
documents that occur often enough there, and probes the long lists for these candidates only.

Steps, all on whole texts and all documents:

1. Hash each text's shingles; equal sets form a class, named by a digest. Only classes are compared.
2. Count every shingle's documents. Blocks of documents send each shingle with a count to its bucket; buckets answer
   with totals. A shingle of one document can't be shared, so a class needs T shingles that others have, too;
   all other classes are done here.
3. Of the survivors, shingles are ordered from rare to frequent. Linked classes share one of the first n - T + 1, so
   these prefixes give the candidate clusters (connected components).
4. T-occurrence search inside each cluster. Small clusters share a task; a large one is cut into blocks and searched
   by pairs of blocks, so that no task holds it whole. Tasks give links that connect, not all pairs.
5. Components of the links give each class, and so each document, its smallest reachable id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keyed_text, release_memory, rows_of, ship_package, shuffle_partitions, written
from .graph import components

#: Classes of a cluster that are searched at once. Larger clusters are searched by pairs of blocks of this size.
CLUSTER_BLOCK = 400
#: Shingles of a counting block and of a bucket, about.
BLOCK_SHINGLES, BUCKET_SHINGLES = 1 << 19, 1 << 20
BLOCK_SETS, MOST_BUCKETS = 60_000, 1 << 20
#: Ids of dropped documents up to which they go to every task; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: A shingle in so many sets of one counting block leaves the sets' numbers at home and sends its count only.
COMMON = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

DIGESTS = "doc_id long, n_shingles long, class binary"
MESSAGES = "bucket int, block long, kind int, shingles binary, counts binary, sets binary, totals binary"
OWN, COMMONS, ASKED, TOLD = range(4)
CLASSES = "class binary, n long, shingles binary, prefix array<long>"


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams. Words end at ASCII white space; A-Z count as a-z."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        if len(words) < self.width:  # the whole sequence as one, apart from all full shingles
            mixed = np.array([len(words)], np.uint64)
            for h in hashes:
                mixed = mixed * _ODD + h
        else:
            n = len(words) - self.width + 1
            mixed = hashes[:n].copy()
            for k in range(1, self.width):
                mixed = mixed * _ODD + hashes[k:n + k]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(shingles.astype("<u8").tobytes())


def needed(n, m, percent: int):
    """Shared shingles that sets of ``n`` and ``m`` need for ``percent`` % Jaccard similarity."""
    return -(-percent * (n + m) // (100 + percent))


def set_digests(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, class): ``class`` names the set; null for empty ones."""
    def make():
        shingler = Shingler(width)

        def run(batches) -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                found = shingler(text or "")
                yield doc_id, len(found), digest(found) if len(found) else None

        return run

    return arrow_map(docs, make, DIGESTS)


def count_requests(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """What counting blocks send: their sets (to themselves), common shingles' sets (too), and shingles to buckets."""
    limit = max(BLOCK_SHINGLES, 16 * buckets)

    def make():
        from pyspark import TaskContext

        shingler, part = Shingler(width), TaskContext.get().partitionId()

        def run(batches) -> Iterator[tuple]:
            sets: dict[bytes, np.ndarray] = {}
            size = number = 0
            for _, text in rows_of(batches):
                found = shingler(text or "")
                if not len(found):
                    continue
                name = digest(found)
                if name in sets:
                    continue
                sets[name] = found
                size += len(found)
                if size >= limit or len(sets) >= BLOCK_SETS:
                    yield from block_messages(sets, (part << 32) + number, buckets)
                    sets, size, number = {}, 0, number + 1
            if sets:
                yield from block_messages(sets, (part << 32) + number, buckets)

        return run

    return arrow_map(docs, make, MESSAGES)


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; small ones leave their upper planes empty."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_shingles(shingles: np.ndarray, bucket: int, buckets: int) -> bytes:
    """Ascending shingles of one bucket as the steps between them: the bucket needs no bits of its own."""
    return pack_numbers(np.diff((shingles - np.uint64(bucket)) // np.uint64(buckets), prepend=np.uint64(0)))


def unpack_shingles(packed: bytes, bucket: int, buckets: int) -> np.ndarray:
    return np.cumsum(unpack_numbers(packed, np.uint64), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def block_messages(sets: dict[bytes, np.ndarray], block: int, buckets: int) -> Iterator[tuple]:
    names, found = list(sets), list(sets.values())
    lengths = np.array([len(x) for x in found], np.uint32)
    home = xxhash.xxh64_intdigest(block.to_bytes(8, "little")) % buckets
    yield home, block, OWN, b"".join(names), lengths.tobytes(), None, None
    shingles = np.concatenate(found)
    owner = np.repeat(np.arange(len(found), dtype=np.uint16), lengths)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    distinct, first, counts = np.unique(shingles, return_index=True, return_counts=True)
    common = counts >= COMMON
    if common.any():
        yield (home, block, COMMONS, distinct[common].tobytes(), counts[common].astype(np.uint32).tobytes(),
               owner[np.repeat(common, counts)].tobytes(), None)
    place = (distinct % np.uint64(buckets)).astype(np.int64)
    by_bucket = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[by_bucket], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = by_bucket[a:b]
        light = rows[~common[rows]]
        bucket = int(place[rows[0]])
        yield (bucket, block, ASKED, pack_shingles(distinct[rows], bucket, buckets),
               pack_numbers(counts[rows].astype(np.uint16)),
               pack_numbers(owner[_ranges(first[light], counts[light])]), None)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else starts, lengths)
    return np.arange(total) + shift


def answer_bucket(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Each block's shingles of this bucket that more than one set has, with their totals. The rest passes through."""
    asked = rows["kind"] == ASKED
    out = [rows[~asked]]
    if asked.any():
        rows = rows[asked]
        shingles = [unpack_shingles(x, b, buckets) for x, b in zip(rows["shingles"], rows["bucket"], strict=True)]
        counts = [unpack_numbers(x, np.uint16) for x in rows["counts"]]
        distinct, inverse = np.unique(np.concatenate(shingles), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate(counts).astype(np.float64), len(distinct)).astype(np.int64)[inverse]
        ends = np.cumsum([len(x) for x in shingles])
        told = []
        for row, mine, own in zip(rows.itertuples(), shingles, counts, strict=True):
            end = ends[len(told)]
            total = totals[end - len(mine):end]
            shared = total > 1
            light = own < COMMON
            sets = unpack_numbers(row.sets, np.uint16)[np.repeat(shared[light], own[light])]
            told.append((row.bucket, row.block, TOLD, pack_shingles(mine[shared], row.bucket, buckets),
                         pack_numbers(own[shared]), pack_numbers(sets),
                         pack_numbers(np.minimum(total[shared], 2**32 - 1).astype(np.uint32))))
        out.append(pd.DataFrame(told, columns=list(rows.columns)))
        release_memory()
    return pd.concat(out)


def surviving_classes(percent: int, buckets: int):
    """For a block: its sets with enough shared shingles, rare ones first, and the prefix that finds partners."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["kind"] == OWN].iloc[0]
        sizes = np.frombuffer(own["counts"], np.uint32).astype(np.int64)
        names = [own["shingles"][k:k + 16] for k in range(0, len(own["shingles"]), 16)]
        told = rows[rows["kind"] == TOLD]
        join = lambda column, kind: np.concatenate(
            [np.zeros(0, kind), *(unpack_numbers(x, kind) for x in told[column])])
        shingles = np.concatenate([np.zeros(0, np.uint64), *(
            unpack_shingles(x, b, buckets) for x, b in zip(told["shingles"], told["bucket"], strict=True))])
        counts, totals, sets = join("counts", np.uint16), join("totals", np.uint32), join("sets", np.uint16)
        light = counts < COMMON
        parts = [(np.repeat(shingles[light], counts[light]), sets, np.repeat(totals[light], counts[light]))]
        for row in rows[rows["kind"] == COMMONS].itertuples():
            common, times = np.frombuffer(row.shingles, np.uint64), np.frombuffer(row.counts, np.uint32)
            heavy = np.argsort(shingles[~light])
            total = totals[~light][heavy][np.searchsorted(shingles[~light][heavy], common)]
            parts.append((np.repeat(common, times), np.frombuffer(row.sets, np.uint16), np.repeat(total, times)))
        shingles, sets, totals = (np.concatenate(x) for x in zip(*parts, strict=True))
        shared = np.bincount(sets, minlength=len(sizes))
        least = -(-percent * sizes // 100)
        alive = shared >= np.maximum(least, 1)
        mine = alive[sets]
        shingles, sets, totals = shingles[mine], sets[mine], totals[mine]
        order = np.lexsort((shingles, totals, sets))
        shingles, sets = shingles[order], sets[order]
        starts = np.searchsorted(sets, np.arange(len(sizes)))
        out = []
        for k in np.flatnonzero(alive).tolist():
            those = shingles[starts[k]:starts[k] + shared[k]]
            lead = int(sizes[k] - least[k] + 1 - (sizes[k] - shared[k]))
            out.append((names[k], int(sizes[k]), those.tobytes(), those[:lead].astype(np.int64)))
        release_memory()
        return pd.DataFrame(out, columns=["class", "n", "shingles", "prefix"])

    return run


def search_links(names: list, sizes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int,
                 crossed: bool) -> Iterator[tuple]:
    """T-occurrence search of every set among the others; yields links (a, b) that join groups not yet joined.

    ``crossed``: only pairs of unlike sides are asked for.
    """
    order = np.argsort(sizes, kind="stable")
    names, sizes, sides = [names[k] for k in order], sizes[order], sides[order]
    sets = [sets[k] for k in order]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    by_id = np.lexsort((owner, ids))
    posted = owner[by_id]
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    length = np.diff(starts)
    root = np.arange(len(sets))
    for x in range(len(sets)):
        own = ids[ends[x] - len(sets[x]):ends[x]]
        own = own[length[own] > 1]
        least = int(needed(2 * int(sizes[x]), 0, percent))  # partners are as large at least
        if len(own) < least:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        n_long = min(least - 1, int(least / (0.0085 * np.log2(max(2, int(length[own[-1]]))) + 1)))
        short, long = own[:len(own) - n_long], own[len(own) - n_long:]
        merged = np.sort(np.concatenate([posted[starts[i]:starts[i + 1]] for i in short]), kind="stable")
        found, count = _runs(merged)
        fits = ((found > x) & (count >= least - n_long) & (100 * sizes[x] >= percent * sizes[found])
                & (root[found] != root[x]))
        if crossed:
            fits &= sides[found] != sides[x]
        found, count = found[fits], count[fits]
        least_by = needed(sizes[x], sizes[found], percent)
        for done, i in enumerate(long):
            if not len(found):
                break
            posting = posted[starts[i]:starts[i + 1]]
            place = np.minimum(np.searchsorted(posting, found), len(posting) - 1)
            count = count + (posting[place] == found)
            able = count + (len(long) - 1 - done) >= least_by
            if not able.all():
                found, count, least_by = found[able], count[able], least_by[able]
        for y in found[count >= least_by].tolist():
            if root[y] != root[x]:
                yield names[x], names[y]
                root[root == root[y]] = root[x]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return values[first], np.diff(first, append=len(values))


def linked_classes(docs: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """(node, root) of all classes that have a link."""
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    buckets = min(MOST_BUCKETS, max(4 * partitions, total // BUCKET_SHINGLES))
    requests = count_requests(docs, width, buckets)
    answers = written(requests.groupBy("bucket").applyInPandas(lambda rows: answer_bucket(rows, buckets), MESSAGES),
                      "answers")  # the requests are the largest shuffle: they go before the answers are shuffled
    found = answers.groupBy("block").applyInPandas(surviving_classes(percent, buckets), CLASSES)
    classes = written(found.groupBy("class").agg(
        *[F.first(c).alias(c) for c in ("n", "shingles", "prefix")]), "classes")

    lists = classes.select("class", F.explode("prefix").alias("shingle"))
    heads = lists.groupBy("shingle").agg(F.min("class").alias("a"), F.count("*").alias("n")).filter("n > 1")
    clusters = components(lists.join(heads, "shingle").select("a", F.col("class").alias("b")))

    members = classes.drop("prefix").join(clusters.withColumnRenamed("node", "class"), "class")
    sizes = written(clusters.groupBy("root").agg(F.count("*").alias("members")), "sizes")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        sides, crossed = rows["side"].to_numpy(), bool(rows["crossed"].iloc[0])
        if crossed and len(np.unique(sides)) == 1:  # the other block has no rows; this one has a job of its own
            return pd.DataFrame([], columns=["a", "b"])
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        links = search_links(list(rows["class"]), rows["n"].to_numpy(), sets, sides, percent, crossed)
        found = pd.DataFrame(list(links), columns=["a", "b"])
        release_memory()
        return found

    return components(search_jobs(members, sizes).groupBy("job").applyInPandas(search, "a binary, b binary"))


def search_jobs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(job, class, n, shingles, side, crossed): what is searched together.

    Small clusters share a job. A large one is cut by a hash of the class, which is even whatever the texts share: each
    block has a job of its own, and each pair of blocks one for the links across.
    """
    small = sizes.filter(F.col("members") <= CLUSTER_BLOCK).agg(F.sum("members")).first()[0] or 0
    bins = max(1, small // CLUSTER_BLOCK)
    placed = members.join(sizes, "root").withColumn(
        "blocks", F.ceil(F.col("members") / CLUSTER_BLOCK).cast("int")).withColumn(
        "side", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    alone = placed.filter("blocks = 1").withColumn("crossed", F.lit(False)).withColumn(
        "job", F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins))))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.filter("blocks > 1").withColumn("other", other).withColumn(
        "crossed", F.col("side") != F.col("other")).withColumn(
        "job", F.concat_ws(" ", F.hex("root"), F.least("side", "other"), F.greatest("side", "other")))
    columns = ["job", "class", "n", "shingles", "side", "crossed"]
    return alone.select(*columns).union(paired.select(*columns))


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set, and the smallest id it reaches by links.

    Two rows link when ``100 * intersection >= percent * union`` of their sets of ``width``-word shingles; fewer words
    give one shingle. Null and empty texts have an empty set, link with nothing and keep their own id. Equal ids stay
    separate rows; null ids take part and never become a component's id unless it has no other. An empty table gives
    an empty one. Shingles are compared by 64-bit hashes and sets by 128-bit ones.
    """
    docs = keyed_text(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    rows = written(set_digests(docs, width), "digests")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    roots = linked_classes(docs.select("doc_id", "text"), width, percent, total)
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    grouped = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "class", F.coalesce("root", "class").alias("root"), "least")
    heads = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(heads, "root").select("class", "component_id")
    linked = rows.filter("class IS NOT NULL").join(named, "class").select("doc_id", "n_shingles", "component_id")
    empty = rows.filter("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(empty)


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id. Same columns.

    Rows that repeat an id with an equal text are one document, with unlike texts they are several: each is kept or
    goes by its own text. Rows without an id can't be named and stay.
    """
    repeated = docs.filter(docs[id_col].isNotNull()).groupBy(id_col).count().filter("count > 1")
    if not repeated.isEmpty():
        return _keep_one_of_each_row(docs, width, percent, id_col, text_col)
    groups = written(jaccard_groups(docs, width, percent, id_col, text_col).select("doc_id", "component_id"), "groups")
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def _keep_one_of_each_row(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The same where ids repeat: rows are numbered by id and text, and groups are those of the numbers."""
    named = docs.filter(docs[id_col].isNotNull()).dropDuplicates([id_col, text_col])
    order = [F.col("row")[id_col], F.xxhash64(F.col("row")[text_col])]
    numbered = written(named.select(F.struct("*").alias("row")).repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("number", F.monotonically_increasing_id()), "numbered")
    bare = docs.filter(docs[id_col].isNull()).select(F.col(text_col).alias("text")).withColumn("number", F.lit(None).cast("long"))
    rows = numbered.select(F.col("row")[text_col].alias("text"), "number").unionByName(bare)
    groups = written(jaccard_groups(rows, width, percent, "number", "text").select("doc_id", "component_id"), "groups")
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("number"))
    return numbered.join(gone, "number", "left_anti").select("row.*").unionByName(docs.filter(docs[id_col].isNull()))
