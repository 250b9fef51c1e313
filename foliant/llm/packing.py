"""Problem 6: filling fixed-capacity containers with items of varying length.

Minimum bin slack.  Items are dealt to shards by a hash; only ids and lengths
move.  Within a shard a container opens with the longest item left, and a bitset
subset-sum dynamic program over a window of the lengths left picks the multiset
that comes closest to the capacity; the picks are read back from the layers of
the bitset.  Lengths are handled as counts, so equal items cost one entry.

Defined results: null texts and texts of no tokens are in no container; an item
longer than the capacity is split into full parts and a rest, and only then; an
equal length is taken in order of id; an empty table gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import VOCABULARY, with_sizes

#: Tokens of a shard, on average: many containers of any capacity, and a small part of a task's memory.
SHARD_TOKENS = 4_000_000
#: Kinds of containers; every item is dealt to each of them.
MOST_KINDS = 1000
#: Lengths, counting repeats, that one container's dynamic program looks at.
WINDOW = 48


def pack(lengths: list[int], capacity: int, window: int = WINDOW) -> list[list[int]]:
    """Containers as lists of lengths; every length is at most the capacity.

    The window holds lengths spread over all those left, short ones among them, since these close gaps.
    """
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    distinct = sorted(left)
    out: list[list[int]] = []

    def use(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            del left[n]
            del distinct[bisect_left(distinct, n)]

    while distinct:
        first = distinct[-1]
        use(first)
        chosen = [first]
        room = capacity - first
        if room and distinct and distinct[0] <= room:
            fit = bisect_left(distinct, room + 1)
            if distinct[fit - 1] == room:
                chosen.append(room)
                use(room)
                out.append(chosen)
                continue
            step = max(1, fit // window)
            picks: list[int] = []
            weight = 0
            for k in range(fit - 1, -1, -step):
                n = distinct[k]
                many = min(left[n], room // n, max(4, (2 * room - weight) // (n * max(1, k // step))))
                picks += [n] * many
                weight += n * many
                if len(picks) >= window and weight >= 2 * room:
                    break
            if step > 1:
                picks += [n for n in distinct[:8] if n not in picks]
            full, sums, layers = (1 << (room + 1)) - 1, 1, []
            target = 1 << room
            for n in picks:
                layers.append(sums)
                sums |= (sums << n) & full
                if sums & target:
                    break
            s = sums.bit_length() - 1
            for k in range(len(layers) - 1, -1, -1):
                if not layers[k] >> s & 1:  # the sum needs this length
                    chosen.append(picks[k])
                    s -= picks[k]
                    use(picks[k])
        out.append(chosen)
    return out


def parts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of an item's parts: one, unless it is longer than the capacity."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def assign(documents: DataFrame, capacities: DataFrame, path: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """pack_id, container, doc_id, part, token_start, n_tokens; container is unique within pack_id.

    The number of shards follows the total, so a shard's memory and time do not grow with the table.
    capacities has pack_id and capacity_tokens, a row for each kind of container.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    sized = cut(with_sizes(rows, path=path)).where("n_tokens > 0")
    total = sized.agg(F.sum(F.col("n_tokens").cast("bigint"))).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    kinds = capacities.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0").distinct()
    if kinds.limit(MOST_KINDS + 1).count() > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    items = sized.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")).crossJoin(F.broadcast(kinds))

    def one(key, table):
        import pyarrow as pa

        pack_id, capacity, shard = (k.as_py() for k in key)
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        lengths = []
        ids, ns = table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist()
        for doc, n in sorted(zip(ids, ns), key=lambda x: (x[0] is None, x[0] or 0), reverse=True):
            for p, (s, m) in enumerate(parts(n, capacity)):
                by_length.setdefault(m, []).append((doc, p, s))
                lengths.append(m)
        rows_: list[tuple] = []
        for c, chosen in enumerate(pack(lengths, capacity)):
            name = (shard << 40) + c
            for m in chosen:
                doc, p, s = by_length[m].pop()
                rows_.append((pack_id, name, doc, p, s, m))
        cols = list(zip(*rows_))
        kinds_ = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        names = ["pack_id", "container", "doc_id", "part", "token_start", "n_tokens"]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds_)], names=names)

    return items.groupBy("pack_id", "capacity", "shard").applyInArrow(one, "pack_id int, container bigint, doc_id bigint, part int, token_start int, n_tokens int")


def slack(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """pack_id, containers, items, split_items, used_share: how full the containers are."""
    kinds = F.broadcast(capacities.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")))
    each = assigned.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"), F.count_if(F.col("part") > 0).alias("later"))
    sums = each.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("later").alias("later_parts"), F.sum("used").alias("used"))
    return sums.join(kinds, "pack_id").select("pack_id", "containers", "items", "later_parts", (F.col("used") / (F.col("containers") * F.col("capacity"))).alias("used_share"))
