"""Operator 10: packing token ids into sequences whose every window holds the target mixture."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm.arrays import ranges, text_bytes
from slatewise.llm.sharding import GROUP_ROWS, MOST_GROUPS, _key
from slatewise.llm.tokenization import Units, encode_lowered
from slatewise.session import workers_see, written

#: Bytes of text encoded at once in a task.
SLICE = 1 << 18
#: Tokens that a queue sends at once, where it divides the window.
QUANTUM = 256
#: Most queues, unless a call asks for others.
MOST_QUEUES = 4096
#: Quanta times queues that are compared at once in a task.
CHUNK = 1 << 18
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, deficit double"


class Schedule:
    """Deficit round-robin over source queues, in a form that can start at any window.

    A queue's account earns its weight per unit of time and pays one for each quantum that it sends; it sends as soon as it
    is owed half a quantum, so accounts stay within half a quantum of nothing, and are carried from window to
    window. Quantum k (from 0) of a queue thus goes at time (k + 1/2) / weight, ties by the order of queues, which makes
    the accounts after any number of quanta a function of that number alone. So each partition computes the deficits its
    first window starts with, and no partition waits for another. An empty queue earns nothing and
    the others share its places. Totals and places count quanta here.
    """

    def __init__(self, totals: np.ndarray, weights: np.ndarray):
        self.totals, self.weights = totals.astype(np.int64), weights.astype(np.float64)
        self.end = float(np.max(self.totals / self.weights, initial=0)) + 1

    def _served(self, t: np.ndarray) -> np.ndarray:
        """Quanta of each queue (columns) whose turn has come by each time (rows)."""
        t, k = t[:, None], np.floor(np.multiply.outer(t, self.weights) + 0.5)
        k -= (k - 0.5) / self.weights > t  # turns are at (k + 1/2) / weight as rounded, so ties stay ties
        k += (k + 0.5) / self.weights <= t
        return np.clip(k, 0, self.totals).astype(np.int64)

    def sent(self, places: np.ndarray) -> np.ndarray:
        """Tokens each queue (columns) has sent when so many places (rows) are filled."""
        places = np.asarray(places, np.int64)
        at, room = places / self.weights.sum(), (len(self.weights) + 2) / self.weights.sum()
        low, high = np.maximum(at - room, 0), at + room
        wide = (self._served(low).sum(1) > places) | (self._served(high).sum(1) < places)
        low[wide], high[wide] = 0, self.end
        for _ in range(200):
            open_ = np.flatnonzero((self._served(high) - self._served(low)).sum(1) > 1)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) / 2
            over = self._served(mid).sum(1) > places[open_]
            stuck = (mid <= low[open_]) | (mid >= high[open_])
            high[open_[over]], low[open_[~over]] = mid[over], mid[~over]
            if stuck.all():
                break
        a, b = self._served(low), self._served(high)
        before = np.cumsum(b - a, 1) - (b - a)  # turns at the same time go by the order of queues
        return a + np.clip((places - a.sum(1))[:, None] - before, 0, b - a)

    def places(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of quantum k of each queue among all quanta: how many go before it, by time and then by the order of queues.

        Each quantum is compared with every queue that sends any, some CHUNK at a time, and with no window in which its own queue sends nothing.
        """
        some = np.flatnonzero(self.totals)
        weights, totals = self.weights[some], self.totals[some]
        out = np.empty(len(k), np.int64)
        step = max(1, CHUNK // max(1, len(some)))
        for at in range(0, len(k), step):
            own = np.searchsorted(some, queue[at : at + step])[:, None]
            t = ((k[at : at + step] + 0.5) / self.weights[queue[at : at + step]])[:, None]
            n = np.floor(t * weights + 0.5)
            n -= (n - 0.5) / weights > t  # turns are at (k + 1/2) / weight as rounded, so ties stay ties
            n += (n + 0.5) / weights <= t
            n -= (np.arange(len(some)) >= own) & ((n - 0.5) / weights == t)  # a later queue's turn at the same time comes later
            out[at : at + step] = np.clip(n, 0, totals).sum(1)
        return out

    def sent_before(self, queue: np.ndarray, k: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many quanta of its queue go before place `first`, for quanta k that are at `place`, at or after it."""
        low, high = np.maximum(k - (place - first), 0), k.copy()
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo]) // 2
            after = self.places(queue[todo], mid) >= first[todo]
            high[todo[after]], low[todo[~after]] = mid[after], mid[~after] + 1
        return low


def _tokens(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units.of(path, lower=True)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE)) - 1)
                to = min(to, batch.num_rows)
                ids, counts = encode_lowered(units, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(units.kind).tobytes()
                bounds = np.concatenate([[0], np.cumsum(counts + 1)]) * units.kind.itemsize
                values = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(counts + 1), pa.array(values, pa.binary())], ["doc_id", "source", "n", "ids"])
                at = to

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {dict(docs.dtypes)[id_col]}, source string, n long, ids binary")


def packed_sequences(docs: DataFrame, *, tokenizer: str | None = None, window: int = 2048, quantum: int = QUANTUM, end_id: int = 1, weights: dict[str, float] | None = None, most_queues: int | None = MOST_QUEUES, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, deficit): one row per piece.

    A document is its ids and one end id. Each source is a queue of its documents in a seeded
    order. Every sequence of `window` places takes quanta of `quantum` tokens (or the largest divisor of the window below it)
    from the queues by deficit round-robin (`Schedule`) towards `weights` (a share per source; by default the corpus's own
    shares), so each sequence holds the target mixture to a quantum, and what it owes a source is carried into the next:
    `deficit` is the tokens that the piece's source was owed as its sequence began. What a queue holds beyond its whole quanta
    comes at the end, queue after queue; only the last sequence can be short. A document that doesn't fit goes on in the next
    place of its queue; every id lies in exactly one piece, and offsets in a sequence are gapless from 0.

    A null text is empty and yields its end id alone. A null source counts as the empty one. Sources
    missing from `weights` get a weight of one token in a million. With None for `most_queues` every source has a queue of its own, and the driver
    and each task hold a total of each; with a number, the sources beyond the largest share the last queue, which has their common weight.
    Repeated rows and null ids are packed row by row. Further columns of `docs` are ignored. An empty table gives an empty table.

    The ids are written once to the shared folder. Token totals are summed per run of each queue's
    order (one row per run), so a hot source is never sorted or summed in one task; the driver sees
    one total per queue.
    """
    spark = docs.sparkSession
    workers_see(spark)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = dict(docs.dtypes)[id_col]
    quantum = next(x for x in range(min(quantum, window), 0, -1) if window % x == 0)
    tokens = written(_tokens(docs, path, end_id, id_col, text_col, source_col), "packing-ids")
    key = _key(seed, "doc_id")
    total, all_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, min(MOST_GROUPS, total // GROUP_ROWS))
    largest = tokens.groupBy("source").agg(F.sum("n").alias("_n"))
    if most_queues is not None:
        largest = largest.orderBy(F.desc("_n"), "source").limit(most_queues - 1)
    largest = largest.collect()  # a total for each queue
    held = sorted((r["source"], r["_n"]) for r in largest)
    rest = all_tokens - sum(n for _, n in held)
    totals = np.array([n for _, n in held] + [rest] * (rest > 0), np.int64)
    shares = totals.astype(np.float64) if weights is None else np.array([weights.get(s, 0) for s, _ in held] + [0.0] * (rest > 0), np.float64)
    shares = np.maximum(shares, shares.sum() * 1e-6 if len(totals) else 0)
    queues = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(held)], "source string, queue int")
    queues = F.broadcast(queues) if most_queues is not None else queues  # most_queues rows
    rows = tokens.join(queues, "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(held))))
    rows = rows.withColumn("key", key % F.lit(1 << 30)).withColumn("part", F.floor(F.col("key") * groups / F.lit(1 << 30)).cast("long"))
    sums = rows.groupBy("queue", "part").agg(F.sum("n").alias("_n"))
    upto = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("queue", "part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    within = Window.partitionBy("queue", "part").orderBy("key", "doc_id", "n", "source", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["queue", "part"])
    placed = placed.select("doc_id", "source", "queue", "n", "ids", (F.col("_start") + F.col("_before")).alias("at"))
    width = 2 if Units.of(path, lower=True).kind.itemsize == 2 else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(totals // quantum, shares)
        for batch in batches:
            if not batch.num_rows:
                continue
            queue, n, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 5))
            ids = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in batch.column(4).to_pylist()]
            doc, *told = _pieces(plan, totals, queue, n, at, window, quantum)
            start, length = told[0], told[1]
            crc = np.fromiter((zlib.crc32(ids[d][4 * a : 4 * (a + k)]) for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *map(pa.array, (start, length, crc, n[doc], told[2], told[3])), batch.column(1).take(take), pa.array(told[4])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "deficit"])

    return placed.mapInArrow(cut, PIECES.format(id=kind))


def _pieces(plan: Schedule, totals: np.ndarray, queue: np.ndarray, n: np.ndarray, at: np.ndarray, window: int, quantum: int) -> tuple[np.ndarray, ...]:
    """Documents, given by their place in their queue, cut at the windows' borders: (document, start, length, sequence, offset, deficit)."""
    whole = plan.totals * quantum  # tokens of each queue that go by whole quanta
    per, quanta = window // quantum, int(plan.totals.sum())
    end = np.minimum(at + n, whole[queue])
    some = np.flatnonzero(end > at)
    k0 = at[some] // quantum
    count = (end[some] - 1) // quantum - k0 + 1
    doc, k = np.repeat(some, count), ranges(k0, count)
    place = plan.places(queue[doc], k)
    begin, stop = np.maximum(at[doc], k * quantum), np.minimum(end[doc], (k + 1) * quantum)
    # quanta of one document that stand side by side in a window are one piece
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (place[1:] % per == 0)
    last = np.append(first[1:], True)[: len(first)]
    doc, k, place, begin, stop = doc[first], k[first], place[first], begin[first], stop[last]
    q, seq = queue[doc], place // per
    offset = place % per * quantum + begin - k * quantum
    share = plan.weights / plan.weights.sum() if len(plan.weights) else plan.weights
    deficit = share[q] * (seq * window) - plan.sent_before(q, k, place, seq * per) * quantum
    # what is over of each queue stands one after another behind the whole quanta
    over = totals - whole
    place = quanta * quantum + np.cumsum(over) - over
    tail = np.flatnonzero(at + n > whole[queue])
    at_first = np.maximum(at[tail], whole[queue[tail]])
    from_ = place[queue[tail]] + at_first - whole[queue[tail]]
    to = from_ + at[tail] + n[tail] - at_first
    count = (to - 1) // window - from_ // window + 1
    t_seq = ranges(from_ // window, count)
    back = np.repeat(np.arange(len(tail)), count)
    t_begin, t_stop = np.maximum(from_[back], t_seq * window), np.minimum(to[back], (t_seq + 1) * window)
    t_doc = tail[back]
    t_start = t_begin - from_[back] + at_first[back] - at[t_doc]
    t_deficit = share[queue[t_doc]] * (t_seq * window) - whole[queue[t_doc]]
    return (
        np.concatenate([doc, t_doc]),
        np.concatenate([begin - at[doc], t_start]),
        np.concatenate([stop - begin, t_stop - t_begin]),
        np.concatenate([seq, t_seq]),
        np.concatenate([offset, t_begin - t_seq * window]),
        np.concatenate([deficit, t_deficit]),
    )
