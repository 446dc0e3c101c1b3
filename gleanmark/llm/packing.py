"""Mixture-controlled packing: documents of several sources into windows of equal length, by deficit round-robin.

Every source is a queue of tokens, its documents one after the other, each ended by ``END``. A window's target gives
every queue its share, by default that of all tokens, so that each window looks like the whole mix; with other weights a
queue that runs out leaves its share to the others. What a queue got less than its targets so far is its deficit. The
queues of a window are visited in turn: one whose deficit is worth a piece of ``LEAST`` tokens (or ends its document)
is served that many, and what room is left goes to the largest deficits. Deficits carry over to the next window.

Windows are put into groups of ``GROUP``, each filled in one task. What lies before a group is known without filling it:
tokens of all queues have a common order by virtual time (the middle of a token's place over the queue's weight), and the
groups before hold the first tokens of that order. So a group starts with the deficits of all windows before it, and a
queue's tokens are dealt to groups by where they lie in their queue; long documents are cut there.

A queue's order is that of the table's splits; places are running sums inside a split, set off by one total for each
split and source. Ids move once, to their group. The sources with the most tokens, at most ``QUEUES`` - 1, have queues
of their own, and the others share one, as a window has no room for more shares.

The last window is made of sequences whose lengths are the powers of two that add up to the rest, so nothing is padded.

Null and empty texts are a lone ``END``; a null source is a source of its own. Repeated rows are packed each for itself,
and rows need no ids.
"""
from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanmark.llm import bpe
from gleanmark.session import materialize

WINDOW, GROUP, LEAST = 1024, 256, 64
END = 0
QUEUES = 1024
PIECE_BYTES = 1 << 22


class Encoder:
    """Ids of a text as the tokenizers library gives them; the merges run in the tiktoken library."""

    def __init__(self, spec: str, pattern: str) -> None:
        coder = bpe.Coder(spec)
        special = set(coder.special.values())
        ranks = {b: i for i, b in enumerate(coder.bytes_of) if b and i not in special}
        self.special = coder.special
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.core = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = len(coder.bytes_of)

    def _plain(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if not self.special or not any(s in text for s in self.special):
            return self._plain(text)
        return np.concatenate([np.array([self.special[part]], np.uint32) if part in self.special else self._plain(part)
                               for part in self.specials.split(text)])


_encoders: dict[str, Encoder] = {}


def encoder(spec: str, pattern: str) -> Encoder:
    """One encoder per process and file."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = Encoder(spec, pattern)
    return _encoders[spec]


class Shares:
    """How many tokens of every queue the first ``x`` tokens of the mix hold; a pure function of totals and weights."""

    def __init__(self, totals: list[int], weights: list[int] | None = None) -> None:
        self.totals, self.weights = totals, weights or [max(1, t) for t in totals]
        self.n, self.total = len(totals), sum(totals)
        # Between the times at which queues run out, the mix grows evenly: (time, tokens so far, weight from here on).
        left, self.times, self.sums, self.rates = sum(self.weights), [Fraction(0)], [Fraction(0)], []
        ends = sorted((Fraction(t, w), w) for t, w in zip(self.totals, self.weights, strict=True))
        for end, w in ends:
            self.rates.append(left)
            self.sums.append(self.sums[-1] + (end - self.times[-1]) * left)
            self.times.append(end)
            left -= w
        self.rates.append(max(left, 1))
        self.weight_array = np.array(self.weights, np.float64)
        self.total_array = np.array(self.totals, np.float64)
        self.at = lru_cache(maxsize=2048)(self._at)

    def time(self, x: int) -> Fraction:
        i = bisect_right(self.sums, x) - 1
        return self.times[i] + (x - self.sums[i]) / self.rates[i] if i < self.n else self.times[-1]

    def goals(self, x: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """Target tokens of some queues after each of ``x`` tokens of the mix."""
        times = np.array([float(self.time(int(v))) for v in x])
        return np.minimum(self.total_array[queues], times[:, None] * self.weight_array[queues])

    def tokens_until(self, queue: int, place: int) -> int:
        """About how long the mix is when token ``place`` of a queue comes."""
        t = Fraction(2 * place + 1, 2 * self.weights[queue])
        i = min(bisect_right(self.times, t) - 1, self.n)
        return int(self.sums[i] + (t - self.times[i]) * self.rates[i]) if i < self.n else self.total

    def _at(self, x: int) -> tuple[int, ...]:
        """Tokens of every queue among the first ``x`` by virtual time, exactly; equal times go by queue."""
        t = self.time(x)
        got = [min(n, int(t * w + Fraction(1, 2))) for n, w in zip(self.totals, self.weights, strict=True)]
        last = [(-Fraction(2 * g - 1, 2 * w), -q) for q, (g, w) in enumerate(zip(got, self.weights, strict=True)) if g]
        following = [(Fraction(2 * g + 1, 2 * w), q) for q, (g, w) in enumerate(zip(got, self.weights, strict=True))
                     if g < self.totals[q]]
        missing = x - sum(got)
        heap = following if missing > 0 else last
        heapq.heapify(heap)
        for _ in range(abs(missing)):
            _time, q = heapq.heappop(heap)
            if missing > 0:
                got[q] += 1
                if got[q] < self.totals[q]:
                    heapq.heappush(heap, (Fraction(2 * got[q] + 1, 2 * self.weights[q]), q))
            else:
                got[-q] -= 1
                if got[-q]:
                    heapq.heappush(heap, (-Fraction(2 * got[-q] - 1, 2 * self.weights[-q]), q))
        return tuple(got)


def sequences(tokens: int, window: int = WINDOW) -> list[int]:
    """Lengths of the sequences that hold ``tokens``: whole windows, then the powers of two of the rest."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def fill(sizes: list[int], queues: list[list[int]], shares: Shares, before: int, least: int = LEAST) -> list[tuple]:
    """Pieces (sequence, offset, queue, document, start, length) that fill sequences of the given sizes.

    ``queues``: for every queue the lengths of its documents' parts in order; together they are as long as all sequences.
    ``before``: length of the mix before the first sequence. ``start`` counts from the start of a part.
    """
    out: list[list[int]] = []
    # Queues that hold tokens; for each its deficit against the last goal, what is left, the part at its head and how
    # much of that went already.
    names = [q for q, parts in enumerate(queues) if parts]
    lengths = [queues[q] for q in names]
    left = [sum(parts) for parts in lengths]
    head, gone = [0] * len(names), [0] * len(names)
    held = np.array(names, np.int64)
    goals = shares.goals(before + np.cumsum([0, *sizes]), held)
    deficit = (goals[0] - np.array(shares.at(before), np.float64)[held]).tolist()
    growth = np.diff(goals, axis=0)

    def serve(k: int, tokens: int, sequence: int, offset: int) -> None:
        deficit[k] -= tokens
        left[k] -= tokens
        parts, i, start = lengths[k], head[k], gone[k]
        piece = out[-1] if out else None
        if piece and piece[0] == sequence and piece[2] == names[k] and piece[3] == i and start:
            m = min(parts[i] - start, tokens)
            piece[5] += m
            start += m
            offset += m
            tokens -= m
        while tokens:
            if start == parts[i]:
                i, start = i + 1, 0
            m = min(parts[i] - start, tokens)
            out.append([sequence, offset, names[k], i, start, m])
            start += m
            offset += m
            tokens -= m
        if start == parts[i]:
            i, start = i + 1, 0
        head[k], gone[k] = i, start

    for sequence, size in enumerate(sizes):
        room = size
        for k, more in enumerate(growth[sequence].tolist()):
            deficit[k] += more
        turn = sequence % len(names)
        for k in [*range(turn, len(names)), *range(turn)]:
            take = min(int(deficit[k]), left[k], room)
            if take >= least or take > 0 and take >= lengths[k][head[k]] - gone[k]:
                serve(k, take, sequence, size - room)
                room -= take
        while room:
            _most, k = max((deficit[k], -k) for k in range(len(names)) if left[k])
            take = min(room, left[-k], max(least, int(deficit[-k])))
            serve(-k, take, sequence, size - room)
            room -= take
    return [tuple(p) for p in out]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """source, doc_id, chunk, place, n and ids of every document; written once.

    ``chunk`` is the number of the split, ``place`` the number of the source's tokens before the document in it. ids are
    little-endian integers of two bytes, or four for a vocabulary of more than 65,536.
    """
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(path))
    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = f"source {types['source'].simpleString()}, doc_id {types['doc_id'].simpleString()}, " \
             "chunk int, place bigint, n bigint, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(spec.value, pattern)
        kind = np.dtype("<u2") if coder.size <= 1 << 16 else np.dtype("<u4")
        chunk = TaskContext.get().partitionId()
        places: dict = {}
        for batch in batches:
            sources = batch.column(0).to_pylist()
            begin, size = 0, 0
            place, n, ids = [], [], []

            def rows(begin: int, end: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin),
                     pa.array(np.full(end - begin, chunk, np.int32)), pa.array(place, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(ids, pa.binary())], ["source", "doc_id", "chunk", "place", "n", "ids"])

            for i, text in enumerate(batch.column(2)):
                found = coder.encode(text.as_py() or "").astype(kind)
                place.append(places.get(sources[i], 0))
                n.append(len(found) + 1)
                ids.append(found.tobytes() + END.to_bytes(kind.itemsize, "little"))
                places[sources[i]] = place[-1] + n[-1]
                size += len(ids[-1])
                if size >= PIECE_BYTES:
                    yield rows(begin, i + 1)
                    begin, size = i + 1, 0
                    place, n, ids = [], [], []
            if place:
                yield rows(begin, len(sources))

    return materialize(docs.select("source", "doc_id", "text").mapInArrow(encode, schema), "pack-ids")


def queued(rows: DataFrame, queues: int = QUEUES) -> tuple[DataFrame, DataFrame]:
    """``rows`` with queue and start (place in the queue), and (queue, source, total) of every source.

    Window functions see one row for each source, or for each split and source.
    """
    per_chunk = materialize(rows.groupBy("source", "chunk").agg(F.sum("n").alias("tokens")), "pack-chunks")
    totals = per_chunk.groupBy("source").agg(F.sum("tokens").alias("total"))
    by_size = Window.orderBy(F.desc("total"), F.col("source").asc_nulls_last())
    named = materialize(
        totals.withColumn("queue", F.least(F.row_number().over(by_size) - 1, F.lit(queues - 1)).cast("int")), "pack-queues")
    of = named.select(F.col("source").alias("s"), "queue")
    before = Window.partitionBy("queue").orderBy("chunk", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.join(of, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    offsets = materialize(offsets, "pack-offsets")
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return placed.withColumn("start", F.col("place") + F.col("offset")).drop("s", "c", "place", "offset", "chunk"), named


def dealt(placed: DataFrame, shares: Shares, window: int, group: int) -> DataFrame:
    """Parts of documents by the group of windows that they lie in."""
    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = (f"group bigint, queue int, start bigint, source {fields['source']}, doc_id {fields['doc_id']}, "
              "from bigint, doc_tokens bigint, ids binary")
    known = placed.sparkSession.sparkContext.broadcast((shares.totals, shares.weights))
    names = ["group", "queue", "start", "source", "doc_id", "from", "doc_tokens", "ids"]
    span = window * group

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = Shares(*known.value)
        for batch in batches:
            rows, parts, held = [], [], 0

            def out() -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[j] for r in rows], t) for j, t in (
                    (1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64()))]
                group_, queue_, start_, from_, tokens_ = columns
                return pa.RecordBatch.from_arrays(
                    [group_, queue_, start_, batch.column(0).take(at), batch.column(1).take(at), from_, tokens_,
                     pa.array(parts, pa.binary())], names)

            queue, start, n, ids = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            for i in range(batch.num_rows):
                width, done = len(ids[i]) // n[i], 0
                g = max(0, shares.tokens_until(queue[i], start[i]) // span - 1)
                while done < n[i]:
                    place = start[i] + done
                    while shares.at(min(shares.total, (g + 1) * span))[queue[i]] <= place:
                        g += 1
                    while g and shares.at(g * span)[queue[i]] > place:
                        g -= 1
                    end = min(n[i], shares.at(min(shares.total, (g + 1) * span))[queue[i]] - start[i])
                    rows.append((i, g, queue[i], place, done, n[i]))
                    parts.append(ids[i][done * width : end * width])
                    held += (end - done) * width
                    done = end
                    if held >= PIECE_BYTES:
                        yield out()
                        rows, parts, held = [], [], 0
            if rows:
                yield out()

    return placed.select("source", "doc_id", "queue", "start", "n", "ids").mapInArrow(deal, schema)


def pack(docs: DataFrame, path: str, pattern: str, weights: dict[str | None, int] | None = None,
         window: int = WINDOW, group: int = GROUP, least: int = LEAST) -> DataFrame:
    """doc_id, source, start, length, ids, doc_tokens, sequence_id and offset of every piece of ``docs``
    (doc_id, source, text).

    ids are the piece's tokens as little-endian 32-bit integers. ``weights`` gives the target proportions of sources,
    where not their shares of all tokens; sources that share a queue are weighed by their tokens.
    """
    placed, named = queued(encoded(docs, path, pattern))
    per_queue = named.groupBy("queue").agg(F.sum("total").alias("total"), F.min(F.struct("source")).alias("s"), F.count("*").alias("n"))
    totals, asked = [], []
    for row in per_queue.orderBy("queue").toLocalIterator():        # at most QUEUES rows
        totals.append(row.total)
        asked.append(weights.get(row.s.source, 1) if weights and row.n == 1 else row.total)
    shares = Shares(totals, asked if weights else None)
    known = docs.sparkSession.sparkContext.broadcast((shares.totals, shares.weights))
    parts = dealt(placed, shares, window, group)
    fields = {f.name: f.dataType.simpleString() for f in parts.schema.fields}

    def filled(table: pa.Table) -> pa.Table:
        shares = Shares(*known.value)
        table = table.sort_by([("queue", "ascending"), ("start", "ascending")])
        number = table.column("group")[0].as_py()
        queue, ids = table.column("queue").to_numpy(), table.column("ids").to_pylist()
        from_, tokens = table.column("from").to_numpy(), table.column("doc_tokens").to_numpy()
        before = number * window * group
        length = min(shares.total, before + window * group) - before
        first = np.searchsorted(queue, np.arange(shares.n + 1))
        width = 2 if all(len(i) % 2 == 0 for i in ids) and sum(map(len, ids)) == 2 * length else 4
        queues = [[len(ids[i]) // width for i in range(first[q], first[q + 1])] for q in range(shares.n)]
        assert sum(map(sum, queues)) == length
        pieces = fill(sequences(length, window), queues, shares, before, least)
        sequence, offset, of, part, start, size = np.array(pieces, np.int64).T
        row = first[of] + part
        begin = np.cumsum([0, *map(len, ids)])[row] // width + start
        at = np.arange(length) + np.repeat(begin - np.cumsum(size) + size, size)
        tokens_ = np.frombuffer(b"".join(ids), f"<u{width}")[at].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(tokens_.tobytes())])
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(row)), "source": table.column("source").take(pa.array(row)),
            "start": pa.array(from_[row] + start), "length": pa.array(size), "ids": cut,
            "doc_tokens": pa.array(tokens[row]), "sequence_id": pa.array(number * group + sequence),
            "offset": pa.array(offset),
        })

    return parts.groupBy("group").applyInArrow(
        filled, f"doc_id {fields['doc_id']}, source {fields['source']}, start bigint, length bigint, ids binary, "
                "doc_tokens bigint, sequence_id bigint, offset bigint")
