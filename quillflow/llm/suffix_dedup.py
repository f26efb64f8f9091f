"""Remove passages of 50 bytes and more that an earlier document has, by suffix arrays.

1. Texts are laid out in blocks of some megabytes, staged as one row each with their anchors. Winnowing
   picks anchors: of every 27 consecutive 24-byte grams, the one of least hash. Any shared 50-byte
   string picks the same anchors, so strings shared by two documents share an anchor.
2. A whole text that an earlier document has too goes whole, and takes no part in what follows: blocks
   send digests to buckets, and are told each text's least document. Then each block sends its distinct
   anchors to buckets by hash; a bucket finds which occur in two documents and tells the blocks.
3. Around each shared anchor, a block cuts out the snippet that holds every 50-byte string with that
   anchor. Equal snippets of a block count once, under its least document; the others are removed
   on the spot. Snippets go to shards by anchor.
4. A shard builds suffix arrays over its distinct snippets by Larsson-Sadakane refinement, as deep as 50
   bytes, and so gets the least document of every 50-byte string: equal ones have one rank. Shards too
   large for one array are several, cut between anchors; where the snippets of one anchor alone are too
   many, its arrays are merged by binary search of each one's strings in the others.
5. The strings' extents go back to the blocks, which cut them out of the texts.

Anchors only say where to look; what is removed is decided on the bytes themselves, but for copies of
whole texts, which go by digests of 128 bits. A passage that a third of all documents share is one anchor
entry and one snippet in each block, and a copy one digest. At a passage's
edges each document has a snippet of its own: an anchor of more than HOT_BLOCKS blocks or HOT_PLACES
places is not gathered in one shard; each block sorts the strings around it with its own suffix array, and the
sorted runs are merged by binary search in buckets by string.

A text's bytes lie in one task, with about five times as many for the snippets of its anchors, which
are at most one in seven bytes, in periodic text too. Messages between blocks and buckets grow with
their product up to one for each anchor; there are as many shards as the snippets to be sent need.

Nulls and edges: a null text counts as empty. Texts under 50 bytes lose nothing. A null doc_id is
later than any other. Rows that share a doc_id don't cut each other. An empty table gives an empty
result. The remaining bytes of a text may cut a character; the text column drops such pieces of
characters, while the digest is over the bytes. Other columns are ignored but for strings that keep
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64, plan_bytes, slices, small_batches, staged, staged_by, text_buffer, trimmed

#: Bytes of a repeated string; of an anchor's gram; and grams among which an anchor is least.
LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes on either side of an anchor that strings with it may reach.
REACH = LENGTH - GRAM
SNIPPET = 2 * REACH + GRAM
BLOCK_BYTES = 4 << 20
#: Bits of an anchor's hash; a chance match only makes more snippets to compare.
HASH_BITS = 48
#: Bytes that anchors are sought in at once.
STRETCH = 1 << 16
#: Bytes of text for each bucket of anchors, and for each bucket of whole texts' digests.
ANCHOR_BYTES, COPY_BYTES = 24 << 20, 64 << 20
#: Snippets of each shard, if all that are cut out were sent and a hot one counts as its strings; and least bytes of text for each shard.
SHARD_SNIPPETS, SHARD_BYTES = 200_000, 6 << 20
#: Bytes of a whole text's digest.
DIGEST = 16
#: Input bytes for each part of the blocks' table, which is read block by block.
PART_BYTES = 8 << 20
#: Tasks that buckets are dealt to at most.
MOST_TASKS = 20_000
#: Blocks, or places, above which an anchor's snippets are compared string by string.
HOT_BLOCKS, HOT_PLACES = 256, 16_000
#: Distinct snippets of one suffix array, and of one for several anchors, which is quicker while it is small.
ARRAY_SNIPPETS, SEVERAL_SNIPPETS = 8_000, 2_000
_NO_ID = np.iinfo(np.int64).max


# ---- blocks and anchors


def lay_out(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """block, size (of its texts), ids (as places in order), shown (as they are), bounds, data (compressed), its anchors (number, and places compressed), digests of its texts, and kept: a list for each kept string column. docs: doc_id, text, keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_BYTES):
                data, bounds = text_buffer(rows.column("text"))
                ids = rows.column("doc_id")
                none = ids.is_null().to_numpy(zero_copy_only=False)
                # a null comes last of all, one place after the largest id; the two least ids there are share a place
                ids = np.where(none, _NO_ID, np.maximum(ids.fill_null(0).to_numpy(), np.iinfo(np.int64).min + 1) - 1)
                at, raw = anchor_places(data, bounds), data.tobytes()
                yield pa.record_batch({"block": [block], "size": [len(data)], "ids": [ids.astype("<i8").tobytes()], "shown": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), "bounds": [bounds.astype("<i8").tobytes()], "data": pa.array([_squeezed(raw)], pa.binary()), "anchors": [len(at)], "places": pa.array([_squeezed(_planes(np.diff(at, prepend=0)))], pa.binary()), "digests": pa.array([_digests(raw, bounds)], pa.binary()), "kept": pa.array([[rows.column(c).to_pylist() for c in keep]], pa.list_(pa.list_(pa.string())))})
                block += 1

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).cast("string") for c in keep])
    return rows.mapInArrow(trimmed(run), "block long, size long, ids binary, shown array<long>, bounds binary, data binary, anchors long, places binary, digests binary, kept array<array<string>>")


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each window of width values."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    wide = {}
    for power, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93)):
        h = h[:-power] * np.uint64(factor) + h[power:]
        width = 2 * power
        h ^= h >> np.uint64(29)
        wide[width] = h
    return mix64(wide[16][: len(wide[8]) - 16] * np.uint64(0xBF58476D1CE4E5B9) + wide[8][16:])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all texts, in order."""
    at = anchor_places(data, bounds)
    return at, anchor_hashes(data, at)


def anchor_places(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(_anchors(data, bounds, a, min(len(data), a + STRETCH)) for a in range(0, len(data), STRETCH))])


def anchor_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    if not len(at):
        return np.empty(0, np.uint64)
    return _row_hash(np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]) >> np.uint64(64 - HASH_BITS)


def _anchors(data: np.ndarray, bounds: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Those from start to stop, seen with as much on either side as their windows need."""
    lo, hi = max(0, start - WINDOW), min(len(data), stop + LENGTH)
    if hi - lo < LENGTH:
        return np.empty(0, np.int64)
    h = gram_hashes(data[lo:hi])
    least = _slide(h, WINDOW, np.minimum)
    # windows that start where LENGTH bytes of one text follow
    ends = np.unique(bounds[slice(*np.searchsorted(bounds, [lo + 1, hi]))])
    late = (ends[:, None] - np.arange(1, LENGTH)).ravel() - lo
    least[late[(late >= 0) & (late < len(least))]] = 0
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, WINDOW, np.maximum) == h)
    at = at[(at >= start - lo) & (at < stop - lo)]
    return _spaced(at, h, np.searchsorted(bounds, at + lo, side="right")) + lo


def _spaced(at: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of equal grams that are least together, as in periodic text, enough that every window keeps one.

    Which one is kept doesn't matter: any of them reaches every string that holds another beside it.
    """
    if len(at) < 3:
        return at
    head = np.concatenate([[True], (h[at[1:]] != h[at[:-1]]) | (row[1:] != row[:-1]) | (at[1:] - at[:-1] >= WINDOW)])
    origin = at[head][np.cumsum(head) - 1]
    cell = (at - origin) // (WINDOW // 2)
    first = head | np.concatenate([[True], cell[1:] != cell[:-1]])
    last = np.append(first[1:], True)  # of its cell: the next cell's first may be too far from this one's
    apart = np.append(at[first][1:], np.iinfo(np.int64).max)[np.cumsum(first) - 1] - at[first][np.cumsum(first) - 1] > WINDOW
    return at[first | last & apart | np.append(head[1:], True)]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _expanded(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _planes(x: np.ndarray) -> bytes:
    """64-bit values as byte planes, which compress where high bytes repeat."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bounds = np.frombuffer(row["bounds"], "<i8")
    return np.frombuffer(row["ids"], "<i8"), bounds, np.frombuffer(_expanded(row["data"], int(bounds[-1])), np.uint8)


def _read_anchors(row: dict, data: np.ndarray, bounds: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and texts of a block's anchors, without those of later copies."""
    at = np.cumsum(_from_planes(_expanded(row["places"], 8 * row["anchors"])).view(np.int64))
    text = np.searchsorted(bounds, at, side="right") - 1
    own = ~later[text]
    return at[own], anchor_hashes(data, at[own]), text[own]


# ---- copies of whole texts


def _digests(raw: bytes, bounds: np.ndarray) -> bytes:
    cuts = bounds.tolist()
    return b"".join(hashlib.blake2b(raw[a:b], digest_size=DIGEST).digest() for a, b in zip(cuts[:-1], cuts[1:]))


def _by_digest(digests: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of digest and id, where another digest begins, and each one's number in that order. digests: two columns."""
    order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    head = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]) if len(order) else np.empty(0, bool)
    return order, np.flatnonzero(head), np.cumsum(head) - 1


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct texts of LENGTH bytes and more: digests in order, least ids; then the rows of such texts, and each one's place among the distinct."""
    ids, bounds = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["bounds"], "<i8")
    rows = np.flatnonzero(np.diff(bounds) >= LENGTH)
    digests = np.frombuffer(row["digests"], ">u8").reshape(-1, 2)[rows].astype(np.uint64)
    order, starts, number = _by_digest(digests, ids[rows])
    return digests[order[starts]], ids[rows[order[starts]]], rows[order], number


def copies(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket (-1 and below), flags: the least document of each of the block's distinct texts in the bucket, in order of digest; hot: none."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digests, least, _, _ = _texts(row)
                cuts = np.searchsorted((digests[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.record_batch({"bucket": full.astype(np.int32), "block": np.full(len(full), row["block"]), "digests": pa.array([digests[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), "least": pa.array([least[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())})

    def find(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<i8") for x in table.column("least").to_pylist()]
        ids = np.concatenate(parts)
        order, starts, number = _by_digest(np.frombuffer(b"".join(table.column("digests").to_pylist()), "<u8").reshape(-1, 2), ids)
        least = np.empty_like(ids)
        least[order] = ids[order[starts]][number]
        told = np.split(least, np.cumsum([len(x) for x in parts])[:-1])
        bucket = pa.array(-1 - table.column("bucket").to_numpy(), pa.int32())
        return pa.table({"block": table.column("block"), "bucket": bucket, "flags": pa.array([x.tobytes() for x in told], pa.binary()), "hot": pa.nulls(len(told), pa.binary()), "places": pa.array(np.zeros(len(told), np.int64))})

    sent = blocks.select("block", "ids", "bounds", "digests").mapInArrow(trimmed(send), "bucket int, block long, digests binary, least binary")
    return sent.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(find, TOLD)


#: What buckets tell blocks.
TOLD = "block long, bucket int, flags binary, hot binary, places long"


def _later(row: dict, told: pa.Table) -> np.ndarray:
    """Which of a block's texts are copies of an earlier document's: such a text goes whole, and nothing in it is the first of its kind."""
    later = np.zeros(len(row["ids"]) // 8, bool)
    told = told.filter(pc.less(told.column("bucket"), 0)).sort_by([("bucket", "descending")])
    if told.num_rows:
        least = np.frombuffer(b"".join(told.column("flags").to_pylist()), "<i8")
        _, _, rows, number = _texts(row)
        later[rows] = np.frombuffer(row["ids"], "<i8")[rows] > least[number]
    return later


# ---- anchors of several documents


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, whether each occurs in two documents, and in how many places (as many as two bytes hold)."""
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    places = np.minimum(np.diff(np.append(cut, len(h))), np.iinfo(np.uint16).max).astype("<u2")
    return h[cut], np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut) if len(cut) else np.empty(0, bool), places


#: What a block needs to go through its anchors.
_PARTS = ["block", "ids", "bounds", "data", "anchors", "places", "digests"]


def shared_anchors(blocks: DataFrame, same: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, and packed bits, in order of hash, for the block's distinct anchors in the bucket. same: copies, which send none.

    flags: those that two documents have; places: the entries that these make at most, a snippet or a hot one's strings; hot: those in more than HOT_BLOCKS blocks or HOT_PLACES places.
    """

    most_blocks, most_places = HOT_BLOCKS, HOT_PLACES

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            ids, bounds, data = _read(row)
            _, h, text = _read_anchors(row, data, bounds, _later(row, right))
            h, twice, places = _distinct(h, ids[text])
            cuts = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            rows += [(b, row["block"], _planes(np.diff(h[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))), np.packbits(twice[cuts[b] : cuts[b + 1]]).tobytes(), places[cuts[b] : cuts[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cuts)).tolist()]
        cols = list(zip(*rows)) if rows else [[], [], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "block", "hashes", "twice", "places"])

    def find(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(_from_planes(x), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in parts])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("twice").to_pylist(), sizes)]).astype(bool)
        places = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("places").to_pylist()])
        every = np.concatenate(parts)
        order = np.argsort(every)
        ranked = every[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        blocks_ = np.diff(np.append(starts, len(ranked)))
        shared = (blocks_ > 1) | np.logical_or.reduceat(twice[order], starts)
        many = (blocks_ > most_blocks) | (np.add.reduceat(places[order].astype(np.int64), starts) > most_places)
        flags, hot = np.empty(len(every), bool), np.empty(len(every), bool)
        flags[order], hot[order] = np.repeat(shared, blocks_), np.repeat(many, blocks_)
        cuts = np.cumsum(sizes)[:-1]
        split = lambda x: pa.array([np.packbits(y).tobytes() for y in np.split(x, cuts)], pa.binary())
        told = np.add.reduceat(places.astype(np.int64) * flags * np.where(hot, SNIPPET - LENGTH + 1, 1), np.concatenate([[0], cuts]))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": split(flags), "hot": split(hot), "places": told})

    sent = blocks.select(*_PARTS).groupBy("block").cogroup(same.groupBy("block")).applyInArrow(send, "bucket int, block long, hashes binary, twice binary, places binary")
    sent = sent.repartition(min(buckets, MOST_TASKS), "bucket")
    return sent.groupBy("bucket").applyInArrow(find, TOLD)


# ---- snippets


def snippets(blocks: DataFrame, told: DataFrame, buckets: int, shards: int) -> DataFrame:
    """bucket (a shard), block, and per distinct snippet: hash, document, place, extent, bytes; and what the block itself removes.

    told: flags of anchors in so many buckets, and copies. Rows of buckets below 0 hold the removals (start, stop) that a block decides alone.
    """

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _packed([])
        row = left.to_pylist()[0]
        ids, bounds, data = _read(row)
        later = _later(row, right)
        rows = []
        if later.any():
            spans = np.stack([bounds[:-1][later], bounds[1:][later]], axis=1).astype("<i8")
            rows.append((-1 - row["block"] % shards, row["block"], len(spans), spans.tobytes(), b""))
        at, h, text = _read_anchors(row, data, bounds, later)
        if not len(at):
            return _packed(rows)
        order = np.argsort(h)
        ranked = h[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        sizes = np.bincount(_bucket(ranked[first], buckets), minlength=buckets)
        told = right.filter(pc.greater_equal(right.column("bucket"), 0)).sort_by("bucket")
        flag, often = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(told.column(c).to_pylist(), sizes[sizes > 0])]).astype(bool)[np.cumsum(first) - 1] for c in ("flags", "hot"))
        chosen = np.sort(order[flag & ~often])
        if (flag & often).any():
            rows += _hot_strings(row["block"], ids, bounds, data, np.sort(at[order[flag & often]]), shards)
        if not len(chosen):
            return _packed(rows)
        at, h, doc = at[chosen], h[chosen], text[chosen]
        start, stop = np.maximum(at - REACH, bounds[doc]), np.minimum(at + GRAM + REACH, bounds[doc + 1])
        padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(REACH, np.uint8)])
        text = np.lib.stride_tricks.sliding_window_view(padded, SNIPPET)[at]
        edge = np.flatnonzero(stop - start < SNIPPET)
        column = np.arange(SNIPPET)
        text[edge] *= (column >= (start - at + REACH)[edge, None]) & (column < (stop - at + REACH)[edge, None])
        print_ = _row_hash(text) ^ h ^ ((at - start).astype(np.uint64) << np.uint64(8)) ^ (stop - at).astype(np.uint64)
        order = np.lexsort((at, ids[doc], print_))
        lead = np.concatenate([[True], print_[order][1:] != print_[order][:-1]])
        leader = order[lead][np.cumsum(lead) - 1]
        same = (text[order] == text[leader]).all(axis=1) & (h[order] == h[leader]) & ((at - start)[order] == (at - start)[leader]) & ((stop - at)[order] == (stop - at)[leader])
        later = same & (ids[doc[order]] > ids[doc[leader]])
        gone = order[later]
        # equal snippets of the leader's own document stand or fall with it, each in its place
        kept = np.sort(order[~later])
        b = _bucket(h[kept], shards)
        kept = kept[np.argsort(b, kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=shards))])
        if len(gone):
            whole = (stop - start)[gone] >= LENGTH
            spans = np.stack([start[gone], stop[gone]], axis=1)[whole].astype("<i8")
            rows.append((-1 - row["block"] % shards, row["block"], len(spans), spans.tobytes(), b""))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = kept[cuts[k] : cuts[k + 1]]
            head = np.concatenate([h[own].view(np.int64), ids[doc[own]], at[own], start[own], stop[own]])
            rows.append((k, row["block"], len(own), _squeezed(_planes(head)), _squeezed(text[own].tobytes())))
        return _packed(rows)

    return blocks.select(*_PARTS).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut, "bucket int, block long, n long, head binary, body binary")


def _hot_strings(block: int, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, at: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """Rows for the snippets of anchors that very many blocks have: their strings one by one, each once a block.

    Such an anchor may have a snippet for each document, all different by what stands beside a common
    passage. Its strings go to buckets (from buckets on) by their own hash, so that a common string is one
    entry for each block and the others are spread. Later documents' are removed on the spot.
    """
    rows = []
    width = np.concatenate([data, np.zeros(SNIPPET, np.uint8)])
    for a in range(0, len(at), ARRAY_SNIPPETS):
        some = at[a : a + ARRAY_SNIPPETS]
        doc = np.searchsorted(bounds, some, side="right") - 1
        start, stop = np.maximum(some - REACH, bounds[doc]), np.minimum(some + GRAM + REACH, bounds[doc + 1])
        text = np.lib.stride_tricks.sliding_window_view(width, SNIPPET)[start]
        text[np.arange(SNIPPET) >= (stop - start)[:, None]] = 0
        found = Strings(text, stop - start, ids[doc])
        if not len(found.strings):
            continue
        place, own = start[found.row] + found.offset, ids[doc[found.row]]
        later = own > found.least[found.run]
        if later.any():
            spans = np.stack([place[later], place[later] + LENGTH], axis=1).astype("<i8")
            rows.append((-1 - block % buckets, block, len(spans), spans.tobytes(), b""))
        run, place = found.run[~later], place[~later]  # runs ascend
        bytes_ = np.frombuffer(found.strings.tobytes(), np.uint8).reshape(-1, LENGTH)
        bucket = (_row_hash(bytes_) % np.uint64(buckets)).astype(np.int64)
        n = np.bincount(run, minlength=len(found.strings))
        by, by_place = np.argsort(bucket, kind="stable"), np.argsort(bucket[run], kind="stable")
        cuts, cuts_place = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=buckets))]) for x in (bucket, bucket[run]))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            which, mine = by[cuts[k] : cuts[k + 1]], place[by_place[cuts_place[k] : cuts_place[k + 1]]]
            head = np.concatenate([found.least[which], n[which], mine]).astype("<i8")
            rows.append((buckets + k, block, len(which), head.tobytes(), _squeezed(bytes_[which].tobytes())))
    return rows


def _packed(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "n", "head", "body"])


def _row_hash(text: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    wide[:, : text.shape[1]] = text
    h = np.zeros(len(text), np.uint64)
    for k in range(wide.shape[1] // 8):
        h = mix64(h ^ np.ascontiguousarray(wide[:, 8 * k : 8 * k + 8]).view(np.uint64)[:, 0])
    return h


# ---- suffix arrays


def _ranks(symbols: np.ndarray, depth: int, room: np.ndarray | None = None) -> np.ndarray:
    """Suffixes' ranks by their first depth symbols, equal ones alike: Larsson-Sadakane refinement of unsettled groups by doubling.

    room: the symbols that each suffix may use; those with fewer than depth get no rank that counts.
    """
    n = len(symbols)
    width, key = 1, symbols.astype(np.uint64)
    bits = max(1, int(symbols.max(initial=1)).bit_length())
    while width * 2 * bits <= 64 and width * 2 <= depth:  # the first order takes as many symbols as a word holds
        later = np.zeros(n, np.uint64)
        later[: n - width] = key[width:] if n > width else 0
        key = key << np.uint64(width * bits) | later
        width *= 2
    place = np.full(n + 1, -1, np.int64)  # each suffix's group: the group's last position
    open_ = np.arange(n) if room is None else np.flatnonzero(room >= width)
    order = np.argsort(key[open_])
    open_ = open_[order]
    starts, count = _runs(key[open_])
    place[open_] = np.repeat(starts + count - 1, count)
    open_ = open_[np.repeat(count > 1, count)]
    while width < depth and len(open_):
        step = min(width, depth - width)
        width += step
        if room is not None:
            open_ = open_[room[open_] >= width]
        group = place[open_]
        key = group * np.int64(n + 1) + place[open_ + step if room is not None else np.minimum(open_ + step, n)] + 1
        order, key = _sorted(key, (n + 1) ** 2)
        open_ = open_[order]
        starts, count = _runs(group)
        last = np.repeat(starts + count - 1, count)
        starts, count = _runs(key)
        place[open_] = group - (last - np.repeat(starts + count - 1, count))
        open_ = open_[np.repeat(count > 1, count)]
    return place[:n]


def _sorted(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and sorted keys, which are from 0 to below most."""
    bits = max(1, len(key).bit_length())
    if (most << bits) < 1 << 63:  # places ride along in the low bits: values sort faster than places
        both = np.sort(key << np.int64(bits) | np.arange(len(key)))
        return both & np.int64((1 << bits) - 1), both >> np.int64(bits)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(ranked)))


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth symbols."""
    return _sorted(_ranks(symbols, depth), len(symbols))[0]


def common_prefixes(text: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, within their snippets (Kasai).

    All snippets (rows of text) are gone through side by side: from one suffix to the next of the
    same snippet, the common prefix falls by one at most.
    """
    rows, width = text.shape
    rank = np.empty(rows * width, np.int64)
    rank[order] = np.arange(len(order))
    flat = np.concatenate([text.ravel(), np.zeros(width, text.dtype)])
    end = np.repeat(np.arange(rows) * width + size, width)
    found, h = np.zeros(len(order), np.int64), np.zeros(rows, np.int64)
    base = np.arange(rows) * width
    for t in range(width):
        here = base + t
        r = rank[here]
        live = np.flatnonzero((t < size) & (r > 0))
        before = order[r[live] - 1]
        most = np.minimum(end[here[live]] - here[live], end[before] - before)
        x = np.minimum(np.maximum(h[live] - 1, 0), np.maximum(most, 0))
        going = np.flatnonzero(x < most)
        while len(going):
            same = flat[here[live[going]] + x[going]] == flat[before[going] + x[going]]
            going = going[same]
            x[going] += 1
            going = going[x[going] < most[going]]
        h[:] = 0
        h[live] = x
        found[r[live]] = x
    return found


class Strings:
    """All distinct LENGTH-byte strings of some snippets in order, with the least document of each, by a suffix array as deep as these."""

    def __init__(self, text: np.ndarray, size: np.ndarray, doc: np.ndarray):
        width = text.shape[1]
        # strings end within their snippets, so that what follows a snippet is never looked at
        room = (size[:, None] - np.arange(width)).ravel()
        rank = _ranks(text.ravel(), LENGTH, room)
        at = np.flatnonzero(room >= LENGTH)
        order, rank = _sorted(rank[at], len(rank))
        at = at[order]
        starts, count = _runs(rank)
        self.run = np.repeat(np.arange(len(starts)), count)
        self.row, self.offset = at // width, at % width
        self.least = np.minimum.reduceat(doc[self.row], starts) if len(at) else np.empty(0, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(text, LENGTH, axis=1)
        self.strings = np.ascontiguousarray(view[self.row[starts], self.offset[starts]]).view(f"S{LENGTH}").ravel() if len(at) else np.empty(0, f"S{LENGTH}")

    def merge(self, strings: np.ndarray, least: np.ndarray) -> None:
        """Learn of another array's documents, by binary search of its strings."""
        if not len(self.strings) or not len(strings):
            return
        at = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
        hit = self.strings[at] == strings
        np.minimum.at(self.least, at[hit], least[hit])


def _cuts(h: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, family) of arrays over rows in order of h: an anchor's rows stay together while they fit, else they are a family."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    stops = np.append(starts[1:], len(h))
    found, a, family = [], 0, 0
    for start, stop in zip(starts.tolist(), stops.tolist()):
        if stop - a <= min(SEVERAL_SNIPPETS, ARRAY_SNIPPETS):
            continue
        if start > a:
            found.append((a, start, family := family + 1))
        a = start
        if stop - start > ARRAY_SNIPPETS:
            family += 1
            found += [(k, min(stop, k + ARRAY_SNIPPETS), family) for k in range(start, stop, ARRAY_SNIPPETS)]
            a = stop
    return found + [(a, len(h), family + 1)] if a < len(h) else found


def extents(text: np.ndarray, size: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each snippet, in order of its anchor h, from where to where an earlier document has its strings; -1 where none has."""
    low, high = np.full(len(text), SNIPPET, np.int64), np.full(len(text), -1, np.int64)
    held: list[tuple[int, Strings]] = []

    def close() -> None:
        own = [x.least.copy() for _, x in held]
        for k, (a, x) in enumerate(held):
            for j, (_, y) in enumerate(held):
                if j != k:
                    x.merge(y.strings, own[j])
            row = x.row + a
            gone = x.least[x.run] < doc[row]
            np.minimum.at(low, row[gone], x.offset[gone])
            np.maximum.at(high, row[gone], x.offset[gone] + LENGTH)
        held.clear()

    last = 0
    for a, b, family in _cuts(h):
        if family != last:
            close()
        last = family
        held.append((a, Strings(text[a:b], size[a:b], doc[a:b])))
    close()
    return np.where(high < 0, -1, low), high


def _merged_strings(table: pa.Table) -> pa.Table:
    """Spans of the strings that an earlier document has, from the blocks' sorted runs of strings, each with its least document."""
    sizes = table.column("n").to_pylist()
    heads = [np.frombuffer(x, "<i8") for x in table.column("head").to_pylist()]
    runs = [np.frombuffer(_expanded(x, LENGTH * n), f"S{LENGTH}") for x, n in zip(table.column("body").to_pylist(), sizes)]
    every = np.unique(np.concatenate(runs))
    places = [np.searchsorted(every, run) for run in runs]
    least = np.full(len(every), _NO_ID, np.int64)
    for at, head, n in zip(places, heads, sizes):
        least[at] = np.minimum(least[at], head[:n])  # a run's strings are distinct
    spans = []
    for at, head, n in zip(places, heads, sizes):
        own, place = np.repeat(least[at] < head[:n], head[n : 2 * n]), head[2 * n :]
        spans.append(np.stack([place[own], place[own] + LENGTH], axis=1).astype("<i8").tobytes())
    return pa.table({"block": table.column("block"), "spans": pa.array(spans, pa.binary())})


def removals(sent: DataFrame, buckets: int) -> DataFrame:
    """block, spans: (start, stop) in the block's bytes."""

    def shard(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"block": table.column("block"), "spans": table.column("head")})
        if table.column("bucket")[0].as_py() >= buckets:
            return _merged_strings(table)
        sizes = table.column("n").to_pylist()
        heads = [_from_planes(_expanded(x, 40 * n)).view("<i8").reshape(5, n) for x, n in zip(table.column("head").to_pylist(), sizes)]
        text = np.frombuffer(b"".join(_expanded(x, SNIPPET * n) for x, n in zip(table.column("body").to_pylist(), sizes)), np.uint8).reshape(-1, SNIPPET)
        owner = np.repeat(np.arange(len(heads)), sizes)
        h, doc, at, start, stop = np.concatenate(heads, axis=1)
        size = stop - start
        # bytes flush left, as a snippet cut at its text's edge is shorter
        shift = start - at + REACH
        text, edge = text.copy(), np.flatnonzero((shift > 0) | (size < SNIPPET))
        text[edge] = text[edge[:, None], np.minimum(np.arange(SNIPPET) + shift[edge, None], SNIPPET - 1)]
        text[edge] *= np.arange(SNIPPET) < size[edge, None]
        # one entry for each distinct snippet, of its least document; others of later documents go whole
        print_ = _row_hash(text) ^ size.astype(np.uint64)
        order = np.lexsort((doc, print_))
        lead = np.concatenate([[True], print_[order][1:] != print_[order][:-1]])
        leader = np.empty(len(order), np.int64)
        leader[order] = order[lead][np.cumsum(lead) - 1]
        same = (text == text[leader]).all(axis=1) & (size == size[leader])
        low, high = np.full(len(doc), -1, np.int64), np.full(len(doc), -1, np.int64)
        whole = same & (doc > doc[leader]) & (size >= LENGTH)
        low[whole], high[whole] = 0, size[whole]
        open_ = np.flatnonzero(~whole & (size >= LENGTH))
        open_ = open_[np.argsort(h[open_], kind="stable")]
        # an anchor whose snippets all belong to one document has nothing to compare
        several = _several(h[open_], doc[open_])
        open_ = open_[several]
        if len(open_):
            low[open_], high[open_] = extents(np.ascontiguousarray(text[open_]), size[open_], doc[open_], h[open_])
        found = np.flatnonzero(high > 0)
        spans = np.stack([start + low, start + high], axis=1)
        by = np.searchsorted(owner[found], np.arange(len(heads) + 1))
        return pa.table({"block": table.column("block"), "spans": pa.array([spans[found[a:b]].astype("<i8").tobytes() for a, b in zip(by[:-1], by[1:])], pa.binary())})

    return sent.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(shard, "block long, spans binary")


def _several(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows in order of h, those whose h has two documents."""
    if not len(h):
        return np.empty(0, bool)
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
    return np.repeat(many, np.diff(np.append(cut, len(h))))


# ---- texts without their repeats


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans as one, in order."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[head, 0], reach[np.append(np.flatnonzero(head)[1:], len(spans)) - 1]], axis=1)


def repeats(docs: DataFrame, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and text, spans; and string columns to keep) of every row.

    docs: doc_id, text and keep. text is what is left, spans the removed (start, stop) in turn.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", *keep)
    blocks = staged_by(lay_out(rows, keep), "block", max(4, -(-plan_bytes(rows) // PART_BYTES)), "dedup-blocks")
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(4, -(-size // ANCHOR_BYTES))
    same = staged(copies(blocks, max(4, -(-size // COPY_BYTES))), "dedup-copies")
    flags = staged(shared_anchors(blocks, same, buckets), "dedup-flags")
    shards = max(4, min(-(-flags.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0] // SHARD_SNIPPETS), -(-size // SHARD_BYTES)))
    spans = removals(snippets(blocks, same.union(flags), buckets, shards), shards)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _cut_rows([], keep, with_text)
        block = left.to_pylist()[0]
        ids, bounds, data = _read(block)
        own = np.frombuffer(b"".join(right.column("spans").to_pylist()), "<i8").reshape(-1, 2)
        own = merged(own)
        # spans never cross texts, but those of neighbours may touch: cut them at the bounds
        row = np.searchsorted(bounds, own[:, 0], side="right") - 1
        last = np.searchsorted(bounds, own[:, 1], side="left") - 1
        pieces = np.repeat(np.arange(len(own)), last - row + 1)
        k = row[pieces] + np.arange(len(pieces)) - np.repeat(np.cumsum(last - row + 1) - (last - row + 1), last - row + 1)
        a, b = np.maximum(own[pieces, 0], bounds[k]), np.minimum(own[pieces, 1], bounds[k + 1])
        real = b > a
        k, a, b = k[real], a[real], b[real]
        at = np.searchsorted(k, np.arange(len(ids) + 1))
        raw, out = data.tobytes(), []
        for d in range(len(ids)):
            cuts = [(int(a[s]), int(b[s])) for s in range(at[d], at[d + 1])]
            parts, here = [], int(bounds[d])
            for x, y in cuts:
                parts.append(raw[here:x])
                here = y
            kept = b"".join([*parts, raw[here : int(bounds[d + 1])]])
            out.append((block["shown"][d], int(bounds[d + 1] - bounds[d]), int(sum(y - x for x, y in cuts)), len(cuts), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore"), [v - int(bounds[d]) for x in cuts for v in x]] if with_text else []), *(x[d] for x in block["kept"])))
        return _cut_rows(out, keep, with_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string, spans array<long>" * with_text + "".join(f", `{c}` string" for c in keep)
    return blocks.select("block", "ids", "shown", "bounds", "data", "kept").groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, schema)


def _cut_rows(rows: list[tuple], keep: tuple[str, ...], with_text: bool) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text", "spans"] * with_text + [*keep]
    types = [pa.int64()] * 4 + [pa.string()] + [pa.string(), pa.list_(pa.int64())] * with_text + [pa.string()] * len(keep)
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
