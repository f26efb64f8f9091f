"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors count as one with a short list of ids. Distinct vectors are dealt to shards by the
nearest of some centroids, which a bounded sample fixes (SAMPLE vectors of least hash, SAMPLE_BYTES at most); a centroid
with more vectors than a shard holds has several shards, by hash. Every vector is indexed. In a shard,
greedy searches from a few entry points propose neighbours of each vector, and relaxed distance
pruning keeps a diverse set of them: the nearest stays, and drops whatever is nearer to it, by a
factor, than to the vector. A query goes to the shards of its nearest centroids, PROBES times the
square root of all centroids (so to every shard up to PROBES * PROBES of them, and to a falling share
of more), whose graphs a beam search walks; queries of one centroid come in blocks, so that a shard is
read once for thousands of them. Distances of what is found are computed anew in double precision on
the original vectors. Recall is approximate: see README for figures.

Nulls and edges: vectors that are null, empty, zero, or hold null, NaN or infinite components take
no part, nor do rows with a null id. Vectors of different lengths never meet. Ties go to the smaller
id. Rows that repeat an id and vector count once; an id with several vectors is several candidates.
An empty table, or one without queries, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, staged, trimmed

#: Vectors of a shard, about; out-neighbours; beam widths when building and searching; pruning's factor.
SHARD_VECTORS, DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 8192, 32, 64, 96, 1.2
#: Entry points of a graph, vectors handled at once, and places of a beam whose neighbours are looked at in one step.
ENTRIES, AT_ONCE, WIDTH = 16, 256, 4
#: Distinct query vectors of a block, about.
QUERY_BLOCK = 4096
#: Vectors that fix the centroids, at most in expectation; centroids of one length of vectors; centroids that a query visits.
SAMPLE, MOST_CENTROIDS, PROBES = 65_536, 2048, 4
#: Bytes of the sample that fixes centroids, which the driver holds.
SAMPLE_BYTES = 128 << 20


def usable(vector: str, key: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(key).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


# ---- one shard


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...d,...d->...", d, d)


def beam_search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of up to beam vectors near each query, nearest first; -1 and inf where there are fewer.

    Each step looks at the neighbours of the WIDTH nearest places that weren't looked at yet.
    """
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n), bool)
    seen[:, entries] = True
    at = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    k = min(beam, len(entries))
    first = _sq(vectors[entries][None], queries[:, None])
    near = np.argsort(first, axis=1)[:, :k]
    at[:, :k], dist[:, :k] = entries[near], np.take_along_axis(first, near, 1)
    todo = dist.copy()  # distances of places to look at; inf for the others
    rows = np.arange(q)
    while True:
        rows = rows[np.isfinite(todo[rows].min(axis=1))]
        if not len(rows):
            break
        pick = np.argpartition(todo[rows], WIDTH, axis=1)[:, :WIDTH] if beam > WIDTH else np.tile(np.arange(beam), (len(rows), 1))
        open_ = np.isfinite(np.take_along_axis(todo[rows], pick, 1))
        todo[rows[:, None], pick] = np.inf
        new = np.where(open_[:, :, None], graph[at[rows[:, None], pick]], -1).reshape(len(rows), -1)
        r, c = np.nonzero((new >= 0) & ~seen[rows[:, None], new])
        place, row = new[r, c], rows[r]
        # of places that two neighbours name, one
        _, once = np.unique(row * n + place, return_index=True)
        r, c, place, row = r[once], c[once], place[once], row[once]
        seen[row, place] = True
        d = np.full(new.shape, np.inf, np.float32)
        d[r, c] = _sq(vectors[place], queries[row])
        all_d, all_at = np.concatenate([dist[rows], d], axis=1), np.concatenate([at[rows], new], axis=1)
        all_todo = np.concatenate([todo[rows], d], axis=1)
        kept = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[rows], at[rows], todo[rows] = (np.take_along_axis(x, kept, 1) for x in (all_d, all_at, all_todo))
    at[~np.isfinite(dist)] = -1
    order = np.argsort(dist, axis=1)
    return np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(vectors: np.ndarray, own: np.ndarray, proposed: np.ndarray, relax: float) -> np.ndarray:
    """DEGREE diverse neighbours of each of own among its proposed ones (-1: none)."""
    out = np.full((len(own), DEGREE), -1, np.int64)
    ordered = np.sort(proposed, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    ordered[ordered == own[:, None]] = -1
    near = vectors[ordered] - vectors[own][:, None]  # as seen from the vector: no digits lost to its own length
    products = near @ near.transpose(0, 2, 1)
    size = np.einsum("abb->ab", products).copy()
    d = size.copy()
    d[ordered < 0] = np.inf
    rows = np.arange(len(own))
    for k in range(DEGREE):
        best = d.argmin(axis=1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        out[live, k] = ordered[live, best[live]]
        between = size + size[rows, best][:, None] - 2 * products[rows, best]
        d[relax * relax * between <= d] = np.inf
        d[rows, best] = np.inf
    return out


def build_graph(vectors: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours of every vector (-1: none) and the entry points."""
    n, rng = len(vectors), np.random.default_rng(seed)
    vectors = vectors - vectors.mean(axis=0)
    centre = int(np.einsum("ab,ab->a", vectors, vectors).argmin())
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES - 1), replace=False), centre))
    graph = np.where(n > 1, rng.integers(0, max(1, n), (n, DEGREE)), -1)
    graph[graph == np.arange(n)[:, None]] = -1
    if n <= DEGREE + 1:  # everyone knows everyone
        graph = np.full((n, DEGREE), -1, np.int64)
        for k in range(n):
            graph[k, : n - 1] = np.delete(np.arange(n), k)
        return graph, entries
    for relax in (1.0, RELAX):
        order = rng.permutation(n)
        for a in range(0, n, AT_ONCE):
            own = order[a : a + AT_ONCE]
            at, _ = beam_search(vectors, graph, entries, vectors[own], BUILD_BEAM)
            graph[own] = robust_prune(vectors, own, np.concatenate([at, graph[own]], axis=1), relax)
            _link_back(vectors, graph, own, relax)
    return graph, entries


def _link_back(vectors: np.ndarray, graph: np.ndarray, own: np.ndarray, relax: float) -> None:
    """Make own neighbours of their neighbours, pruning where there is no room."""
    row, k = np.nonzero(graph[own] >= 0)
    target, source = graph[own][row, k], own[row]
    known = (graph[target] == source[:, None]).any(axis=1)
    target, source = target[~known], source[~known]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    who, start, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(who), DEGREE + count.max(initial=0)), -1, np.int64)
    wide[:, :DEGREE] = graph[who]
    wide[np.repeat(np.arange(len(who)), count), DEGREE + np.arange(len(target)) - np.repeat(start, count)] = source
    fits = (wide >= 0).sum(axis=1) <= DEGREE
    graph[who[fits]] = -np.sort(-wide[fits], axis=1)[:, :DEGREE]
    for a in range(0, (~fits).sum(), AT_ONCE):
        part = np.flatnonzero(~fits)[a : a + AT_ONCE]
        graph[who[part]] = robust_prune(vectors, who[part], wide[part], relax)


# ---- all shards


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """vector (doubles as bytes), dim, ids: the least most ids of each distinct vector. rows: vec_id, vector."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, list[int]] = {}
            for key, v in zip(b.column("vec_id").to_pylist(), b.column("vector")):
                # adding zero makes negative zeros positive
                found.setdefault((v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0).tobytes(), []).append(key)
            yield pa.record_batch({"vector": pa.array(list(found), pa.binary()), "ids": pa.array([sorted(set(x))[:most] for x in found.values()], pa.list_(pa.int64()))})

    partial = rows.mapInArrow(trimmed(local), "vector binary, ids array<long>")
    ids = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)
    return partial.groupBy("vector").agg(ids.alias("ids")).withColumn("dim", (F.octet_length("vector") / 8).cast("int"))


def _places(distinct: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """distinct with its centroid; and the centroids by length of vectors, where there are several."""
    sizes = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}  # one row a length
    total = sum(sizes.values())
    share = max(total / SAMPLE, 8 * sum(dim * n for dim, n in sizes.items()) / SAMPLE_BYTES)
    sample = distinct.where((F.xxhash64("vector") / F.lit(2.0**64) + 0.5) * share <= 1).select("dim", "vector").toArrow() if max(sizes.values(), default=0) > SHARD_VECTORS else None
    centroids = {}
    for dim, n in sizes.items():
        if n > SHARD_VECTORS:
            raw = sample.filter(pc.equal(sample.column("dim"), dim)).column("vector").to_pylist()
            if raw:
                own = np.frombuffer(b"".join(sorted(raw)), "<f8").reshape(-1, dim).astype(np.float32)
                centroids[dim] = means(own, min(-(-n // SHARD_VECTORS), MOST_CENTROIDS, len(own)))
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CENTROIDS of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw = b.column("dim").to_numpy(), b.column("vector")
            found = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                if dim in shared.value:
                    which = np.flatnonzero(dims == dim)
                    vectors = np.frombuffer(b"".join(raw.take(pa.array(which)).to_pylist()), "<f8").reshape(-1, dim).astype(np.float32)
                    found[which] = nearest_centroids(vectors, shared.value[dim], 1)[:, 0]
            yield pa.record_batch({c: b.column(c) for c in ("vector", "dim", "ids")} | {"centroid": found})

    return distinct.select("vector", "dim", "ids").mapInArrow(trimmed(run), "vector binary, dim int, ids array<long>, centroid int"), centroids


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each vector, nearest first."""
    found = np.empty((len(vectors), k), np.int32)
    size = np.einsum("ab,ab->a", centroids, centroids)
    for a in range(0, len(vectors), 4 * AT_ONCE):
        d = size - 2 * (vectors[a : a + 4 * AT_ONCE] @ centroids.T)
        found[a : a + 4 * AT_ONCE] = np.argsort(d, axis=1, kind="stable")[:, :k]
    return found


def means(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k centroids by Lloyd's rounds; one that nothing is near stays where it is."""
    centroids = vectors[np.random.default_rng(seed).choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centroids(vectors, centroids, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        which, first = np.unique(own[order], return_index=True)
        centroids[which] = np.add.reduceat(vectors[order], first, axis=0) / np.diff(np.append(first, len(own)))[:, None]
    return centroids


def index(distinct: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """dim, centroid, vectors, ids, bounds, graph, entries: a row for each shard; and the centroids."""
    spark = distinct.sparkSession
    placed, centroids = _places(distinct)
    placed = staged(placed, "ann-placed")
    sizes = sorted((r["dim"], r["centroid"], r["count"]) for r in placed.groupBy("dim", "centroid").count().collect())  # one row a centroid
    rows, number = [], 0
    for dim, centroid, n in sizes:
        parts = -(-n // SHARD_VECTORS)
        rows.append((dim, centroid, number, parts))
        number += parts
    numbers = spark.createDataFrame(rows, "dim int, centroid int, first int, parts int")

    def build(table: pa.Table) -> pa.Table:
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f8").reshape(table.num_rows, -1)
        graph, entries = build_graph(vectors.astype(np.float32))
        ids = table.column("ids").combine_chunks()
        bounds = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        row = {"dim": table.column("dim")[0].as_py(), "centroid": table.column("centroid")[0].as_py(), "vectors": vectors.tobytes(), "ids": ids.flatten().to_numpy().astype("<i8").tobytes(), "bounds": bounds.astype("<i8").tobytes(), "graph": graph.astype("<i4").tobytes(), "entries": entries.astype("<i8").tobytes()}
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), (pa.int32(), pa.int32(), *[pa.binary()] * 5))})

    dealt = placed.join(F.broadcast(numbers), ["dim", "centroid"]).withColumn("number", (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts"))).cast("int"))
    built = dealt.select("number", "dim", "centroid", "vector", "ids").repartitionByRange(max(1, number), "number").groupBy("number").applyInArrow(build, "dim int, centroid int, vectors binary, ids binary, bounds binary, graph binary, entries binary")
    return staged(built, "ann-shards"), centroids


def visits(wanted: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """qkey, vector, dim, centroid: a row for each centroid that a query visits."""
    shared = wanted.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CENTROIDS of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw = b.column("dim").to_numpy(), b.column("vector")
            for dim in np.unique(dims):
                which, own = np.flatnonzero(dims == dim), shared.value.get(dim)
                found = np.zeros((len(which), 1), np.int32)
                if own is not None:
                    vectors = np.frombuffer(b"".join(raw.take(pa.array(which)).to_pylist()), "<f8").reshape(-1, dim).astype(np.float32)
                    found = nearest_centroids(vectors, own, min(len(own), int(np.ceil(PROBES * np.sqrt(len(own))))))
                for a in range(0, len(which), AT_ONCE):
                    each = np.repeat(which[a : a + AT_ONCE], found.shape[1])
                    yield pa.record_batch({"qkey": b.column("qkey").take(pa.array(each)), "vector": raw.take(pa.array(each)), "dim": np.full(len(each), dim, np.int32), "centroid": found[a : a + AT_ONCE].ravel()})

    return wanted.select("qkey", "vector", "dim").mapInArrow(trimmed(run), "qkey long, vector binary, dim int, centroid int")


def search(shards: DataFrame, going: DataFrame, k: int) -> DataFrame:
    """qkey, vec_id, score: each shard's k nearest. going: qkey, vector, dim, centroid.

    Queries of one centroid are dealt to blocks of about QUERY_BLOCK, so that no group is unbounded.
    """
    going = staged(going, "ann-visits")
    blocks = going.groupBy("dim", "centroid").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))  # one row a centroid
    dealt = going.join(F.broadcast(blocks), ["dim", "centroid"]).withColumn("block", F.pmod(F.xxhash64("qkey"), F.col("blocks")))
    gathered = dealt.groupBy("dim", "centroid", "block").agg(F.collect_list("qkey").alias("qkeys"), F.collect_list("vector").alias("queries"))  # about QUERY_BLOCK each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                ids, bounds = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["bounds"], "<i8")
                graph, entries = np.frombuffer(row["graph"], "<i4").reshape(len(vectors), -1), np.frombuffer(row["entries"], "<i8")
                queries = np.frombuffer(b"".join(row["queries"]), "<f8").reshape(-1, row["dim"])
                small = vectors.astype(np.float32)
                for a in range(0, len(queries), AT_ONCE):
                    q = queries[a : a + AT_ONCE]
                    at, _ = beam_search(small, graph, entries, q.astype(np.float32), max(SEARCH_BEAM, k))
                    r, c = np.nonzero(at >= 0)
                    place = at[r, c]
                    score = np.sqrt(_sq(vectors[place], q[r]))
                    n = bounds[place + 1] - bounds[place]
                    r, score = np.repeat(r, n), np.repeat(score, n)
                    vec = ids[np.repeat(bounds[place] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    order = np.lexsort((vec, score, r))
                    r, score, vec = r[order], score[order], vec[order]
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    yield pa.record_batch({"qkey": np.array(row["qkeys"])[a + r[first]], "vec_id": vec[first], "score": score[first]})

    return shards.join(gathered, ["dim", "centroid"]).mapInArrow(trimmed(run), "qkey long, vec_id long, score double")


def nearest(rows: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that queries selects, itself not among them."""
    small_batches(rows.sparkSession)
    kept = rows.where(usable(vector, key)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), queries.alias("asks"))
    distinct = staged(distinct_vectors(kept.select("vec_id", "vector"), k + 1), "ann-vectors")
    shards, centroids = index(distinct)
    asking = kept.where("asks").select("vec_id", "vector").distinct()
    asked = distinct_vectors(asking, 1).select("vector", "dim", F.col("ids")[0].alias("qkey"))
    asked = staged(asked, "ann-asked")
    found = search(shards, visits(asked, centroids), k + 1)
    best = found.withColumn("place", F.row_number().over(W.partitionBy("qkey").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1).drop("place")
    each = _queries_by_vector(asking, asked)
    own = each.join(best, "qkey").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "qkey").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _queries_by_vector(asking: DataFrame, asked: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"query_id": b.column("vec_id"), "vector": pa.array([(v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0).tobytes() for v in b.column("vector")], pa.binary())})

    return asking.mapInArrow(trimmed(pack), "query_id long, vector binary").join(asked.select("vector", "qkey"), "vector").select("query_id", "qkey")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 100 == 0, 10)
