"""Operator 11: k-means by Lloyd's rounds over two trees.

Vectors are cut into blocks of ``BLOCK`` within their partition, and every block gets a
cover tree once: the points of a node lie within its radius around its centre, and the
centres of its children are over half the node's power of two apart.  Blocks are rows of
a staged table, points in the order of their tree.

Every round builds a tree of the same kind over the centroids and walks pairs of nodes
from both roots down.  A pair goes when the distance of its centres less both radii
exceeds the least distance to a centroid, plus the radius, that is known for the vectors'
node.  Where one centroid is left, the whole node is assigned at once, its sum taken
from prefix sums; pairs of leaves are compared exactly, in 64-bit integers.  Bounds are
floats with room for their rounding, so that they never decide a tie.

Every task sums its blocks by centroid before the shuffle; the driver gets a sum a
centroid and component each round, and tasks get ``k`` centroids.

Defined cases: vectors of another length, with null or non-finite components, or with a
component of 2^19 or more (whose squared distances a long can't hold) have no row; null
arrays too; a null vec_id is clustered but is never a starting centroid; rows that
share a vec_id are vectors of their own, and among equal hashes the lesser vector starts
first; with fewer vectors than ``k`` there are as many centroids; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.common import Staging, read

DIM, K, ROUNDS, SCALE, LIMIT = 64, 40, 5, 256, 1 << 19
BLOCK, LEAF = 1024, 8
#: Vectors and nodes of a block; children of a node are a range of nodes.
BLOCKS = "ids array<long>, points array<int>, lo array<int>, hi array<int>, centre array<int>, radius array<double>, child array<int>, children array<int>"
SUMS = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"
#: Pairs whose distances are computed at once.
AT_ONCE = 1 << 15


@dataclass
class Tree:
    """``points`` in tree order; node i has the points lo[i]:hi[i], the centre points[centre[i]], and children child[i] on."""

    points: np.ndarray
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows, or of rows to one point."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Nodes breadth first: a node of radius up to 2^i has children of radius up to 2^(i-1) around centres further apart than that."""
    points = np.ascontiguousarray(points, np.int64)
    start = np.arange(len(points))
    todo = [(start, 0, np.sqrt(squared(points, points[0]).astype(float)))]
    nodes, at = [], 0
    while at < len(todo):
        idx, c, d = todo[at]
        at += 1
        radius, first = float(d.max()), len(todo)
        if len(idx) > leaf and radius > 0:
            cover = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            while len(idx):
                near = d <= cover
                todo.append((idx[near], c, d[near]))
                idx = idx[~near]
                if len(idx):
                    c = idx[0]
                    d = np.sqrt(squared(points[idx], points[c]).astype(float))
        nodes.append((c if first == len(todo) else todo[first][1], radius, first, len(todo) - first, todo[at - 1][0]))
    # places in tree order: leaves one after another, depth first
    lo, hi, order = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), []
    stack = [(0, False)]
    while stack:
        i, done = stack.pop()
        _, _, first, n, idx = nodes[i]
        if done:
            hi[i] = len(order)
            continue
        lo[i] = len(order)
        if n:
            stack.append((i, True))
            stack.extend((j, False) for j in range(first + n - 1, first - 1, -1))
        else:
            order.extend(idx.tolist())
            hi[i] = len(order)
    order = np.array(order)
    place = np.empty(len(order), np.int64)
    place[order] = start
    column = lambda k: np.array([n[k] for n in nodes])
    return Tree(points[order], order, lo, hi, place[column(0)], column(1).astype(float), column(2), column(3))


def _distances(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
    out = np.empty(len(ia), np.int64)
    for i in range(0, len(ia), AT_ONCE):
        s = slice(i, i + AT_ONCE)
        out[s] = squared(a[ia[s]], b[ib[s]])
    return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: which one each element is of, and the elements."""
    which = np.repeat(np.arange(len(starts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


def nearest(vectors: Tree, centroids: Tree) -> np.ndarray:
    """The centroid of every point of ``vectors``, in tree order; numbers are those before the centroids' tree was built."""
    out = np.full(len(vectors.points), -1, np.int64)
    least = np.array([centroids.order[a:b].min() for a, b in zip(centroids.lo, centroids.hi, strict=True)])  # of equal centroids in a leaf
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):  # pairs in order of q
        d = np.sqrt(_distances(vectors.points, vectors.centre[q], centroids.points, centroids.centre[r]).astype(float))
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        size = np.diff(np.append(first, len(q)))
        bound = np.repeat(np.minimum.reduceat(d, first), size) + vectors.radius[q]
        keep = d - vectors.radius[q] - centroids.radius[r] <= bound * (1 + 1e-9) + 1e-6
        q, r = q[keep], r[keep]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        size = np.diff(np.append(first, len(q)))
        last = np.add.reduceat((centroids.children[r] > 0).astype(np.int64), first) == 0  # only leaves of centroids are left
        sole = last & (size == 1)
        for n, c in zip(q[first[sole]], least[r[first[sole]]], strict=True):
            out[vectors.lo[n] : vectors.hi[n]] = c
        exact = last & ~sole & (vectors.children[q[first]] == 0)
        for n, a, m in zip(q[first[exact]], first[exact], size[exact], strict=True):
            _compare(vectors, centroids, least, n, r[a : a + m], out)
        on = np.repeat(~(sole | exact), size)
        q, r = q[on], r[on]
        # both nodes of a pair go down to their children, if they have any
        which, r = _spread(np.where(centroids.children[r] > 0, centroids.child[r], r), np.maximum(centroids.children[r], 1))
        q = q[which]
        which, down = _spread(np.where(vectors.children[q] > 0, vectors.child[q], q), np.maximum(vectors.children[q], 1))
        order = np.argsort(down, kind="stable")
        q, r = down[order], r[which][order]
    return out


def _compare(vectors: Tree, centroids: Tree, least: np.ndarray, node: int, leaves: np.ndarray, out: np.ndarray) -> None:
    """The leaf's points against the centroids of the leaves, exactly; ties go to the smaller number."""
    leaves = leaves[np.argsort(least[leaves])]
    points = vectors.points[vectors.lo[node] : vectors.hi[node]]
    d = ((points[:, None, :] - centroids.points[centroids.centre[leaves]][None, :, :]) ** 2).sum(axis=2)
    out[vectors.lo[node] : vectors.hi[node]] = least[leaves][d.argmin(axis=1)]


def grouper(batches):
    """Function on Arrow batches of (vec_id, point): see BLOCKS."""
    import pyarrow as pa

    def block(ids, points):
        t = cover_tree(points)
        ids = [ids[i] for i in t.order.tolist()]
        cols = [ids, t.points.astype(np.int32).reshape(-1), t.lo, t.hi, t.centre, t.radius, t.child, t.children]
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.float64(), *[pa.int32()] * 2]
        return pa.record_batch([pa.array([c], pa.list_(k)) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    ids, points = [], []
    for batch in batches:
        rows = batch.column("point").flatten().to_numpy().reshape(batch.num_rows, -1)
        ids += batch.column("vec_id").to_pylist()
        points += list(rows)
        while len(ids) >= BLOCK:
            yield block(ids[:BLOCK], np.array(points[:BLOCK]))
            ids, points = ids[BLOCK:], points[BLOCK:]
    if ids:
        yield block(ids, np.array(points))


def trees(batches):
    """(vec_ids, Tree) of every block of Arrow batches of BLOCKS."""
    for batch in batches:
        for i in range(batch.num_rows):
            a = {n: batch.column(n)[i].values for n in batch.schema.names}
            lo, hi, centre, radius, child, children = (a[n].to_numpy() for n in ("lo", "hi", "centre", "radius", "child", "children"))
            points = a["points"].to_numpy().astype(np.int64).reshape(len(a["ids"]), -1)
            yield a["ids"], Tree(points, None, lo, hi, centre, radius, child, children)


def summer(centroids: np.ndarray):
    """Function on Arrow batches of BLOCKS: see SUMS; a row per centroid that got vectors."""

    def run(batches):
        import pyarrow as pa

        over = cover_tree(centroids, 1)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, tree in trees(batches):
            c = nearest(tree, over)
            n += np.bincount(c, minlength=len(n))
            upto = np.concatenate([np.zeros((1, sums.shape[1]), np.int64), np.cumsum(tree.points, axis=0)])
            cuts = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))  # runs of one centroid
            np.add.at(sums, c[cuts[:-1]], upto[cuts[1:]] - upto[cuts[:-1]])
        got = np.flatnonzero(n)
        yield pa.record_batch([pa.array(got, pa.int32()), pa.array(n[got]), pa.array(sums[got].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def assigner(centroids: np.ndarray):
    """Function on Arrow batches of BLOCKS: see ASSIGNED."""

    def run(batches):
        import pyarrow as pa

        over = cover_tree(centroids, 1)
        for ids, tree in trees(batches):
            c = nearest(tree, over)
            yield pa.record_batch([ids, pa.array(c, pa.int32()), pa.array(squared(tree.points, centroids[c]))], names=["vec_id", "cluster", "distance"])

    return run


def points(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and the components as integers, of the vectors that are kept."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < LIMIT, F.lit(False)))
    kept = vectors.select("vec_id", "embedding").where((F.size(x) == dim) & fine)
    return kept.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int")).alias("point"))


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per kept vector."""
    spark = vectors.sparkSession
    tables = Staging(spark, "centroids")
    kept = points(vectors, dim)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id IS NOT NULL").orderBy(mark, "point").limit(k).collect()
    now = np.array([r.point for r in first], np.int64).reshape(-1, dim)
    blocks = tables.put(kept.mapInArrow(grouper, BLOCKS), "blocks")
    for _ in range(rounds if len(now) else 0):
        parts = blocks.mapInArrow(summer(now), SUMS).select("cluster", "n", F.posexplode("sums").alias("i", "x"))
        for c, i, n, x in parts.groupBy("cluster", "i").agg(F.sum("n"), F.sum("x")).collect():
            now[c, i] = x // n
    if not len(now):
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    final = tables.put(blocks.mapInArrow(assigner(now), ASSIGNED), "final")
    of = {r.cluster: r.d for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    about = [(c, d, sum(of.values()), digest[c]) for c, d in of.items()]
    told = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings"))


def _oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> str:
    near = """SELECT v.id, arg_min(c.c, struct_pack(d := d, c := c.c)) AS c, min(d) AS d
      FROM (SELECT v.id, c.c, list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))::BIGINT AS d FROM v, {c} c) q
      JOIN v USING (id) JOIN {c} c ON c.c = q.c GROUP BY v.id"""
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS p FROM embeddings "
        f"WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {LIMIT})) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), p) - 1 AS c, p FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (" + near.format(dim=dim, c=f"c{i}") + ")")
        if i < rounds:
            floored = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
            out.append(f"m{i} AS (SELECT c, list(y ORDER BY j) AS p FROM (SELECT c, j, {floored} AS y FROM (SELECT a.c, unnest(v.p) AS x, generate_subscripts(v.p, 1) AS j FROM a{i} a JOIN v USING (id)) GROUP BY c, j) GROUP BY c)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(out)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (id) JOIN c{rounds} c ON c.c = a.c"""


ORACLE = _oracle()
