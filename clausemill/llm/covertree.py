"""Embedding near-duplicates by dual traversal of cover trees, exact for a cosine threshold.

Vectors are scaled to length one in double precision; a cosine of t is a distance of sqrt(2 - 2t). A top level of at
most `max_cells` centres, a sample of the vectors, deals all vectors to their nearest centre; a second level deals the
vectors of a crowded cell to centres of its own, as many; what is still crowded (vectors close to each other) is cut into
blocks by hash. Pairs of blocks are dealt in tiles, so that a block travels once for each tile it meets. Each block holds a
cover tree: nested sets of centres whose radii halve from level to level, every
node with the largest distance to its members. Pairs of cells, blocks and nodes are dropped when the distance of their
centres exceeds both radii and the threshold; pairs of nodes that lie within it as a whole are counted without looking
at their members; the rest ends in products of leaves. Where distances do not separate (vectors spread evenly over many
dimensions), hardly anything can be dropped and the products of all blocks are made, in blocks.

Cases: vectors that are null, of length zero, with null or non-finite components, or of a row without an id link with
nothing; vectors of different dimensions never link; copies are one class and link with each other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.components import components
from clausemill.llm.shared import even_sample, map_arrow, saved, scratch

#: Bounds are loosened by this much, far above rounding errors of double precision.
SLACK = 1e-9


def unit(raw: list[bytes] | np.ndarray, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Tree:
    """Nested levels over the rows of x. `levels[k]`: (centre, radius, first, end) of each node, members first..end of `order`."""

    def __init__(self, x: np.ndarray, leaf: int = 64):
        n = len(x)
        most = max(1, n // leaf)
        centres, near = [0], distance(x, x[:1])[:, 0]
        reach = [float(near.max())]
        best = np.zeros(n, np.int64)  # nearest centre so far
        while len(centres) < most and reach[-1] > SLACK:  # farthest-first: every prefix covers within its radius
            c = int(near.argmax())
            d = distance(x, x[c : c + 1])[:, 0]
            closer = d < near
            best[closer], near[closer] = len(centres), d[closer]
            centres.append(c)
            reach.append(float(near.max()))
        sizes, radius = [1], reach[0] / 2
        while radius > SLACK and reach[-1] <= radius:
            k = next(i for i, r in enumerate(reach) if r <= radius) + 1
            if k > sizes[-1]:
                sizes.append(k)
            radius /= 2
        at = np.array(centres)
        chain = [distance(x, x[at[: sizes[-1]]]).argmin(axis=1)]  # node of each row, from the finest level up
        for coarse, fine in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
            parent = distance(x[at[:fine]], x[at[:coarse]]).argmin(axis=1)
            chain.append(parent[chain[-1]])
        chain.reverse()
        self.order = np.lexsort(chain[::-1])
        self.levels = []
        for node in chain:
            node = node[self.order]
            cut = np.flatnonzero(np.concatenate([[True], np.diff(node) != 0]))
            end = np.append(cut[1:], n)
            centre = at[node[cut]]
            radii = np.array([float(distance(x[self.order[a:b]], x[c : c + 1]).max()) for a, b, c in zip(cut, end, centre, strict=True)])
            self.levels.append((centre, radii, cut, end))


class Block:
    """Vectors of a block in tree order, their weights and the levels of the tree."""

    def __init__(self, cls: np.ndarray, mult: np.ndarray, x: np.ndarray, levels: list):
        self.cls, self.mult, self.x, self.levels = cls, mult, x, levels

    @staticmethod
    def build(cls: np.ndarray, mult: np.ndarray, raw: list[bytes], dim: int) -> dict:
        x = unit(raw, dim)
        tree = Tree(x)
        o = tree.order
        place = np.argsort(o)
        levels = [[place[c].tolist(), r.tolist(), a.tolist(), b.tolist()] for c, r, a, b in tree.levels]
        return {"cls": cls[o].tolist(), "mult": mult[o].tolist(), "vectors": b"".join(raw[i] for i in o), "levels": levels}

    @staticmethod
    def read(row: dict, dim: int) -> Block:
        return Block(np.array(row["cls"], np.int64), np.array(row["mult"], np.int64), unit([row["vectors"]], dim), [[np.array(c) for c in level] for level in row["levels"]])


def _centres(b: Block, level: int):
    c, r, a, e = b.levels[level]
    return c.astype(np.int64), r.astype(float), a.astype(np.int64), e.astype(np.int64)


def traverse(a: Block, b: Block, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of each vector of a and of b (weighted), and edges (u, v) that connect what is linked."""
    eps = float(np.sqrt(2.0 - 2.0 * threshold))
    count_a, count_b = np.zeros(len(a.cls), np.int64), np.zeros(len(b.cls), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    at_a, at_b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels))):
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        ca, ra, fa, ea = _centres(a, la)
        cb, rb, fb, eb = _centres(b, lb)
        keep_a, keep_b = [], []
        for s in range(0, len(at_a), 100_000):
            i, j = at_a[s : s + 100_000], at_b[s : s + 100_000]
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", a.x[ca[i]], b.x[cb[j]])))
            inside = d + ra[i] + rb[j] <= eps - SLACK
            for p, q in zip(i[inside], j[inside], strict=True):
                sa, sb = slice(fa[p], ea[p]), slice(fb[q], eb[q])
                _count(a, b, sa, sb, None, same, count_a, count_b, edges)
            near = ~inside & (d <= ra[i] + rb[j] + eps + SLACK)
            keep_a.append(i[near])
            keep_b.append(j[near])
        at_a, at_b = np.concatenate(keep_a), np.concatenate(keep_b)
        if la + 1 < len(a.levels) or lb + 1 < len(b.levels):
            at_a, at_b = _children(a, la, at_a, b, lb, at_b)
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    _, _, fa, ea = _centres(a, la)
    _, _, fb, eb = _centres(b, lb)
    for i, j in zip(at_a, at_b, strict=True):
        for s in range(int(fa[i]), int(ea[i]), 512):
            sa, sb = slice(s, min(s + 512, int(ea[i]))), slice(int(fb[j]), int(eb[j]))
            mask = a.x[sa] @ b.x[sb].T >= threshold
            if mask.any():
                _count(a, b, sa, sb, mask, same, count_a, count_b, edges)
    return count_a, count_b, edges


def _children(a: Block, la: int, at_a: np.ndarray, b: Block, lb: int, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def spans(x: Block, level: int):
        if level + 1 >= len(x.levels):
            i = np.arange(len(x.levels[level][0]))
            return i, i + 1
        first = x.levels[level + 1][2].astype(np.int64)
        return np.searchsorted(first, x.levels[level][2]), np.searchsorted(first, x.levels[level][3])

    (a0, a1), (b0, b1) = spans(a, la), spans(b, lb)
    na, nb = (a1 - a0)[at_a], (b1 - b0)[at_b]
    many = na * nb
    rep = np.repeat(np.arange(len(at_a)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return a0[at_a][rep] + k // nb[rep], b0[at_b][rep] + k % nb[rep]


def _count(a: Block, b: Block, sa: slice, sb: slice, mask, same: bool, count_a, count_b, edges) -> None:
    if mask is None:
        count_a[sa] += b.mult[sb].sum()
        if not same:
            count_b[sb] += a.mult[sa].sum()
        u = np.concatenate([a.cls[sa], b.cls[sb]])
        edges.append((u, np.full(len(u), u.min())))
        return
    count_a[sa] += mask @ b.mult[sb]
    if not same:
        count_b[sb] += a.mult[sa] @ mask
    i, j = np.nonzero(mask)
    u, v = a.cls[sa][i], b.cls[sb][j]
    if len(i) > 4 * sum(mask.shape):
        u, v = _forest(mask, a.cls[sa], b.cls[sb])
    edges.append((u[u != v], v[u != v]))


def _forest(mask: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest class of each component of a crowded product, instead of all its pairs."""
    big = np.iinfo(np.int64).max
    low_u, low_v = np.where(mask.any(axis=1), u, big), np.where(mask.any(axis=0), v, big)
    while True:
        next_v = np.minimum(low_v, np.where(mask, low_u[:, None], big).min(axis=0))
        next_u = np.minimum(low_u, np.where(mask, next_v[None, :], big).min(axis=1))
        if (next_u == low_u).all() and (next_v == low_v).all():
            break
        low_u, low_v = next_u, next_v
    at_u, at_v = low_u < big, low_v < big
    return np.concatenate([u[at_u], v[at_v]]), np.concatenate([low_u[at_u], low_v[at_v]])


def _keys(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, key): key the components in double precision, null if the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for ok, v in zip(batch.column(0).is_valid().to_pylist(), batch.column(1), strict=True):
                key = None
                if ok and v.is_valid and len(v.values) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 becomes 0.0
                    norm = np.linalg.norm(x) if np.isfinite(x).all() else 0.0
                    key = x.tobytes() if norm > 0 and np.isfinite(norm) else None
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(k) // 8 if k else None for k in keys], pa.int32()), pa.array(keys, pa.binary())], names=["id", "dim", "key"])

    return map_arrow(vectors.select(id_col, vector_col), run, f"id {vectors.schema[id_col].dataType.simpleString()}, dim int, key binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, max_cells: int = 1024) -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each row of vectors."""
    spark = vectors.sparkSession
    keyed = saved(_keys(vectors, id_col, vector_col).withColumn("cls", F.xxhash64("key")), "cover-keys")
    classes = saved(keyed.where("key is not null").groupBy("cls").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("mult"), F.first("dim").alias("dim"), F.first("key").alias("key")), "cover-classes")
    out = None
    with scratch(spark) as s:
        for dim in sorted(r[0] for r in classes.select("dim").distinct().collect()):
            found = _links(classes.where(F.col("dim") == dim), dim, threshold, block_rows, max_cells)
            out = found if out is None else out.union(found)
        found = saved(out if out is not None else spark.createDataFrame([], "u long, v long, n long"), "cover-links")
        s.keep(found)
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    joined = components(found.where("v is not null").select("u", "v"), "cover-components")
    named = classes.select("cls", "low", "mult").join(joined, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(least, "component").join(counts, F.col("cls") == F.col("u"), "left").select("cls", "component_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    rows = keyed.select("id", F.when(F.col("key").isNotNull(), F.col("cls")).alias("cls")).join(named, "cls", "left")
    component = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, dim: int, threshold: float, block_rows: int, max_cells: int) -> DataFrame:
    """(u, v, n): edges (u, v, 0), and (u, null, n) numbers of links to other classes."""
    spark = classes.sparkSession
    n = classes.count()
    cells = max(1, min(max_cells, -(-n // block_rows)))
    centres = unit([r["key"] for r in even_sample(classes.select("cls", "key"), F.col("cls"), cells).collect()], dim)  # cls is a hash: a sample
    eps = float(np.sqrt(2.0 - 2.0 * threshold))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = [], []
            for at in range(0, len(batch), 4096):
                d = distance(unit(batch.column("key").slice(at, 4096).to_pylist(), dim), centres)
                cell.append(d.argmin(axis=1))
                far.append(d.min(axis=1))
            if cell:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(far)), batch.column("cls"), batch.column("mult"), batch.column("key")], names=["cell", "far", "cls", "mult", "key"])

    dealt = saved(map_arrow(classes.select("cls", "mult", "key"), deal, "cell int, far double, cls long, mult long, key binary"), "cover-cells")
    size = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # max_cells rows at most
    radius = {r["cell"]: r["radius"] for r in size}
    dealt = _second(dealt, {r["cell"]: r["n"] for r in size}, dim, block_rows, max_cells)
    many = dealt.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    blocked = dealt.join(many, ["cell", "sub"]).withColumn("part", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("parts")).cast("int"))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        row = Block.build(t.column("cls").to_numpy(), t.column("mult").to_numpy(), t.column("key").to_pylist(), dim)
        root, far, _, _ = row["levels"][0]
        x = unit([row["vectors"]], dim)
        row |= {"cell": key[0].as_py(), "sub": key[1].as_py(), "part": key[2].as_py(), "parts": t.column("parts")[0].as_py(), "centre": x[int(root[0])].tobytes(), "far": float(far[0])}
        return pa.Table.from_pylist([row], schema=pa.schema([("cell", pa.int32()), ("sub", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("centre", pa.binary()), ("far", pa.float64()), ("cls", pa.list_(pa.int64())), ("mult", pa.list_(pa.int64())), ("vectors", pa.binary()), ("levels", pa.list_(pa.list_(pa.list_(pa.float64()))))]))

    kind = "cell int, sub int, part int, parts int, centre binary, far double, cls array<long>, mult array<long>, vectors binary, levels array<array<array<double>>>"
    blocks = blocked.select("cell", "sub", "part", "parts", "cls", "mult", "key").groupBy("cell", "sub", "part").applyInArrow(build, kind)
    blocks = saved(blocks.withColumn("b", F.concat_ws(":", "cell", "sub", "part")), "cover-blocks")
    # Tiles of blocks that follow each other: of centres with a block each, or of one centre's blocks.
    side = max(1, min(8, blocks.count() // 16, 24_000_000 // (8 * dim * block_rows)))
    tile = F.when(F.col("parts") == 1, F.concat_ws(":", "cell", F.floor(F.col("sub") / side))).otherwise(F.concat_ws(":", "cell", "sub", F.floor(F.col("part") / side)))
    names = blocks.select("cell", "b", "centre", "far", tile.alias("tile"))
    held = sorted(radius)
    apart = distance(centres[held], centres[held])
    near = [(a, b) for x, a in enumerate(held) for y, b in enumerate(held) if x <= y and apart[x, y] <= radius[a] + radius[b] + eps + SLACK]
    pairs = spark.createDataFrame(near, "a int, b int")  # max_cells squared / 2 rows at most
    ends = lambda key, x: names.select(F.col("cell").alias(key), *[F.col(c).alias(f"{x}_{c}") for c in ("b", "centre", "far", "tile")])
    every = pairs.join(ends("a", "x"), "a").join(ends("b", "y"), "b").where("a < b or x_b <= y_b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<f8").reshape(-1, dim) for c in ("x_centre", "y_centre"))
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, y)))
            kept = pa.array(d <= batch.column("x_far").to_numpy() + batch.column("y_far").to_numpy() + eps + SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("x_b", "y_b", "x_tile", "y_tile")], names=["x", "y", "tx", "ty"])

    met = map_arrow(every.select("x_b", "y_b", "x_tile", "y_tile", "x_centre", "y_centre", "x_far", "y_far"), meet, "x string, y string, tx string, ty string")
    met = saved(met.select("x", "y", F.least("tx", "ty").alias("tx"), F.greatest("tx", "ty").alias("ty")), "cover-pairs")
    lists = met.select(F.col("tx").alias("gx"), F.col("ty").alias("gy"), "x", "y").groupBy("gx", "gy").agg(F.collect_list(F.struct("x", "y")).alias("pairs"))  # as many as a tile has blocks, squared
    needed = met.select("tx", "ty", F.explode(F.array("x", "y")).alias("b")).distinct()
    sent = needed.join(blocks.select("b", "cls", "mult", "vectors", "levels"), "b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {r["b"]: Block.read(r, dim) for r in left.to_pylist()}
        u, v, n = [], [], []
        for pair in right.column("pairs")[0].as_py():
            same = pair["x"] == pair["y"]
            x, y = rows[pair["x"]], rows[pair["y"]]
            count_x, count_y, edges = traverse(x, y, threshold, same)
            if same:
                count_x -= _own(x, threshold)
            for block, count in [(x, count_x)] + ([] if same else [(y, count_y)]):
                some = count > 0
                u.append(block.cls[some])
                v.append(pa.nulls(int(some.sum()), pa.int64()))
                n.append(count[some])
            for a, b in edges:
                u.append(a)
                v.append(pa.array(b, pa.int64()))
                n.append(np.zeros(len(a), np.int64))
        return pa.table({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.concat_arrays(v), "n": pa.array(np.concatenate(n), pa.int64())})

    return sent.groupBy("tx", "ty").cogroup(lists.groupBy("gx", "gy")).applyInArrow(run, "u long, v long, n long")


def _second(dealt: DataFrame, sizes: dict[int, int], dim: int, block_rows: int, most: int, run_rows: int = 65_536) -> DataFrame:
    """dealt (cell, cls, mult, key) with sub, the nearest of the cell's own centres, about a centre for each block of the cell.

    These are a sample of the cell's vectors; each run of a crowded cell's rows meets them in a task.
    """
    narrow = dealt.select("cell", "cls", "mult", "key")
    big = [(c, min(most, -(-n // block_rows)) / n, -(-n // run_rows)) for c, n in sizes.items() if n > block_rows]
    if not big:
        return narrow.withColumn("sub", F.lit(0))
    shares = F.broadcast(dealt.sparkSession.createDataFrame(big, "cell int, share double, runs int"))  # max_cells rows at most
    crowded = narrow.join(shares, "cell")
    chosen = crowded.where(F.xxhash64("cls", F.lit(5)) / F.lit(2.0**64) + 0.5 <= F.col("share"))
    centres = chosen.select(F.col("cell").alias("of"), F.col("cls").alias("cls"), F.col("key").alias("key"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("in"))
    rows = crowded.withColumn("run", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("runs")).cast("int")).select("cell", "run", "cls", "mult", "key")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        sub = np.zeros(len(left), np.int32)
        if len(left) and len(right) > 1:
            order = np.argsort(right.column("cls").to_numpy())
            keys = right.column("key").to_pylist()
            of = unit([keys[i] for i in order], dim)
            for at in range(0, len(left), 4096):
                sub[at : at + 4096] = distance(unit(left.column("key").slice(at, 4096).to_pylist(), dim), of).argmin(axis=1)
        return left.select(["cell", "cls", "mult", "key"]).append_column("sub", pa.array(sub))

    dealt_ = rows.groupBy("cell", "run").cogroup(centres.groupBy("of", "in")).applyInArrow(nearest, "cell int, cls long, mult long, key binary, sub int")
    calm = narrow.join(shares.select("cell"), "cell", "left_anti").withColumn("sub", F.lit(0))
    return saved(calm.unionByName(dealt_), "cover-subcells")


def _own(x: Block, threshold: float) -> np.ndarray:
    """What each vector counted for itself: rounding may leave its own product under the threshold only if that is 1."""
    return np.where(np.einsum("ij,ij->i", x.x, x.x) >= threshold, x.mult, 0)
