"""Classical oversampling: exact k-NN among minority rows, SMOTE, SMOTE-NC.

Exact k-NN in blocks, kept apart by pivots:

1. equal points are one node with its k + 1 smallest ids, so copies are never paired;
2. every node goes to the cell of its nearest pivot, and a cell is cut along the distance to
   its pivot (exact row numbers) into blocks of a bounded number of rows;
3. inside its own block each node finds an upper bound on its k-th distance, and each block the
   range of its distances to every pivot;
4. by the triangle inequality two blocks are no closer than the widest gap between those ranges; block
   pairs whose gap is within the block's bound are compared, and the best k of each pair are merged.

SMOTE draws are portable hashes of the synthetic row number, so the result does
not depend on partitioning and has an exact SQL oracle.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.prefix import global_row_number
from rarefold.functions.rng import uniform
from rarefold.session import cut_lineage, staged

SYNTHETIC_FLAG = "__is_synthetic__"

#: Pivots at most; rows and bytes of coordinates of a block at most; distances computed at a time.
PIVOTS, BLOCK_ROWS, BLOCK_BYTES, CHUNK = 64, 8192, 4 << 20, 1 << 21


def _complete(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], vector_col: str | None) -> DataFrame:
    """``df``, failing on a null or NaN feature: such a row has no distance, so it must be imputed first."""
    bad = F.lit(False)
    for c in num_cols:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    for c in cat_cols:
        bad = bad | F.col(c).isNull()
    if vector_col:
        bad = bad | F.col(vector_col).isNull() | F.exists(F.coalesce(F.col(vector_col), F.array().cast(df.schema[vector_col].dataType)), lambda x: x.isNull() | F.isnan(x.cast("double")))
    checked = F.when(bad, F.raise_error(F.lit("nearest neighbours need complete rows: impute nulls and NaN first")).cast("boolean")).otherwise(F.lit(True))
    return df.where(checked)


def _distances(a: np.ndarray, b: np.ndarray, cats_a: np.ndarray, cats_b: np.ndarray, penalty2: float) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``, terms added in the order of the columns."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        d *= d
        out += d
    for j in range(cats_a.shape[1]):
        out += np.where(cats_a[:, j, None] != cats_b[None, :, j], penalty2, 0.0)
    return np.sqrt(out, out=out)


def _values(column: pa.Array, row: int) -> pa.Array:
    return column[row].values


class _Points:
    """Rows of a packed block as arrays: coordinates (rows x columns) and category values (rows x columns)."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, n_cats: int):
        self.ids = _values(batch.column(f"__ids{side}"), row)
        n = len(self.ids)
        self.x = _values(batch.column(f"__x{side}"), row).to_numpy(zero_copy_only=False).reshape(n, -1)
        cats = _values(batch.column(f"__c{side}"), row).to_numpy(zero_copy_only=False)
        self.cats = cats.reshape(n, n_cats) if n_cats else np.zeros((n, 0), object)

    def __len__(self):
        return len(self.ids)


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category values of two blocks as numbers that agree where the values do."""
    if not a.shape[1]:
        return a, b
    out = np.empty((len(a) + len(b), a.shape[1]), np.int64)
    for j in range(a.shape[1]):
        out[:, j] = np.unique(np.concatenate([a[:, j], b[:, j]]).astype(str), return_inverse=True)[1]
    return out[: len(a)], out[len(a) :]


def _chunks(rows: int, width: int) -> Iterator[slice]:
    step = max(1, CHUNK // max(1, width))
    for lo in range(0, rows, step):
        yield slice(lo, min(rows, lo + step))


def _nearest(a: _Points, b: _Points, own: bool, limit: np.ndarray, k: int, penalty2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance): the k nearest rows of ``b`` within ``limit`` for each row of ``a``, ties to the first."""
    cats_a, cats_b = _coded(a.cats, b.cats)
    found = []
    for part in _chunks(len(a), len(b)):
        d = _distances(a.x[part], b.x, cats_a[part], cats_b, penalty2)
        if own:
            d[np.arange(part.stop - part.start), np.arange(part.start, part.stop)] = np.inf
        most = limit[part]
        if len(b) > k:
            most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((d <= most[:, None]) & np.isfinite(d))
        dist = d[row, col]
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        found.append((row[keep] + part.start, col[keep], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _double_lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def _cells(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``nodes`` with the nearest pivot's number and the distance to it."""
    none = np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell, ring = np.empty(len(x), np.int64), np.empty(len(x))
            for part in _chunks(len(x), len(pivots)):
                d = _distances(x[part], pivots, none, none, 0.0)
                cell[part] = d.argmin(axis=1)
                ring[part] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring)], [*batch.schema.names, "__cell", "__ring"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("__cell", T.LongType()), T.StructField("__ring", T.DoubleType())]))


def _block_bounds(blocks: DataFrame, groups: Sequence[str], pivots: np.ndarray, n_cats: int, k: int, penalty2: float) -> DataFrame:
    """(group..., __b, __kth, __bound, __lo, __hi): each row's bound on its k-th distance, the largest of them, and the ranges of distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kths, bound, low, high = [], [], [], []
            for i in range(batch.num_rows):
                p = _Points(batch, i, "", n_cats)
                kth = np.full(len(p), np.inf)
                if len(p) > k:
                    cats, _ = _coded(p.cats, p.cats[:0])
                    for part in _chunks(len(p), len(p)):
                        d = _distances(p.x[part], p.x, cats[part], cats, penalty2)
                        kth[part] = np.partition(d, k, axis=1)[:, k]  # the row itself is one of them
                none = np.zeros((0, 0))
                to = _distances(p.x, pivots, none, none, 0.0)
                kths.append(kth)
                bound.append(kth.max())
                low.append(to.min(axis=0))
                high.append(to.max(axis=0))
            own = [batch.column(c) for c in (*groups, "__b")]
            yield pa.RecordBatch.from_arrays([*own, _double_lists(kths), pa.array(bound, pa.float64()), _double_lists(low), _double_lists(high)], [*groups, "__b", "__kth", "__bound", "__lo", "__hi"])

    doubles = T.ArrayType(T.DoubleType())
    kinds = [("__kth", doubles), ("__bound", T.DoubleType()), ("__lo", doubles), ("__hi", doubles)]
    return blocks.mapInArrow(run, T.StructType([*[blocks.schema[c] for c in (*groups, "__b")], *[T.StructField(n, t) for n, t in kinds]]))


def block_pairs(bounds: DataFrame, groups: Sequence[str], salts: int) -> DataFrame:
    """(group..., __a, __b): block pairs that the triangle inequality cannot keep apart, each block with itself among them."""
    g = list(groups)
    a = bounds.select(*g, F.col("__b").alias("__a"), "__bound", F.col("__lo").alias("__alo"), F.col("__hi").alias("__ahi"), F.pmod(F.xxhash64("__b"), F.lit(salts)).cast("int").alias("__salt"))
    b = bounds.select(*g, "__b", "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    # rounding: ranges are taken a billionth wider
    apart = lambda lo, hi: F.array_max(F.zip_with(lo, hi, lambda x, y: x * F.lit(1 - 1e-9) - y * F.lit(1 + 1e-9)))
    gap = F.greatest(apart(F.col("__lo"), F.col("__ahi")), apart(F.col("__alo"), F.col("__hi")))
    return a.join(b, [*g, "__salt"]).where(gap <= F.col("__bound")).select(*g, "__a", "__b")


def knn_within(
    df: DataFrame,
    id_col: str,
    num_cols: Sequence[str] = (),
    cat_cols: Sequence[str] = (),
    k: int = 5,
    group_cols: Sequence[str] = (),
    vector_col: str | None = None,
    penalty: float | None = None,
    block_rows: int | None = None,
    pivots: int = PIVOTS,
) -> DataFrame:
    """O1: for every row, its k nearest other rows of the same group.

    Euclidean over ``num_cols`` (and/or the array ``vector_col``, of one length); each
    categorical mismatch adds ``penalty**2``. Ties are broken by neighbour id, which must be unique.
    Rows of a null group have no neighbours. Returns (group..., id, rank, neighbor_id, distance).
    """
    g = list(group_cols)
    if not num_cols and not vector_col:
        raise ValueError("k-NN needs numeric columns or a vector column")
    pen2 = float(penalty) ** 2 if penalty is not None else 0.0
    cats = list(cat_cols) if pen2 else []
    spark = df.sparkSession
    x = F.array(*[F.col(c).cast("double") for c in num_cols]).cast("array<double>")
    if vector_col:
        x = F.concat(x, F.col(vector_col).cast("array<double>"))
    rows = _complete(df, num_cols, cat_cols, vector_col)
    for c in g:
        rows = rows.where(F.col(c).isNotNull())
    points = rows.select(*g, F.col(id_col).alias("__id"), F.transform(x, lambda v: v + F.lit(0.0)).alias("__x"), F.array(*[F.col(c).cast("string") for c in cats]).cast("array<string>").alias("__c"))

    # 1. equal points are one node; the limit per point is applied before the shuffle
    same = [*g, "__x", "__c"]
    first = Window.partitionBy(*same).orderBy("__id")
    few = points.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
    nodes = staged(few.groupBy(*same).agg(F.sort_array(F.collect_list("__id")).alias("__m")).withColumn("__id", F.col("__m")[0]), "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("__x")).alias("least"), F.max(F.size("__x")).alias("dim"), F.max(F.size("__m")).alias("copies")).first()
    if size["least"] != size["dim"]:
        raise ValueError(f"nearest neighbours need vectors of one length, got {size['least']} to {size['dim']}")
    dim = size["dim"] or 1
    block = block_rows or max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))

    # 2. cells of the nearest pivot, cut along the distance to it
    n_groups = max(1, nodes.select(*g).distinct().count()) if g else 1
    wanted = max(1, min(pivots, -(-size["n"] // (n_groups * block))))
    chosen = np.array([r["__x"] for r in nodes.orderBy(F.xxhash64("__x", "__c"), "__id").limit(wanted).select("__x").collect()], float).reshape(-1, dim)
    ranked = global_row_number(_cells(nodes, chosen), "__ring", "__id", partition_by=[*g, "__cell"], out="__rn")
    number = F.shiftleft("__cell", 40) + F.floor((F.col("__rn") - 1) / F.lit(block)).cast("long")
    member = F.sort_array(F.collect_list(F.struct("__id", "__x", "__c", "__m")))
    packed = ranked.withColumn("__b", number).groupBy(*g, "__b").agg(member.alias("__s"))  # at most ``block`` rows each
    blocks = staged(
        packed.select(*g, "__b", F.col("__s.__m").alias("__ids"), F.flatten("__s.__x").alias("__x"), F.flatten("__s.__c").alias("__c")),
        "blocks",
    )

    # 3. bounds, and the block pairs they leave
    bounds = staged(_block_bounds(blocks, g, chosen, len(cats), k, pen2), "bounds")
    salts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), size["n"] // (block * 64)))
    side = lambda s: blocks.select(*g, F.col("__b").alias(f"__{s}"), *[F.col(f"__{c}").alias(f"__{c}_{s}") for c in ("ids", "x", "c")])
    a_side = side("a").join(bounds.select(*g, F.col("__b").alias("__a"), "__kth"), [*g, "__a"])
    # blocks are few bytes and much work: a fixed number of partitions, which Spark neither merges nor turns into a broadcast
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    b_side = side("b").repartition(tasks, *g, "__b").hint("merge")
    both = block_pairs(bounds, g, salts).join(a_side, [*g, "__a"]).join(b_side, [*g, "__b"])

    # 4. the best k of every pair of blocks, then of all
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = _Points(batch, i, "_a", len(cats)), _Points(batch, i, "_b", len(cats))
                own = batch.column("__a")[i].equals(batch.column("__b")[i])
                limit = _values(batch.column("__kth"), i).to_numpy(zero_copy_only=False)
                row, col, dist = _nearest(a, b, own, limit, k, pen2)
                if own:  # copies of a point are its nearest neighbours
                    several = np.flatnonzero(np.diff(a.ids.offsets.to_numpy()) > 1)
                    row, col, dist = np.concatenate([row, several]), np.concatenate([col, several]), np.concatenate([dist, np.zeros(len(several))])
                where = pa.array(np.full(len(row), i))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(where) for c in g], a.ids.take(pa.array(row)), b.ids.take(pa.array(col)), pa.array(dist)], [*g, "__ids_a", "__ids_b", "distance"]
                )

    ids = T.ArrayType(df.schema[id_col].dataType)
    found = both.mapInArrow(compare, T.StructType([*[blocks.schema[c] for c in g], T.StructField("__ids_a", ids), T.StructField("__ids_b", ids), T.StructField("distance", T.DoubleType())]))
    pairs = found.select(*g, F.explode("__ids_a").alias("__id"), "__ids_b", "distance").select(*g, "__id", F.explode("__ids_b").alias("neighbor_id"), "distance").where("__id <> neighbor_id")
    if (size["copies"] or 0) > k:  # rows after a point's first k + 1 have its first k as neighbours
        spread = 32
        full = nodes.where(F.size("__m") > k).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).drop("__id")
        later = points.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(spread)).cast("int")).join(full, [*same, "__salt"]).where(~F.array_contains("__m", F.col("__id")))
        pairs = pairs.unionByName(later.select(*g, "__id", F.explode(F.slice("__m", 1, k)).alias("neighbor_id"), F.lit(0.0).alias("distance")))
    w = Window.partitionBy(*g, "__id").orderBy("distance", "neighbor_id")
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(*g, F.col("__id").alias(id_col), "rank", "neighbor_id", "distance")


def smotenc_penalty(minority: DataFrame, num_cols: Sequence[str]) -> float:
    """Median of the minority numeric population standard deviations (SMOTE-NC rule)."""
    if not num_cols:
        return 1.0
    r = minority.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in num_cols]).first().asDict()
    vals = [v for v in r.values() if v is not None]
    return statistics.median(vals) if vals else 0.0


def smote(
    df: DataFrame,
    target: str,
    id_col: str,
    num_cols: Sequence[str],
    cat_cols: Sequence[str] = (),
    k: int = 5,
    seed: int = 42,
    positive: int = 1,
    out_id: str = "synthetic_id",
) -> DataFrame:
    """O2 / O3: synthetic minority rows until both classes are equal in size.

    Row j: base = minority row number floor(u_base * n_pos) (id order),
    neighbour = its rank 1 + floor(u_nb * k) neighbour, step u in [0, 1);
    numeric = base + u * (neighbour - base); with categorical columns (SMOTE-NC)
    each takes the most frequent value among the base's k neighbours (smallest
    on ties) and mismatches add the median-std penalty to distances.
    """
    counts = df.agg(
        F.count_if(F.col(target) == positive).alias("pos"), F.count_if(F.col(target) != positive).alias("neg")
    ).first()
    n_pos, n_new = counts["pos"], counts["neg"] - counts["pos"]
    spark = df.sparkSession
    cols = [*num_cols, *cat_cols]
    if n_new <= 0:
        kinds = {c: "double" for c in num_cols} | {c: df.schema[c].dataType for c in cat_cols}
        return spark.range(0).select(F.col("id").alias(out_id), *[F.lit(None).cast(kinds[c]).alias(c) for c in cols])
    if n_pos < k + 1:
        raise ValueError(f"SMOTE needs at least k + 1 = {k + 1} minority rows, got {n_pos}")
    # the minority slice feeds the k-NN, the row numbers and both joins: write it
    # once to the shared checkpoint folder instead of rescanning the input
    minority = cut_lineage(_complete(df.where(F.col(target) == positive), num_cols, cat_cols, None).select(id_col, *cols))
    pen = smotenc_penalty(minority, num_cols) if cat_cols else None
    nn = knn_within(minority, id_col, num_cols, cat_cols, k, penalty=pen)
    mins = global_row_number(minority, id_col, out="__rn")
    gen = spark.range(n_new).select(
        F.col("id").alias(out_id),
        F.floor(uniform(seed, "smote-base", "id") * F.lit(n_pos)).cast("long").alias("__rn"),
        (F.lit(1) + F.floor(uniform(seed, "smote-nb", "id") * F.lit(k))).cast("int").alias("rank"),
        uniform(seed, "smote-step", "id").alias("__lam"),
    )
    base = mins.select((F.col("__rn") - 1).alias("__rn"), F.col(id_col).alias("__base"), *[F.col(c).alias(f"__a_{c}") for c in num_cols])
    g1 = gen.join(base, "__rn")
    g2 = g1.join(nn.select(F.col(id_col).alias("__base"), "rank", F.col("neighbor_id").alias("__nb")), ["__base", "rank"])
    nb = minority.select(F.col(id_col).alias("__nb"), *[F.col(c).alias(f"__b_{c}") for c in num_cols])
    g3 = g2.join(nb, "__nb")
    out = [F.col(out_id)] + [(F.col(f"__a_{c}") + F.col("__lam") * (F.col(f"__b_{c}") - F.col(f"__a_{c}"))).alias(c) for c in num_cols]
    if cat_cols:
        vals = nn.select(F.col(id_col).alias("__base"), "neighbor_id").join(
            minority.select(F.col(id_col).alias("neighbor_id"), *cat_cols), "neighbor_id"
        )
        modes = None
        for c in cat_cols:
            m = (
                vals.groupBy("__base", c).agg(F.count(F.lit(1)).alias("__n"))
                .groupBy("__base").agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(c))
            )
            modes = m if modes is None else modes.join(m, "__base")
        g3 = g3.join(modes, "__base")
        out += [F.col(c) for c in cat_cols]
    return g3.select(*out)


def smote_resample(df: DataFrame, target: str, id_col: str, num_cols: Sequence[str], cat_cols: Sequence[str] = (), k: int = 5, seed: int = 42) -> DataFrame:
    """Original rows + synthetic rows (flagged), SMOTE-NC when any categorical column."""
    syn = smote(df, target, id_col, num_cols, cat_cols, k, seed)
    real = df.select(*num_cols, *cat_cols, target).withColumn(SYNTHETIC_FLAG, F.lit(False))
    fake = syn.select(*num_cols, *cat_cols).withColumn(target, F.lit(1)).withColumn(SYNTHETIC_FLAG, F.lit(True))
    return real.unionByName(fake)
