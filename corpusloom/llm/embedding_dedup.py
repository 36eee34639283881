"""Near-duplicate embeddings by cosine, compared in tiles whose dimensions are ordered by PCA.

All vectors are normalised and rotated onto the principal axes, which keeps cosines. Linked vectors are close on the
first axes, so only equal and adjacent cells of a grid on them (by default on the first alone) are compared, chunk by chunk. A tile adds up products of
leading dimensions, bounds the rest by the norms of the remaining ones, and drops the rows that cannot reach the
threshold any more; pairs too near the threshold for that are decided by the cosine of the vectors as they are. It returns sums and a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, forest
from corpusloom.plans.lineage import cut

STEP = 16
CLOSE = 1e-9  # products of turned vectors are this exact and more


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): rows that can link."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(e, lambda x: x != 0)
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # floats stay floats: half the bytes to move
    return vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite & some).select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))


def unit(rows: np.ndarray, width: int) -> np.ndarray:
    x = np.asarray(rows, float).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all unit vectors as columns: every partition adds up its moments, one task finds the eigenvectors of their sum, which come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                x = unit(np.stack(b["embedding"].to_numpy()), width)
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(width * width), "value": total.ravel()})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moment = np.zeros(width * width)
        for b in batches:
            moment[b["at"].to_numpy(int)] = b["value"].to_numpy()
        moment = moment.reshape(width, width)
        axes = np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1]  # the largest eigenvalue first
        yield pd.DataFrame({"at": np.arange(width), "row": [r.tobytes() for r in np.ascontiguousarray(axes)]})

    sums = vectors.select("embedding").mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = sums.repartition(1).mapInPandas(solve, "at int, row binary").toPandas().sort_values("at")  # one task of width * width numbers; a threaded solver in the driver's process can stall after forks
    return np.frombuffer(b"".join(found["row"]), float).reshape(width, width)


def tile_products(a: np.ndarray, b: np.ndarray, at_least: float, rows_at_once: int = 512, exact: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which pairs of rows have a product of at least ``at_least``: leading dimensions first, with the residual bounded.

    ``exact``: the vectors of the rows before they were turned; their cosines decide where the products lie within CLOSE of the bound.
    """
    if len(a) > rows_at_once:
        return np.concatenate([tile_products(a[i : i + rows_at_once], b, at_least, rows_at_once, exact and (exact[0][i : i + rows_at_once], exact[1])) for i in range(0, len(a), rows_at_once)])
    link = np.zeros((len(a), len(b)), bool)
    rest = lambda x: np.sqrt(np.maximum((x * x)[:, ::-1].cumsum(1)[:, ::-1], 0))
    ra, rb = rest(a), rest(b)
    rows, cols, s = np.arange(len(a)), np.arange(len(b)), np.zeros((len(a), len(b)))
    for low in range(0, a.shape[1], STEP):
        high = low + STEP
        s += a[rows, low:high] @ b[cols, low:high].T
        if high >= a.shape[1]:
            break
        can = s + np.outer(ra[rows, high], rb[cols, high]) >= at_least - 1e-9
        r, c = can.any(1), can.any(0)
        if not r.any():
            return link
        if not (r.all() and c.all()):
            rows, cols, s = rows[r], cols[c], s[np.ix_(r, c)]
    link[np.ix_(rows, cols)] = s >= at_least
    if exact is not None:
        i, j = np.nonzero(np.abs(s - at_least) <= CLOSE)
        i, j = rows[i], cols[j]
        for at in range(0, len(i), 4096):
            x, y = exact[0][i[at : at + 4096]].astype(float), exact[1][j[at : at + 4096]].astype(float)
            link[i[at : at + 4096], j[at : at + 4096]] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= at_least
    return link


def near_duplicates(vectors: DataFrame, at_least: float = 0.93, chunk: int = 2048, axes: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links join rows of equal label with a cosine of ``at_least`` or more.

    Null, zero and non-finite vectors, null labels and null ids link with nothing; vectors of different lengths don't either.
    Equal vectors are compared once, with their number. Rows are counted, so repeated rows link with each other. An empty
    table gives an empty result; other columns are not read, whatever their names. Very wide vectors cost a matrix of width * width in the driver and
    in every task; vectors are read and compared in tiles, so a label of m vectors in a cell costs m * m / chunk² tiles.
    """
    good = usable(vectors).withColumn("width", F.size("embedding"))
    as_double = F.col("embedding").cast("array<double>")
    keyed = good.withColumn("k1", F.xxhash64(F.col("label"), as_double)).withColumn("k2", F.hash(F.col("label"), as_double))
    classes = cut(keyed.groupBy("label", "width", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("embedding").alias("embedding")))
    found = None
    for width in sorted(r["width"] for r in classes.select("width").distinct().collect()):  # lengths, usually one
        part = tile_sums(classes.where(F.col("width") == width), width, at_least, chunk, axes)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut(found)
    links = found.where("dst is null").groupBy("src").agg(F.sum("n").alias("links"))
    group = components(found.where("dst is not null").select("src", "dst"))
    c = classes.join(links, classes["rep"] == links["src"], "left").join(group, classes["rep"] == group["node"], "left")
    c = cut(c.where("links is not null or n > 1").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    all_keys = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    all_keys = all_keys.select("vec_id", F.when(ok, F.xxhash64("label", "embedding")).alias("k1"), F.when(ok, F.hash("label", "embedding")).alias("k2"))
    out = all_keys.join(c, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def tile_sums(classes: DataFrame, width: int, at_least: float, chunk: int, axes: int) -> DataFrame:
    """(src, dst, n): with dst null, how many rows the class src links with; otherwise a forest edge."""
    turn = fit_axes(classes, width)
    side = float(np.sqrt(max(0.0, 2 * (1 - at_least)))) * 1.000001 + 1e-9
    axes = min(axes, width)

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = unit(np.stack(b["embedding"].to_numpy()), width) @ turn
                cells = np.floor(x[:, :axes] / side).astype(int)
                yield pd.DataFrame({"label": b["label"], "cx": cells[:, 0], "cy": cells[:, axes - 1], "rep": b["rep"], "n": b["n"], "x": [np.asarray(r, of).tobytes() for r in b["embedding"]]})

    kind, of = dict(classes.dtypes)["label"], np.float32 if dict(classes.dtypes)["embedding"] == "array<float>" else float
    rows = cut(classes.select("label", "rep", "n", "embedding").mapInPandas(rotate, f"label {kind}, cx int, cy int, rep long, n long, x binary"))
    cells = rows.groupBy("label", "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("q"))
    near = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    pairs = cells.select("*", F.explode(near).alias("d")).select("label", "cx", "cy", "q", (F.col("cx") + F.col("d.dx")).alias("ox"), (F.col("cy") + F.col("d.dy")).alias("oy"))
    pairs = pairs.join(cells.select("label", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("q").alias("oq")), ["label", "ox", "oy"])
    tiles = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("oq") - 1)).alias("j"))
    same = (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy"))
    tiles = tiles.where(~same | (F.col("i") <= F.col("j"))).withColumn("alone", same & (F.col("i") == F.col("j"))).withColumn("tile", F.struct("cx", "cy", "i", "ox", "oy", "j"))
    left = tiles.select("label", "cx", "cy", F.col("i").alias("chunk"), "tile", "alone", F.lit(0).alias("side"))
    right = tiles.where("not alone").select("label", F.col("ox").alias("cx"), F.col("oy").alias("cy"), F.col("j").alias("chunk"), "tile", "alone", F.lit(1).alias("side"))
    mine = F.pmod(F.xxhash64("rep"), F.col("q")).cast("int")
    dealt = rows.join(cells, ["label", "cx", "cy"]).withColumn("chunk", mine).drop("q").join(left.union(right), ["label", "cx", "cy", "chunk"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        raw = np.frombuffer(b"".join(pdf["x"]), of).reshape(len(pdf), width)
        x = unit(raw, width) @ turn
        rep, n, m = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), int((pdf["side"] == 0).sum())
        full = np.zeros((len(pdf), len(pdf)), bool)
        if pdf["alone"].iloc[0]:
            full = tile_products(x, x, at_least, exact=(raw, raw))
            np.fill_diagonal(full, False)
            full |= full.T
        else:
            full[:m, m:] = tile_products(x[:m], x[m:], at_least, exact=(raw[:m], raw[m:]))
            full[m:, :m] = full[:m, m:].T
        total, edges = full @ n, forest(full)
        has = total > 0
        return pd.DataFrame({"src": [*rep[has], *(rep[a] for a, _ in edges)], "dst": pd.array([*[None] * int(has.sum()), *(int(rep[b]) for _, b in edges)], "Int64"), "n": [*total[has], *[0] * len(edges)]})

    return dealt.groupBy("label", "tile").applyInPandas(compare, "src long, dst long, n long")
