"""Exact nearest neighbours by cosine, for a whole table of queries at once.

Candidates of one and the same vector are first reduced to the ids that can win a tie.  The rest go to
the nearest of a bounded list of pivots (candidates themselves); neighbouring pivots are packed into
bundles of bounded size.  Angles obey the triangle inequality, so a pivot's candidates cannot hold
anything nearer to a query than the angle to the pivot less the pivot's radius.

Only queries and bundles travel, never queries and cells.  In the first round each query visits the
bundle of its nearest pivot; the k-th best found there bounds the rest.  The bundles within that bound
are visited nearest first, in rounds that grow; after each round the bound has shrunk, and the bundles
beyond it are never visited.  A bundle meets its visitors a block at a time, in one task: it is cut
into cells of ``block_rows`` candidates, which a query visits nearest first, in growing rounds with a
shrinking bound as well.  Where hardly a cell can be left out, the bundle is met whole instead, a tile
after the other: products in single precision say which pairs can be among the best, and only those are
computed in double precision.  Only the k best of a bundle leave the task, so neither pairs nor a large group
ever exist.  A vector travels once per bundle visited and per block of visitors: the cell size does not
matter to what is shuffled.  Only the pivots go through the driver: ``PIVOTS`` at most.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize

BLOCK_ROWS = 4096
# bytes of vectors in a bundle, its rows at most, and the pivots of a table at most
BUNDLE_BYTES, BUNDLE_ROWS, PIVOTS = 16 << 20, 1 << 15, 4096
# fewest visitors of a block; with fewer, a bundle would travel more often than its visitors
VISITORS = 2048
# numbers in one matrix of a task, about
ENTRIES = 1 << 20
# cells or bundles a query visits in the second round, and how that number grows from round to round
FIRST_CELLS, GROWTH = 2, 4
# visitors that try the cells first, and the share of cells above which the others meet the bundle whole
TRIED, WHOLE = 16, 0.25
# candidates and visitors of a tile of a bundle met whole: its products stay in a core's cache
TILE, TILE_ROWS = 1024, 512
# similarities are compared at this many digits, so that equal vectors tie in every block
DIGITS = 12
# radians by which a bound on angles is widened: rounding a cosine to DIGITS moves an angle near 0 by
# up to 1.5e-6, and three such angles meet in one comparison
SLACK = 1e-5


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    m = np.vstack(vectors).astype(np.float64)
    size = np.sqrt((m * m).sum(axis=1))
    return m / np.where(size == 0.0, 1.0, size)[:, None]  # a zero vector scores 0 with everything


def _by_length(vectors: pd.Series) -> dict[int, np.ndarray]:
    lengths = vectors.map(len).to_numpy()
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def _scores(left: pd.Series, right: pd.Series) -> np.ndarray:
    """All cosines; vectors of unequal length score 0."""
    out = np.zeros((len(left), len(right)))
    cols = _by_length(right)
    for n, rows in _by_length(left).items():
        if n in cols:
            a = _unit([left.iloc[i] for i in rows])
            b = _unit([right.iloc[i] for i in cols[n]])
            out[np.ix_(rows, cols[n])] = a @ b.T
    return np.round(np.clip(out, -1.0, 1.0), DIGITS)


def _angles(vectors: pd.Series, pivots: pd.Series) -> np.ndarray:
    return np.arccos(_scores(vectors, pivots))


def _parts(pdf: pd.DataFrame, columns: int) -> Iterator[pd.DataFrame]:
    """Slices that make matrices of a bounded size with so many columns."""
    rows = max(1, ENTRIES // max(1, columns))
    for start in range(0, len(pdf), rows):
        yield pdf.iloc[start:start + rows]


def _placer(pivots: pd.Series, bundles: np.ndarray | None = None):
    """Give each vector its nearest pivot and its angle to it, or the bundle that pivot is in."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _parts(pdf, len(pivots)):
                angles = _angles(part["embedding"], pivots)
                if bundles is not None:  # a pivot whose place was taken by an equal one has none
                    angles = np.where(bundles >= 0, angles, np.inf)
                cell = angles.argmin(axis=1)
                if bundles is not None:
                    yield part.assign(bundle=bundles[cell].astype("int32"))
                else:
                    yield part.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(part)), cell])
    return place


def _visitor(pivot_ids: list, pivots: pd.Series, sizes: np.ndarray, radii: np.ndarray, k: int,
             exclude_self: bool, bundles: np.ndarray | None = None):
    """Give each query the cells that can hold one of its k best candidates.

    A column ``bound``, if there, is an angle within which k candidates are known already.  With ``bundles``, the
    bundle of each cell, queries are given bundles and the least angle (``lows``) of anything in them.
    """
    if bundles is not None:
        by_bundle = np.argsort(bundles, kind="stable")
        by_bundle = by_bundle[bundles[by_bundle] >= 0]
        names, starts = np.unique(bundles[by_bundle], return_index=True)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _parts(batch, len(pivots)):
                angles = _angles(pdf["embedding"], pivots)
                if "bound" in pdf:
                    bound = pdf["bound"].to_numpy(dtype=float)
                else:
                    # k candidates are certainly this near: the k nearest pivots, or the nearest cells whole
                    known = angles.copy()
                    if exclude_self:
                        own = pdf["query_id"].to_numpy()[:, None] == np.array(pivot_ids)[None, :]
                        known[own] = np.inf
                    bound = np.full(len(pdf), np.inf)
                    if len(pivot_ids) >= k:
                        bound = np.partition(known, k - 1, axis=1)[:, k - 1]
                    far = angles + radii
                    order = far.argsort(axis=1)
                    enough = np.cumsum(sizes[order], axis=1) >= k + int(exclude_self)
                    bound = np.minimum(bound, np.where(enough, np.take_along_axis(far, order, axis=1), np.inf).min(axis=1))
                low = angles - radii
                near = (low <= (bound + SLACK)[:, None]) & (sizes > 0)
                if bundles is None:
                    yield pdf.assign(cells=[np.flatnonzero(row).astype("int32") for row in near])
                    continue
                least = np.minimum.reduceat(np.where(near, low, np.inf)[:, by_bundle], starts, axis=1)
                yield pdf.assign(bundles=[names[np.isfinite(row)].astype("int32") for row in least],
                                 lows=[row[np.isfinite(row)] for row in least])
    return visit


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest values per row; equal values: the first column."""
    if k == 1:
        return np.arange(len(sims)), sims.argmax(axis=1)
    k = min(k, sims.shape[1])
    out = []
    for start in range(0, len(sims), 256):  # a row of nothing but ties stays affordable
        part = sims[start:start + 256]
        least = np.partition(part, -k, axis=1)[:, -k]
        rows, cols = np.nonzero(part >= least[:, None])
        order = np.lexsort((cols, -part[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out.append((rows[place < k] + start, cols[place < k]))
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def _scaled(left: pd.Series, right: pd.Series) -> tuple:
    """Both as matrices of unit vectors, if all vectors have one length; else as they are."""
    if len(set(left.map(len)) | set(right.map(len))) > 1:
        return left, right
    return _unit(list(left)), _unit(list(right))


def _scorer(left: pd.Series | np.ndarray, right: pd.Series | np.ndarray):
    """Cosines of chosen rows with chosen columns."""
    if isinstance(left, pd.Series):
        return lambda rows, cols: _scores(left.iloc[rows], right.iloc[cols])
    return lambda rows, cols: np.round(np.clip(left[rows] @ right[cols].T, -1.0, 1.0), DIGITS)


def _cosines(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors."""
    out, step = np.empty(len(rows)), max(1, ENTRIES // a.shape[1])
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        out[part] = np.einsum("ij,ij->i", a[rows[part]], b[cols[part]])
    return np.round(np.clip(out, -1.0, 1.0), DIGITS)


def _cut(vectors: pd.Series | np.ndarray, block_rows: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Cells of about ``block_rows`` vectors around pivots of their own: members, places of the pivots, radii."""
    at = np.unique(np.linspace(0, len(vectors) - 1, math.ceil(len(vectors) / block_rows)).astype(int))
    score, single = _scorer(vectors, vectors), isinstance(vectors, np.ndarray)
    cell, angle = np.zeros(len(vectors), int), np.zeros(len(vectors))
    if single:
        short, heads = vectors.astype("float32"), vectors[at].astype("float32").T
    step = max(1, ENTRIES // len(at))
    for start in range(0, len(vectors), step):
        rows = np.arange(start, min(start + step, len(vectors)))
        if single:  # about the nearest pivot: any cell is right, as long as its radius is
            cell[rows] = (short[rows] @ heads).argmax(axis=1)
            angle[rows] = np.arccos(_cosines(vectors, vectors, rows, at[cell[rows]]))
        else:
            angles = np.arccos(score(rows, at))
            cell[rows] = angles.argmin(axis=1)
            angle[rows] = angles.min(axis=1)
    order = np.argsort(cell, kind="stable")
    held, starts = np.unique(cell[order], return_index=True)
    return np.split(order, starts[1:]), at[held], np.maximum.reduceat(angle[order], starts)


def _products(due: np.ndarray, members: list[np.ndarray], columns: int):
    """Rows, columns and the cell of each column: cells due for most rows are taken together, about ``columns`` at once."""
    share = due.mean(axis=0)
    common = np.flatnonzero(share > 0.5)
    if len(common):
        held = np.cumsum([len(members[cell]) for cell in common]) // max(1, columns)
        for cells in np.split(common, np.flatnonzero(np.diff(held)) + 1):
            cols = np.concatenate([members[cell] for cell in cells])
            order = np.argsort(cols)
            yield np.arange(len(due)), cols[order], np.repeat(cells, [len(members[cell]) for cell in cells])[order]
    for cell in np.flatnonzero((share > 0) & (share <= 0.5)):
        yield np.flatnonzero(due[:, cell]), members[cell], np.full(len(members[cell]), cell)


def _same_id(queries: pd.Series, candidates: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the ids are; a missing number equals nothing, a missing text another."""
    codes = pd.factorize(np.concatenate([queries.to_numpy(), candidates.to_numpy()]))[0]
    own, other = codes[:len(queries)], codes[len(queries):]
    return (own if queries.dtype == object else np.where(own < 0, -2, own)), other


def _merge(sims: np.ndarray, found: np.ndarray, rows: np.ndarray, more: np.ndarray, cols: np.ndarray) -> None:
    """The best of ``rows`` so far and of more columns; equal values: the lower column."""
    both, ids = np.hstack([sims[rows], more]), np.hstack([found[rows], cols])
    order = np.lexsort((ids, -both), axis=-1)[:, :sims.shape[1]]
    sims[rows] = np.take_along_axis(both, order, axis=1)
    found[rows] = np.take_along_axis(ids, order, axis=1)


def _whole(a: np.ndarray, b: np.ndarray, own: np.ndarray | None, other: np.ndarray | None, known: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, as far as they reach ``known``: similarities and columns, -1 without one.

    ``a``, ``b``: unit vectors; pairs of equal ``own`` and ``other`` are left out.
    """
    sims, found = np.full((len(a), k), -1.0), np.full((len(a), k), len(b))
    # a product of unit vectors in single precision is off by (length + 2) * 2 ** -24 at most
    margin = (a.shape[1] + 8) * 2.0 ** -23
    short_a, short_b = a.astype("float32"), b.astype("float32")
    products = np.empty(TILE_ROWS * TILE, "float32")
    for top in range(0, len(a), TILE_ROWS):
        at = np.arange(top, min(top + TILE_ROWS, len(a)))
        for first in range(0, len(b), TILE):
            tile = np.arange(first, min(first + TILE, len(b)))
            about = np.matmul(short_a[top:top + len(at)], short_b[first:first + len(tile)].T,
                              out=products[:len(at) * len(tile)].reshape(len(at), len(tile)))
            least = np.maximum(sims[at, -1], known[at]) - margin
            if (least <= -1.0).any():  # nothing is known yet: the k best of this tile will do
                if own is not None:
                    about[own[at][:, None] == other[tile][None, :]] = -2.0
                if len(tile) > k:
                    least = np.maximum(least, np.partition(about, -k, axis=1)[:, -k] - 2 * margin)
            least = least.astype("float32")
            some = np.flatnonzero(about.max(axis=1) >= least)
            if not len(some):
                continue
            r, c = np.divmod(np.flatnonzero(about[some] >= least[some][:, None]), len(tile))
            many = np.bincount(r, minlength=len(some)) > max(8 * k, len(tile) // 8)
            if many.any():  # ties without end
                rows = at[some[many]]
                part = np.round(np.clip(a[rows] @ b[tile].T, -1.0, 1.0), DIGITS)
                if own is not None:
                    part[own[rows][:, None] == other[tile][None, :]] = -1.0
                i, j = _best(part, k)
                _merge(sims, found, rows, part[i, j].reshape(len(rows), -1), tile[j].reshape(len(rows), -1))
                r, c = r[~many[r]], c[~many[r]]
            r, c = at[some[r]], tile[c]
            if own is not None:
                r, c = r[own[r] != other[c]], c[own[r] != other[c]]
            exact = _cosines(a, b, r, c)
            good = (exact > -1.0) & (exact >= np.maximum(sims[r, -1], known[r]))
            r, c, exact = r[good], c[good], exact[good]
            order = np.lexsort((c, -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            rows, place = np.unique(r, return_inverse=True)
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            more, cols = np.full((len(rows), k), -1.0), np.full((len(rows), k), len(b))
            more[place[rank < k], rank[rank < k]] = exact[rank < k]
            cols[place[rank < k], rank[rank < k]] = c[rank < k]
            _merge(sims, found, rows, more, cols)
    return sims, found


def _kernel(k: int, exclude_self: bool, block_rows: int, count: bool):
    """The k best of a bundle for its visitors; with ``count`` also the cells that each query visited."""
    def best_of_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"row": [], "cand_id": [], "similarity": [], "first": [], "later": []})
        right = right.sort_values("cand_id", ignore_index=True)
        cand = right["cand_id"].to_numpy()
        a, b = _scaled(left["embedding"], right["embedding"])
        members, pivots, radii = _cut(b, block_rows)
        own = other = None
        if exclude_self:
            own, other = _same_id(left["query_id"], right["cand_id"])
        known = left["known"].to_numpy(dtype=float)
        score = _scorer(a, b)

        def by_cells(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            low = np.arccos(score(at, pivots)) - radii
            place = low.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            sims, found = np.full((len(at), k), -1.0), np.full((len(at), k), len(cand))
            visits, met = np.zeros((2, len(at)), int), np.zeros(low.shape, bool)
            done, width = 0, 1
            while done < len(members):
                kth = np.maximum(sims[:, -1], known[at])
                bound = np.where(kth > -1.0, np.arccos(kth), 4.0) + SLACK
                due = (place >= done) & (place < done + width) & (low <= bound[:, None])
                if not due.any():
                    break  # cells come nearest first: none is due later either
                visits[int(done > 0)] += due.sum(axis=1)
                due &= ~met
                for rows, cols, cells in _products(due, members, ENTRIES // len(at)):
                    part = score(at[rows], cols)
                    if exclude_self:
                        part[own[at[rows]][:, None] == other[cols][None, :]] = -1.0
                    if len(rows) == len(at):  # some rows have met some of these cells before
                        part[met[:, cells]] = -1.0
                    met[np.ix_(rows, np.unique(cells))] = True
                    better = part.max(axis=1) >= np.maximum(sims[rows, -1], known[at[rows]])
                    rows, part = rows[better], part[better]
                    if not len(rows):
                        continue
                    r, c = _best(part, k)
                    _merge(sims, found, rows, part[r, c].reshape(len(rows), -1), cols[c].reshape(len(rows), -1))
                done, width = done + width, width * GROWTH if done else FIRST_CELLS
            return sims, found, visits

        def parts() -> Iterator[tuple]:
            """Rows and their best; as soon as too many cells are due, the rest meet the bundle whole."""
            step = max(1, ENTRIES // max(len(members), max(map(len, members))))
            rest, share = np.arange(len(left)), 0.0
            if len(left) > 16 * TRIED:  # from all over the block
                tried = np.linspace(0, len(left) - 1, TRIED).astype(int)
                sims, found, visits = by_cells(tried)
                yield tried, sims, found, visits
                rest, share = np.delete(rest, tried), visits.sum() / len(tried) / len(members)
            while len(rest):
                if share > WHOLE and isinstance(a, np.ndarray):
                    sims, found = _whole(a[rest], b, None if own is None else own[rest], other, known[rest], k)
                    yield rest, sims, found, np.full((2, len(rest)), [[1], [len(members) - 1]])
                    return
                at, rest = rest[:step], rest[step:]
                sims, found, visits = by_cells(at)
                yield at, sims, found, visits
                share = visits.sum() / len(at) / len(members)

        out = []
        for at, sims, found, visits in parts():
            rows, cols = np.nonzero((sims > -1.0) & (sims >= known[at][:, None]))
            names = left["row"].to_numpy()[at]
            out.append(pd.DataFrame({"row": names[rows], "cand_id": cand[found[rows, cols]],
                                     "similarity": sims[rows, cols], "first": 0, "later": 0}))
            if count:
                out.append(pd.DataFrame({"row": names, "cand_id": cand[0], "similarity": None,
                                         "first": visits[0], "later": visits[1]}))
        return pd.concat(out, ignore_index=True)
    return best_of_block


def _usable(vector: str = "embedding") -> Column:
    """The vector has elements, all of them finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) > 0) & ~bad


def _packed(pivots: pd.Series, sizes: np.ndarray, rows: int) -> np.ndarray:
    """The bundle of each pivot: neighbours follow each other until ``rows`` candidates are reached."""
    bundles = np.full(len(sizes), -1)
    left, here, bundle, held = sizes > 0, int(sizes.argmax()), 0, 0
    while True:
        if held and held + sizes[here] > rows:
            bundle, held = bundle + 1, 0
        bundles[here], left[here] = bundle, False
        held += sizes[here]
        if not left.any():
            return bundles
        others = np.flatnonzero(left)
        here = int(others[_scores(pivots.iloc[[here]], pivots.iloc[others])[0].argmax()])


class Bundles:
    """Candidates (cand_id, embedding, bundle), and the pivots that say what a bundle can hold."""

    def __init__(self, candidates: DataFrame, block_rows: int):
        self.block_rows = block_rows
        self.id_type = dict(candidates.dtypes)["cand_id"]
        n, dims = candidates.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        self.empty = n == 0
        self.rows = max(1, min(BUNDLE_ROWS, BUNDLE_BYTES // (8 * (dims or 1))))
        self.pivots, self.count = None, 1
        if n <= self.rows:
            self.placed = candidates.withColumn("bundle", F.lit(0))
            self.sizes = {0: n}
            return
        # eight pivots a bundle; beyond PIVOTS of them, a crowded pivot is cut into parts
        drawn = (candidates.orderBy(F.xxhash64("cand_id"))
                 .limit(min(PIVOTS, math.ceil(8 * n / self.rows))).toPandas())
        self.pivot_ids, self.pivots = drawn["cand_id"].tolist(), drawn["embedding"]
        columns = f"cand_id {self.id_type}, embedding array<double>"
        self.pivot_sizes, self.radii = np.zeros(len(drawn)), np.zeros(len(drawn))
        placed = materialize(candidates.mapInPandas(_placer(self.pivots), f"{columns}, cell int, angle double"), "placed")
        for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
            self.pivot_sizes[row.cell], self.radii[row.cell] = row.n, row.r
        self.bundle_of = _packed(self.pivots, self.pivot_sizes, self.rows)
        self.count = int(self.bundle_of.max()) + 1
        self.sizes = {b: int(self.pivot_sizes[self.bundle_of == b].sum()) for b in range(self.count)}
        names = placed.sparkSession.createDataFrame(
            [(c, int(b)) for c, b in enumerate(self.bundle_of)], "cell int, bundle int")
        self.placed = placed.drop("angle").join(F.broadcast(names), "cell").drop("cell")

    def nearest(self, queries: DataFrame) -> DataFrame:
        """Queries with the bundle of their nearest pivot."""
        if self.pivots is None:
            return queries.withColumn("bundle", F.lit(0))
        kinds = ", ".join(f"{c} {t}" for c, t in queries.dtypes)
        return queries.mapInPandas(_placer(self.pivots, self.bundle_of), f"{kinds}, bundle int")

    def within(self, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(row, bundle, low) of the bundles that can hold something within each query's ``bound``."""
        visit = _visitor(self.pivot_ids, self.pivots, self.pivot_sizes, self.radii, k, exclude_self, self.bundle_of)
        id_type = dict(queries.dtypes)["query_id"]

        def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in visit(batches):
                yield pdf[["row", "bundles", "lows"]]

        return (queries.select("row", F.col("query_id").cast(id_type), "embedding", "bound")
                .mapInPandas(thin, "row long, bundles array<int>, lows array<double>")
                .select("row", F.inline(F.arrays_zip(F.col("bundles").alias("bundle"), F.col("lows").alias("low")))))

    def visit(self, visits: DataFrame, k: int, exclude_self: bool, count: bool) -> DataFrame:
        """(row, cand_id, similarity, first, later): the k best of each visited bundle.

        ``visits``: row, query_id, embedding, bundle and ``known``, the k-th best similarity so far or -1.
        """
        spark = visits.sparkSession
        # as many rows as there are bundles: 8 x PIVOTS at most
        visitors = {r.bundle: r["count"] for r in visits.groupBy("bundle").count().collect()}
        block = min(self.rows, max(VISITORS, sum(visitors.values()) // (4 * spark.sparkContext.defaultParallelism)))
        cuts = F.broadcast(spark.createDataFrame(
            [(b, math.ceil(self.sizes[b] / self.rows), math.ceil(n / block)) for b, n in visitors.items()],
            "bundle int, n_cb int, n_qb int"))
        left = (visits.join(cuts, "bundle")
                .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n_cb") - 1)))
                .withColumn("qb", F.pmod(F.xxhash64("row"), "n_qb").cast("int"))
                .select("bundle", "cb", "qb", "row", "query_id", "embedding", "known"))
        right = (self.placed.join(cuts, "bundle")
                 .withColumn("cb", F.pmod(F.xxhash64("cand_id"), "n_cb").cast("int"))
                 .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1)))
                 .select("bundle", "cb", "qb", "cand_id", "embedding"))
        by = ["bundle", "cb", "qb"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
            _kernel(k, exclude_self, self.block_rows, count),
            f"row long, cand_id {self.id_type}, similarity double, first long, later long")


def _k_best(found: DataFrame, k: int, key: str = "row") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "cand_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_known(queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Queries with the similarity of their k-th best candidate so far (-1 without one), and its angle."""
    kth = best.where(F.col("rank") == k).select("row", F.col("similarity").alias("_kth"))
    return (queries.join(kth, "row", "left").withColumn("known", F.coalesce("_kth", F.lit(-1.0)))
            .withColumn("bound", F.coalesce(F.acos("_kth"), F.lit(4.0))).drop("_kth"))


def _searched(queries: DataFrame, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """Searches (row, query_id, embedding), and which of them answers which query (query_id, row).

    Queries of one vector share a search, unless each has itself to leave out.
    """
    rows = materialize(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
                       .where(_usable()).withColumn("row", F.monotonically_increasing_id()), "queries")
    if exclude_self:
        return rows, rows.select("query_id", "row")
    by_hash = rows.withColumn("_h", F.xxhash64("embedding"))
    distinct = materialize(by_hash.groupBy("_h", "embedding").agg(F.min("row").alias("row")), "searches")
    answers = by_hash.drop("row").join(distinct, ["_h", "embedding"]).select("query_id", "row")
    return distinct.select("row", F.col("row").alias("query_id"), "embedding"), materialize(answers, "answers")


def _winners(candidates: DataFrame, k: int) -> DataFrame:
    """Candidates without those that k others of the same vector beat by id; one more, as a query may be one."""
    rows = candidates.select("cand_id", F.col("embedding").cast("array<double>").alias("embedding")).where(_usable())
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("cand_id")
    return materialize(rows.withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= k + 1).drop("_n"), "candidates")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 1, exclude_self: bool = True,
          block_rows: int = BLOCK_ROWS, visited: list[int] | None = None) -> DataFrame:
    """(query_id, cand_id, similarity, rank) of the k best candidates per query.

    ``queries``: query_id, embedding; ``candidates``: cand_id, embedding.  Rows without a vector, or
    with a null, NaN or infinite element in it, are skipped; a similarity of exactly -1 is never chosen; ties go to the lower cand_id.
    ``visited``, if given, takes the number of (query, cell) visits of each round.
    """
    spark, id_type = queries.sparkSession, dict(queries.dtypes)["query_id"]
    q, answers = _searched(queries, exclude_self)
    bundles = Bundles(_winners(candidates, k), block_rows)
    if bundles.empty or q.isEmpty():
        return spark.createDataFrame(
            [], f"query_id {id_type}, cand_id {bundles.id_type}, similarity double, rank int")

    def meet(visits: DataFrame) -> DataFrame:
        found = bundles.visit(visits, k, exclude_self, visited is not None)
        if visited is None:
            return found.drop("first", "later")
        found = materialize(found, "found")
        visited.extend(found.agg(F.sum("first"), F.sum("later")).first())
        return found.where("similarity IS NOT NULL").drop("first", "later")

    first = bundles.nearest(q.withColumn("known", F.lit(-1.0)))
    if bundles.count > 1:
        first = materialize(first, "visits")
    best = materialize(_k_best(meet(first), k), "best")
    if bundles.count > 1:
        later = bundles.within(_with_known(q, best, k), k, exclude_self).join(
            first.select("row", "bundle"), ["row", "bundle"], "left_anti")
        in_order = Window.partitionBy("row").orderBy("low", "bundle")
        agenda = materialize(later.withColumn("place", F.row_number().over(in_order)), "agenda")
    done, width = 0, FIRST_CELLS
    while bundles.count > 1:
        turn = agenda.where((F.col("place") > done) & (F.col("place") <= done + width))
        # bundles come nearest first: a query without a visit in this round needs none later either
        visits = materialize(_with_known(turn, best, k).where(F.col("low") <= F.col("bound") + SLACK)
                             .select("row", "bundle", "known"), "visits")
        if visits.isEmpty():
            break
        found = meet(visits.join(q, "row"))
        best = materialize(_k_best(best.drop("rank").unionByName(found), k), "best")
        done, width = done + width, width * GROWTH
    return _k_best(best.drop("rank").join(answers, "row").drop("row"), k, "query_id").select(
        "query_id", "cand_id", "similarity", "rank")


def nearest_verified(queries: DataFrame, stories: DataFrame, k: int = 1,
                     exclude_self: bool = True) -> DataFrame:
    """Best verified stories per query (query_id, embedding), with their texts."""
    verified = stories.where("verified_spec IS NOT NULL")
    best = top_k(queries, verified.select(F.col("story_id").alias("cand_id"), "embedding"),
                 k, exclude_self)
    texts = verified.select(F.col("story_id").alias("cand_id"), "title", "description",
                            "verified_spec")
    return best.join(texts, "cand_id").select(
        "query_id", F.col("cand_id").alias("story_id"), "title", "description", "verified_spec",
        "similarity", "rank")


def closest_definition(queries: DataFrame, steps: DataFrame, binds: DataFrame, defs: DataFrame,
                       k: int = 1) -> DataFrame:
    """Definitions of the bound steps nearest to each query (query_id, embedding).

    A step bound to several definitions stands for each of them, the lower id first.
    """
    bound = (binds.join(defs.select("definition_id"), "definition_id", "left_semi")
             .select("step_id", "definition_id").dropDuplicates())
    first = Window.partitionBy("step_id").orderBy("definition_id")
    bound = bound.withColumn("_d", F.row_number().over(first)).where(F.col("_d") <= k).drop("_d")
    carriers = steps.select("step_id", "embedding").join(bound.select("step_id"), "step_id",
                                                         "left_semi")
    near = top_k(queries, carriers.withColumnRenamed("step_id", "cand_id"), k, exclude_self=False)
    pairs = near.withColumnRenamed("cand_id", "step_id").join(bound, "step_id")
    order = Window.partitionBy("query_id").orderBy("rank", "definition_id")
    best = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return (best.join(defs.select("definition_id", "expression", "code_block"), "definition_id")
            .select("query_id", "step_id", "definition_id", "expression", "code_block",
                    "similarity", F.col("_n").alias("rank")))


def retrieval_context(queries: DataFrame, stories: DataFrame) -> DataFrame:
    """One reference text per query story: title, description and spec of its best verified match."""
    near = nearest_verified(queries, stories)
    text = F.concat(F.lit("Similar User Story: "), F.col("title"),
                    F.lit("\nSimilar User Story Description:\n"), F.col("description"),
                    F.lit("\n\nVerified Specification Code:\n"), F.col("verified_spec"))
    return near.select(F.col("query_id").alias("story_id"), F.col("story_id").alias("similar_id"),
                       F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
                       text.alias("context"))
