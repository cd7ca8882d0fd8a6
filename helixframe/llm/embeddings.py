"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length 1, where cosine >= c is a distance of at most r = sqrt(2 - 2c).
Pivots partition the vectors of a label: a vector is at home at its nearest pivot.  It is replicated
to each other pivot p that a vector within r of it can call home.  By the triangle inequality that
needs d(v, p) - d(v, home) <= 2r, and, as distances are Euclidean, also that the bisecting plane is
at most r away: (d(v, p)^2 - d(v, home)^2) / (2 d(p, home)) <= r.  Cells are then joined
on their own, home vectors against all vectors of the cell; a home vector finds all its links
there, so links are counted in place and no pair leaves the cell, only a spanning set of links.

Cells are made in levels.  A label's vectors are one cell at first; a cell with more than ``CELL_HOMES`` home
vectors is cut by pivots drawn from its own home vectors by a hash (about one for ``CELL`` of them, ``FAN`` at
most), and the cells that come out are cut again, up to ``LEVELS`` times, so that pivots grow with the data.  Any
pivots give the same result.  Pivots never come to the driver: they lead the rows of their cell to the tasks that
place them, of which a large cell has many.  A cell that is still crowded then, or that holds over ``MOST_SPREAD``
replicas for each home vector, is split by salts: homes are dealt over them and each gets all the cell's vectors.
Homes are held in memory, the others stream by.

On vectors without clusters in many dimensions distances hardly differ and most vectors reach most
cells: the join is then quadratic in a label's distinct vectors, as any exact one is known to be.

Equal vectors of a label are merged before the join and counted by their multiplicity.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose
label is null, links with nothing; vectors of different lengths never link; each row is a vector of its own, so rows
that share an id can be in different components and equal rows link with each other; a null id takes part in links
but never names a component, and a component of null ids alone has a null name; ties don't matter; no rows give no
rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed, stage
from .components import components

COSINE = 0.93
CELL = 2048
CELL_HOMES = 4096
FAN = 256
LEVELS = 4
MOST_SPREAD = 64
#: Rows of a cell that one task places.
PLACED_AT_ONCE = 200_000
#: Added to radii, so that rounding never loses a pair on the edge; the exact test is on the cosine.
SLACK = 1e-9
ROWS_AT_ONCE = 2048
MEMBERS = "cell string, home boolean, rep long, n long, v array<double>"


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, key), key null where a row can't link; and (key, rep, n, least) for each distinct vector of a label, ``rep`` being its number."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, F.struct(F.col(label_col).cast("string").alias("label"), v.alias("v"))).alias("key"))
    merged = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    return rows, stage(merged.withColumn("rep", F.monotonically_increasing_id()), "vectors")


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their greatest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def place(v: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, at home) for unit vectors: the home and each pivot across a plane that is near enough."""
    squares = np.maximum(0.0, 2 - 2 * (v @ pivots.T))
    home = squares.argmin(axis=1)
    least = squares[np.arange(len(v)), home]
    between = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))[home]
    reach = (np.sqrt(squares) - np.sqrt(least)[:, None] <= 2 * radius + SLACK) & (squares - least[:, None] <= 2 * between * (radius + SLACK) + SLACK)
    reach[np.arange(len(v)), home] = True
    row, pivot = np.nonzero(reach)
    return row, pivot, pivot == home[row]


def _cut(cosine: float):
    """Rows come sorted by cell and salt, pivots first.  Each other row goes to its home in the cell and to the homes near it."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pivots, units = None, [], None
        for b in batches:
            for key, part in b.groupby(["cell", "salt"], sort=False):
                if key != now:
                    now, pivots, units = key, [], None
                lead = part["pivot"].to_numpy(bool)
                pivots += list(part["v"][lead])
                rest = part[~lead]
                for k in range(0, len(rest), ROWS_AT_ONCE):
                    some = rest.iloc[k : k + ROWS_AT_ONCE]
                    if not pivots:
                        yield some[["cell", "home", "rep", "n", "v"]]
                        continue
                    if units is None:
                        units = _scaled(np.stack([np.asarray(x, np.float64) for x in pivots]))
                    row, pivot, nearest = place(_scaled(_matrix(some["v"])), units, radius)
                    out = some.iloc[row]
                    yield pd.DataFrame({"cell": [f"{key[0]}/{p}" for p in pivot], "home": out["home"].to_numpy() & nearest, "rep": out["rep"].to_numpy(), "n": out["n"].to_numpy(), "v": out["v"].to_numpy()})

    return run


def _sizes(members: DataFrame) -> DataFrame:
    return stage(members.groupBy(F.col("cell").alias("of")).agg(F.count_if("home").alias("homes"), F.count("*").alias("all")), "sizes")


def cells(merged: DataFrame, cosine: float = COSINE, cell: int = CELL, cell_homes: int = CELL_HOMES, fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """All members of all cells, and the cells' sizes (of, homes, all)."""
    members = merged.select(F.concat_ws(":", "key.label", F.size("key.v")).alias("cell"), F.lit(True).alias("home"), "rep", "n", F.col("key.v").alias("v"))
    sizes = _sizes(members)
    for level in range(levels):
        crowded = sizes.filter((F.col("homes") > cell_homes) & (F.col("all") <= MOST_SPREAD * F.col("homes")))
        if crowded.isEmpty():
            break
        wanted = F.least(F.lit(fan), F.greatest(F.lit(4), F.ceil(F.col("homes") / cell)))
        plan = crowded.select("of", "homes", wanted.alias("wanted"), F.ceil(F.col("all") / PLACED_AT_ONCE).cast("int").alias("salts"))
        met = members.join(plan, F.col("cell") == F.col("of"))
        drawn = F.col("home") & (F.pmod(F.xxhash64(F.lit(level), "rep"), F.col("homes")) < F.col("wanted"))
        leads = met.filter(drawn).select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("pivot"), "home", "rep", "n", "v")
        others = met.select("cell", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("pivot"), "home", "rep", "n", "v")
        ordered = leads.unionByName(others).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("pivot").desc())
        left = members.join(plan.select("of"), F.col("cell") == F.col("of"), "left_anti")
        members = stage(ordered.mapInPandas(_cut(cosine), MEMBERS).unionByName(left), "cells")
        sizes = _sizes(members)
    return members, sizes


def _spanning(links_i: np.ndarray, links_j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set (greater, lesser) of links between ids."""
    names, flat = np.unique(np.concatenate((links_i, links_j)), return_inverse=True)
    i, j = flat[: len(links_i)], flat[len(links_i) :]
    lab = np.arange(len(names))
    while True:
        old = lab.copy()
        least = np.minimum(lab[i], lab[j])
        np.minimum.at(lab, i, least)
        np.minimum.at(lab, j, least)
        lab = lab[lab]
        if (lab == old).all():
            moved = np.flatnonzero(lab != np.arange(len(names)))
            return names[moved], names[lab[moved]]


def _join_cells(cosine: float):
    """Rows come sorted by cell, salt and homes first.  Yields (rep, links) for homes and spanning links (rep, other)."""

    class Cell:
        def __init__(self, key):
            self.key, self.homes, self.ids, self.units, self.links, self.i, self.j = key, [], None, None, None, [], []

        def close_homes(self):
            if self.ids is None and self.homes:
                frame = pd.concat(self.homes)
                self.ids, self.units = frame["rep"].to_numpy(np.int64), _scaled(_matrix(frame["v"]))
                self.links = frame["n"].to_numpy(np.int64) - 1
                self.homes = []
                for k in range(0, len(frame), ROWS_AT_ONCE):
                    self.meet(frame.iloc[k : k + ROWS_AT_ONCE], self.units[k : k + ROWS_AT_ONCE])

        def meet(self, frame, units):
            ids, n = frame["rep"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
            a, b = np.nonzero(self.units @ units.T >= cosine - 1e-12)
            exact = np.einsum("ij,ij->i", self.units[a], units[b]) >= cosine
            a, b = a[exact], b[exact]
            other = self.ids[a] != ids[b]
            a, b = a[other], b[other]
            np.add.at(self.links, a, n[b])
            if len(a):
                i, j = _spanning(self.ids[a], ids[b])
                self.i.append(i), self.j.append(j)

        def out(self):
            self.close_homes()
            if self.ids is None:
                return
            yield pd.DataFrame({"rep": self.ids, "other": pd.array([pd.NA] * len(self.ids), "Int64"), "links": pd.array(self.links, "Int64")})
            if self.i:
                i, j = _spanning(np.concatenate(self.i), np.concatenate(self.j))
                yield pd.DataFrame({"rep": i, "other": pd.array(j, "Int64"), "links": pd.array([pd.NA] * len(i), "Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = None
        for b in batches:
            for key, part in b.groupby(["cell", "salt"], sort=False):
                if cell is None or cell.key != key:
                    if cell is not None:
                        yield from cell.out()
                    cell = Cell(key)
                mine = part["home"].to_numpy()
                if mine.any():
                    cell.homes.append(part[mine])
                rest = part[~mine]
                if len(rest):
                    cell.close_homes()
                    if cell.ids is not None:
                        cell.meet(rest, _scaled(_matrix(rest["v"])))
        if cell is not None:
            yield from cell.out()

    return run


def embedding_components(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL, cell_homes: int = CELL_HOMES, fan: int = FAN) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows, merged = distinct_vectors(vectors, id_col, vector_col, label_col)
    rows = stage(rows, "rows")
    members, sizes = cells(merged, cosine, cell, cell_homes, fan)
    salts = sizes.filter("homes > 0 and all > 1").select("of", F.ceil(F.col("homes") / cell_homes).cast("int").alias("salts"))
    dealt = members.join(salts, F.col("cell") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("salts"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = dealt.select("cell", "salt", (F.col("home") & (F.col("mine") == F.col("salt"))).alias("home"), "rep", "n", "v")
    joined = stage(dealt.repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("home").desc()).mapInPandas(_join_cells(cosine), "rep long, other long, links long"), "joined")
    counts = joined.filter("other is null").select(F.col("rep").alias("c_rep"), "links")
    found = components(joined.filter("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "f_node")
    # a vector alone in its cell is not joined: its links are its own repetitions
    placed = merged.join(counts, F.col("rep") == F.col("c_rep"), "left").join(found, F.col("rep") == F.col("f_node"), "left")
    placed = stage(placed.select(F.col("key").alias("a_key"), "n", "least", F.coalesce("links", F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("node")), "placed")
    names = placed.groupBy(F.col("node").alias("g_node")).agg(F.min("least").alias("component_id"))
    answer = stage(placed.join(names, F.col("node") == F.col("g_node")).select("a_key", "n", "links", "component_id"), "answer")
    linked = keyed(rows.filter("key is not null"), answer, "key", "a_key", "n").select("id", "links", "component_id")
    alone = rows.filter("key is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows by all pairs of a label; rows are numbered by id, so that the least number reachable names a component.
OP2_SQL = f"""
WITH RECURSIVE numbered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS k, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), good AS MATERIALIZED (
  SELECT k, label, len(v) AS dims, v FROM numbered
  WHERE label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM good a JOIN good b ON a.label = b.label AND a.dims = b.dims AND a.k <> b.k
  WHERE CASE WHEN a.dims = b.dims THEN list_cosine_similarity(a.v, b.v) >= {COSINE} END
), reach(k, root) AS (
  SELECT k, k FROM good
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.k WHERE r.root < l.b
), named AS (
  SELECT k, min(root) AS root FROM reach GROUP BY k
), counted AS (
  SELECT a AS k, count(*) AS n FROM links GROUP BY a
)
SELECT t.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, o.vec_id::BIGINT AS component_id, coalesce(t.vec_id = o.vec_id, false) AS kept
FROM numbered t LEFT JOIN counted c ON c.k = t.k LEFT JOIN named m ON m.k = t.k JOIN numbered o ON o.k = coalesce(m.root, t.k)
"""
