"""Embedding near-duplicates: inverted lists of coarse cells, product-quantised residuals, and an exact cosine at the end.

Cells have two levels, each of about the square root of their number: a centre, and a centre of what it leaves over.
So the index stays small (``MAX_CENTRES`` a level) while the cells grow with the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrix.llm.common import Scratch, components

#: Vectors that the cells and codebooks are fitted on at most (those of the smallest hashed ids).
SAMPLE = 20_000
#: Vectors a cell is meant to hold, centres of a level at most; dimensions of a subspace, its codewords; rows of a block.
PER_CELL, MAX_CENTRES, SUB, CODES, BLOCK = 1000, 2048, 8, 64, 2048
#: How far probing reaches: so many deviations of the step that a neighbour at the radius takes in a given direction, if
#: its own direction is random (radius / sqrt(dimensions)); never beyond the radius, where probing loses nothing for certain.
REACH = 4.0
MIN_COSINE = 0.98
SLACK = 1e-6


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)
    return d.argmin(1), d


def _home(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_nearest(x[s : s + 1024], c)[0] for s in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = _home(x, c)
        n = np.bincount(of, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, of, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


class Index:
    """Centres of two levels and, for each subspace, codewords of what both leave over; unit vectors of any dimension."""

    def __init__(self, x: np.ndarray, cells: int):
        k = min(MAX_CENTRES, int(np.ceil(np.sqrt(cells))))
        self.levels = [k_means(x, k)]
        rest = x - self.levels[0][_home(x, self.levels[0])]
        self.levels.append(k_means(rest, k, seed=6))
        rest = rest - self.levels[1][_home(rest, self.levels[1])]
        self.cuts = list(range(0, x.shape[1], SUB))
        self.books = [k_means(rest[:, i : i + SUB], CODES) for i in self.cuts]
        self._gaps = None

    def gaps(self) -> list[np.ndarray]:
        """Distances between the centres of a level; worked out where they are needed, so that they travel with no task."""
        if self._gaps is None:
            self._gaps = [np.sqrt(_nearest(c, c)[1]) for c in self.levels]
        return self._gaps

    def centre(self, cell):
        return self.levels[0][cell // len(self.levels[1])] + self.levels[1][cell % len(self.levels[1])]

    def place(self, x: np.ndarray, min_cosine: float = MIN_COSINE, reach: float = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Cell, code and coding error of each vector, and the cells to probe for its neighbours, its own among them."""
        parts = [self._place(x[s : s + 256], min_cosine, reach) for s in range(0, len(x), 256)]
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3)) + ([q for p in parts for q in p[3]],)

    def _place(self, x, min_cosine, reach):
        """On either level a vector of centre j lies on j's side of the plane midway between j and any other centre, so j
        can be left out if the query is further from that plane than a neighbour can be."""
        far = np.sqrt(2 - 2 * min_cosine) * min(1.0, reach / np.sqrt(x.shape[1])) + SLACK
        first, d = _nearest(x, self.levels[0])
        row, one = np.nonzero(d - d[np.arange(len(x)), first][:, None] <= 2 * self.gaps()[0][first] * far + SLACK)
        second, d = _nearest(x[row] - self.levels[0][one], self.levels[1])
        at, two = np.nonzero(d - d[np.arange(len(row)), second][:, None] <= 2 * self.gaps()[1][second] * far + SLACK)
        k = len(self.levels[1])
        own = one == first[row]
        of = first * k
        of[row[own]] += second[own]
        cells = one[at] * k + two
        rest = x - self.centre(of)
        code = np.stack([_nearest(rest[:, i : i + SUB], b)[0] for i, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        near = np.concatenate([b[code[:, k]] for k, b in enumerate(self.books)], 1)
        return of, code, np.sqrt(((rest - near) ** 2).sum(1)), np.split(cells, np.searchsorted(row[at], np.arange(1, len(x))))

    def tables(self, query: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each subspace the squared distances of the queries' residuals to the codewords."""
        rest = query - self.centre(cell)
        return [_nearest(rest[:, i : i + SUB], b)[1] for i, b in zip(self.cuts, self.books, strict=True)]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links a-b as keep their components joined."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def search_cell(index: Index, cell: int, home: dict, guests: dict, min_cosine: float = MIN_COSINE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each guest the weight of the home vectors it links with, and a forest of the links.

    Table look-ups give each pair's approximate distance; a pair is left out only if that less the home
    vector's coding error exceeds the radius, so the exact cosine then sees every true link.
    """
    radius = np.sqrt(2 - 2 * min_cosine) + SLACK
    links, forest = np.zeros(len(guests["id"]), np.int64), []
    limit = ((radius + home["error"]) ** 2 + SLACK).astype(np.float32)
    step = max(1, (1 << 20) // max(1, len(home["id"])))
    for s in range(0, len(guests["id"]), step):
        q = guests["x"][s : s + step]
        near = sum(t.astype(np.float32)[:, home["code"][:, k]] for k, t in enumerate(index.tables(q, cell)))
        g, h = np.nonzero(near <= limit)
        if not len(g):
            continue
        cos = np.einsum("ij,ij->i", q[g], home["x"][h])
        ok = (cos >= min_cosine) & (guests["id"][s + g] != home["id"][h])
        g, h = g[ok] + s, h[ok]
        np.add.at(links, g, home["n"][h])
        forest += _forest(guests["id"][g], home["id"][h])
    return links, forest


def _flat(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, sample: int = SAMPLE, reach: float = REACH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Equal vectors of a label are taken together first; their links are counted by weight. Vectors that are null,
    zero, or hold null or non-finite numbers, and those without a label, link with nothing; vectors of different
    lengths do not link, and each length has an index of its own. Rows equal in vec_id are rows of
    their own for counting, and share the component. Empty table: no rows. Pairs that are linked have the cosine; a
    pair may be missed if probing reaches less far than the radius (see ``REACH``; a reach of the square root of
    the dimensions or more misses none).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>").alias("x"), F.col("label").alias("label"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad) & F.exists("x", lambda e: e != 0)
    v = v.withColumn("ok", F.coalesce(good, F.lit(False)))
    lengths = v.filter("ok").groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    none = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = none(v.filter(~F.col("ok")))
    for found in lengths:
        out = _of_one_length(v.filter(F.col("ok") & (F.size("x") == found["d"])), found["count"], scratch, min_cosine, sample, reach).union(out)
    return out


def _of_one_length(v: DataFrame, n: int, scratch: Scratch, min_cosine: float, sample: int, reach: float) -> DataFrame:
    """Of near_duplicates, the n rows (vec_id, x, label) whose vectors can be searched and have one length."""
    same = v.groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    same = scratch.write(same, "distinct")
    drawn = same.select("x").orderBy(F.xxhash64("id")).limit(sample).toArrow().column("x").combine_chunks()
    index = Index(_unit(_flat(drawn)), max(1, n // PER_CELL))
    number = np.float32 if dict(same.dtypes)["x"] == "array<float>" else np.float64

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _flat(b.column("x"))
            of, code, error, probes = index.place(_unit(x), min_cosine, reach)
            counts = np.array([len(p) for p in probes])
            upto = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                b.column("label"), b.column("id"), b.column("n"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(of.astype(np.int32)),
                pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.ListArray.from_arrays(upto, pa.array(np.concatenate(probes).astype(np.int32))),
            ], names=["label", "id", "n", "x", "cell", "code", "error", "probes"])

    kind = dict(same.dtypes)["label"]
    placed = scratch.write(same.mapInArrow(assign, f"label {kind}, id long, n long, x binary, cell int, code binary, error double, probes array<int>"), "placed")
    guests = scratch.again(placed).select("label", "id", "x", F.explode("probes").alias("cell"))
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("home_blocks"))
    sizes = sizes.join(guests.groupBy("label", "cell").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("guest_blocks")), ["label", "cell"])
    sizes = scratch.write(sizes, "sizes")
    salt = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    home = placed.join(sizes, ["label", "cell"]).select("label", "cell", salt("home_blocks").alias("hb"), every("guest_blocks").alias("gb"), "id", "n", "x", "code", "error")
    guests = guests.join(scratch.again(sizes), ["label", "cell"]).select("label", "cell", every("home_blocks").alias("hb"), salt("guest_blocks").alias("gb"), "id", "x")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = lambda t, c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), k).reshape(t.num_rows, -1)
        out = {"a": [], "b": [], "n": []}
        if left.num_rows and right.num_rows:
            h = {"id": left.column("id").to_numpy(), "n": left.column("n").to_numpy(), "x": _unit(numbers(left, "x", number)), "code": numbers(left, "code", np.uint8), "error": left.column("error").to_numpy()}
            g = {"id": right.column("id").to_numpy(), "x": _unit(numbers(right, "x", number))}
            links, forest = search_cell(index, left.column("cell")[0].as_py(), h, g, min_cosine)
            some = np.flatnonzero(links)
            out = {"a": g["id"][some].tolist() + [x for x, _ in forest], "b": [None] * len(some) + [y for _, y in forest], "n": links[some].tolist() + [None] * len(forest)}
        return pa.table({k: pa.array(c, pa.int64()) for k, c in out.items()})

    keys = ["label", "cell", "hb", "gb"]
    found = scratch.write(home.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(search, "a long, b long, n long"), "found")
    linked = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    member = components(found.filter("b is not null").select("a", "b"), scratch)
    reps = same.join(linked, "id", "left").join(member, "id", "left").select("label", "x", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return v.join(reps, ["label", "x"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
