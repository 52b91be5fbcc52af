"""A kept index for approximate cosine search: coarse cells with quantised residuals, filters inside the cells.

Cells are the means of a spherical k-means, fitted in one task on at most SAMPLE rows of least hash; every row is then indexed.
A row's residual to its cell is cut into parts of SUB numbers, each stored as one byte that names the nearest of at most 256 codes.
Files are sorted by cell, so a search of few cells reads few row groups, and vectors themselves only for the best
candidates, which are scored exactly.

A search sends every query to its `probes` nearest cells: as many as the sample's own neighbours need (see probes_of). Where a quarter
of the cells would not do, cells do not part these vectors and a search is exact. Cells of more than PART rows are split by id and a cell's queries
are dealt in blocks of ASKED, so that no task holds more than PART rows and ASKED queries, however many share a cell. Conditions on kept
columns act on the rows before any ranking; queries that still find fewer than k rows are searched exactly. Null vectors are
not indexed, zero vectors score 0, another dimension raises ValueError; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import cosine_neighbours
from ..operators.taxonomy import cosine
from .tables import written

SAMPLE, CELLS, PER_CELL, SUB, PART, ASKED, ROUNDS, STEP = 65_536, 4096, 64, 4, 1 << 16, 2048, 12, 1024
# The probes at least, the share of a row's ten neighbours that the probed cells are to hold, and the rows it is measured on.
PROBES, HELD, MEASURED = 12, 0.97, 256

MODEL = "id_col string, dim int, centre binary, sizes array<int>, codes binary, probes int"


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def means(v: np.ndarray, k: int, seed: int, sphere: bool = False) -> np.ndarray:
    """k-means of the rows of v; a mean that loses all its rows starts again at the row that is worst served."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(ROUNDS):
        near, least = np.zeros(len(v), np.int64), np.zeros(len(v), v.dtype)
        for at in range(0, len(v), STEP):  # distances of few rows at a time
            far = (c ** 2).sum(1) - 2 * v[at:at + STEP] @ c.T
            near[at:at + STEP], least[at:at + STEP] = far.argmin(1), far.min(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        lost = np.flatnonzero(size == 0)
        if len(lost):
            c[lost] = v[np.argsort(-least, kind="stable")[:len(lost)]]
        if sphere:
            c = unit(c)
    return c


def probes_of(v: np.ndarray, centre: np.ndarray, cell: np.ndarray) -> int:
    """The fewest nearest cells, PROBES at least, that hold the share HELD of ten neighbours of rows of v; all cells if a quarter of them does not do."""
    asked = np.arange(0, len(v), max(1, len(v) // MEASURED))
    place = []
    for i in asked:
        s = v @ v[i]
        s[i] = -np.inf
        near = np.argpartition(-s, min(10, len(s) - 1))[:10]
        order = np.argsort(np.argsort(-(centre @ v[i]), kind="stable"))
        place.append(order[cell[near[near != i]]])
    place = np.sort(np.concatenate(place))
    need = max(PROBES, int(place[math.ceil(HELD * len(place)) - 1]) + 1) if len(place) else PROBES
    return need if need <= max(PROBES, len(centre) // 4) else len(centre)


def stacked(vectors: pd.Series, dim: int | None = None) -> np.ndarray:
    if dim is not None and (vectors.map(len) != dim).any():
        raise ValueError("vectors of differing dimensions")
    return unit(np.stack(vectors.map(np.asarray)).astype(np.float32))


class VectorIndex:
    """An index at a path: model (one row), rows, and cells (counts, one set a batch of rows)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/model").first()
        self.id_col, self.dim = row["id_col"], row["dim"]
        self.centre = np.frombuffer(row["centre"], np.float32).reshape(-1, max(self.dim, 1))
        self.sizes, self.probes = list(row["sizes"]), row["probes"]
        flat, at, self.codes = np.frombuffer(row["codes"], np.float32), 0, []
        for width, n in zip(self.widths(self.dim), self.sizes):
            self.codes.append(flat[at:at + width * n].reshape(n, width))
            at += width * n

    @staticmethod
    def widths(dim: int) -> list[int]:
        return [min(SUB, dim - i) for i in range(0, dim, SUB)]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "vec_id", keep: tuple[str, ...] = (), cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Index (id_col, embedding, *keep) rows at path, which must not exist yet."""
        spark, rows = vectors.sparkSession, vectors.filter("embedding is not null").select(id_col, "embedding", *keep)
        n = rows.count()
        cells = cells or max(1, min(CELLS, n // PER_CELL))
        bar = int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 40))
        sample = rows.select("embedding", F.pmod(F.xxhash64(id_col), F.lit(1 << 40)).alias("h")).filter(F.col("h") < bar).orderBy("h").limit(SAMPLE)

        if not n:
            spark.createDataFrame([(id_col, 0, b"", [], b"", PROBES)], MODEL).write.parquet(f"{path}/model")

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            all_ = pd.concat([p["embedding"] for p in batches if len(p)])
            v = stacked(all_, len(all_.iloc[0]))
            centre = means(v, cells, seed, sphere=True)
            cell = np.concatenate([(v[at:at + STEP] @ centre.T).argmax(1) for at in range(0, len(v), STEP)])
            rest = v - centre[cell]
            codes, at = [], 0
            for width in cls.widths(v.shape[1]):
                codes.append(means(rest[:, at:at + width], 256, seed))
                at += width
            yield pd.DataFrame({"id_col": [id_col], "dim": [v.shape[1]], "centre": [centre.astype(np.float32).tobytes()], "sizes": [[len(c) for c in codes]], "codes": [b"".join(c.astype(np.float32).tobytes() for c in codes)], "probes": [probes_of(v, centre, cell)]})

        if n:
            sample.select("embedding").coalesce(1).mapInPandas(fit, MODEL).write.parquet(f"{path}/model")
        out = cls(spark, path)
        out.add(rows)
        return out

    def add(self, vectors: DataFrame) -> None:
        """Index more rows under the same cells. Rows are sorted by cell; equal cells spread by the id's hash."""
        held, dim = self.spark.sparkContext.broadcast((self.centre, self.codes)), self.dim

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centre, codes = held.value
            for pdf in (p.iloc[a:a + STEP] for p in batches for a in range(0, len(p), STEP)):
                v = stacked(pdf["embedding"], dim)
                cell = (v @ centre.T).argmax(1)
                rest, at, code = v - centre[cell], 0, np.zeros((len(v), len(codes)), np.uint8)
                for j, c in enumerate(codes):
                    part = rest[:, at:at + c.shape[1]]
                    code[:, j] = ((c ** 2).sum(1) - 2 * part @ c.T).argmin(1)
                    at += c.shape[1]
                yield pdf.assign(cell=cell.astype(np.int32), code=[x.tobytes() for x in code])

        rows = vectors.filter("embedding is not null")
        if not dim:
            if rows.isEmpty():
                rows.withColumns({"cell": F.lit(0), "code": F.lit(b"")}).write.mode("append").parquet(f"{self.path}/rows")
                return
            raise ValueError("the index was built without rows")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.mapInPandas(place, f"{kinds}, cell int, code binary")
        placed.repartitionByRange(n, "cell", F.xxhash64(self.id_col)).sortWithinPartitions("cell").write.mode("append").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, where: Column | None = None, candidates: int = 16) -> DataFrame:
        """(query_id, id_col, score, rank) of (query_id, embedding) queries: the nearest of at most candidates * k rows, scored exactly."""
        rows = self.rows() if where is None else self.rows().filter(where)
        asked = queries.filter("embedding is not null").select("query_id", "embedding")
        probes = probes or self.probes
        if not self.dim or PROBES < len(self.centre) <= probes:
            return cosine_neighbours(rows, asked, k, self.id_col)
        found = written(self._near(rows, asked, k * candidates, min(probes, len(self.centre))))
        scored = found.join(rows.select(F.col(self.id_col), F.col("embedding").alias("v")), self.id_col).join(asked, "query_id")
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(cosine(F.col("embedding"), F.col("v")), 5)))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), self.id_col)
        out = written(scored.select("query_id", self.id_col, score.alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        full = out.filter(F.col("rank") == k).select("query_id")
        short = written(asked.join(full, "query_id", "left_anti"))
        if short.isEmpty():
            return out
        return out.join(full, "query_id", "left_semi").unionByName(cosine_neighbours(rows, short, k, self.id_col).select(*out.columns))

    def _near(self, rows: DataFrame, asked: DataFrame, best: int, probes: int) -> DataFrame:
        """(query_id, id_col): the best rows of each query by quantised distance."""
        held, dim, id_col = self.spark.sparkContext.broadcast((self.centre, self.codes)), self.dim, self.id_col

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centre, _ = held.value
            for pdf in (p.iloc[a:a + STEP] for p in batches for a in range(0, len(p), STEP)):
                cells = np.argsort(-(stacked(pdf["embedding"], dim) @ centre.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), probes), "embedding": pdf["embedding"].repeat(probes).to_numpy(), "cell": cells.ravel().astype(np.int32)})

        kind = asked.schema["query_id"].dataType.simpleString()
        sent = written(asked.mapInPandas(probe, f"query_id {kind}, embedding array<float>, cell int"))
        # one row a cell on both sides, at most CELLS
        ask = sent.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks"))
        have = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        plan = F.broadcast(ask.join(have, "cell"))
        count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.select("cell", F.col(id_col).alias("id"), "code").join(plan, "cell")
        left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", count("blocks")).select("cell", "part", "block", "id", "code")
        right = sent.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", count("parts")).select("cell", "part", "block", "query_id", "embedding")

        def rank(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            centre, codes = held.value
            if own.empty or ask.empty:
                return pd.DataFrame({"query_id": ask["query_id"].iloc[:0], "id": own["id"].iloc[:0], "s": pd.Series([], dtype="float64")})
            own = own.sort_values("id")
            code = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
            ids, q, out = own["id"].to_numpy(), stacked(ask["embedding"]), []
            step = max(1, (1 << 22) // len(own))
            for a in range(0, len(q), step):
                part = q[a:a + step]
                s, at = np.repeat((part @ centre[own["cell"].iloc[0]])[:, None], len(own), 1), 0
                for j, c in enumerate(codes):
                    s += (part[:, at:at + c.shape[1]] @ c.T)[:, code[:, j]]
                    at += c.shape[1]
                pick = np.argsort(-s, axis=1, kind="stable")[:, :best] if len(own) <= 4 * best else None
                if pick is None:
                    pick = np.argpartition(-s, best - 1, axis=1)[:, :best]
                out.append(pd.DataFrame({"query_id": np.repeat(ask["query_id"].to_numpy()[a:a + step], pick.shape[1]), "id": ids[pick].ravel(), "s": np.take_along_axis(s, pick, 1).ravel().astype(float)}))
            return pd.concat(out)

        of = rows.schema[id_col].dataType.simpleString()
        got = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(rank, f"query_id {kind}, id {of}, s double")
        w = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
        return got.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= best).select("query_id", F.col("id").alias(id_col))
