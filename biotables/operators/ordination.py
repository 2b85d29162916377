"""Principal coordinates of a distance table ``(id_a, id_b, dist)``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotables.operators.reshape import dense_index
from biotables.session import materialize

BLOCK = 512  # points per side of a dense block (2 MB)
EXTRA = 4  # additional directions that speed up the iteration
BASIS = 120  # columns of the basis before it starts again


def both_directions(pairs: DataFrame, value: str) -> DataFrame:
    swapped = pairs.select(F.col("id_b").alias("i"), F.col("id_a").alias("j"), F.col(value))
    return pairs.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), value).unionByName(swapped)


def double_center(dist: DataFrame) -> DataFrame:
    """``b = -(d2 - rowmean_i - rowmean_j + grandmean) / 2`` for ``i <= j``, diagonal included."""
    square = dist.select("id_a", "id_b", (F.col("dist") * F.col("dist")).alias("d2"))
    sums = both_directions(square, "d2").groupBy("i").agg(
        F.sum("d2").alias("s"), (F.count(F.lit(1)) + 1).alias("n")
    )
    means = sums.select("i", (F.col("s") / F.col("n")).alias("m"))
    grand = sums.agg(F.sum("s") / F.max("n") / F.max("n")).scalar()
    diagonal = means.select(F.col("i").alias("id_a"), F.col("i").alias("id_b"), F.lit(0.0).alias("d2"))
    left = means.select(F.col("i").alias("id_a"), F.col("m").alias("ma"))
    right = means.select(F.col("i").alias("id_b"), F.col("m").alias("mb"))
    return (
        square.unionByName(diagonal)
        .join(left, "id_a")
        .join(right, "id_b")
        .select(
            "id_a",
            "id_b",
            (-0.5 * (F.col("d2") - F.col("ma") - F.col("mb") + grand)).alias("b"),
        )
    )


# ---------------------------------------------------------------- dense blocks of the centred matrix


def _as_matrix(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, columns)


def _blocks(centered: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """Square blocks ``(row_block, column_block, cells)`` of the upper half; at most BLOCK x BLOCK numbers each."""
    left = points.select(F.col("id").alias("id_a"), F.col("place").alias("i"))
    right = points.select(F.col("id").alias("id_b"), F.col("place").alias("j"))
    cells = centered.join(left, "id_a").join(right, "id_b")
    cells = cells.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "b")
    keyed = cells.select(
        F.expr(f"int(i div {BLOCK})").alias("row_block"), F.expr(f"int(j div {BLOCK})").alias("column_block"), "i", "j", "b"
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = int(pdf["row_block"].iloc[0]), int(pdf["column_block"].iloc[0])
        m = np.zeros((min(BLOCK, n - r * BLOCK), min(BLOCK, n - c * BLOCK)))
        i, j = pdf["i"].to_numpy() - r * BLOCK, pdf["j"].to_numpy() - c * BLOCK
        m[i, j] = pdf["b"]
        if r == c:
            m[j, i] = pdf["b"]
        return pd.DataFrame({"row_block": [r], "column_block": [c], "cells": [m.tobytes()]})

    schema = "row_block int, column_block int, cells binary"
    return materialize(keyed.groupBy("row_block", "column_block").applyInPandas(fill, schema), "blocks")


def _times(blocks: DataFrame, basis: DataFrame, columns: int) -> DataFrame:
    """``block, w``: the matrix times the columns ``x`` of ``basis``."""

    def multiply(flipped: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for cells, x in zip(pdf["cells"], pdf["x"]):
                    x = _as_matrix(x, columns)
                    m = np.frombuffer(cells, dtype=np.float64)
                    m = m.reshape(len(x), -1).T if flipped else m.reshape(-1, len(x))
                    out.append((m @ x).tobytes())
                yield pd.DataFrame({"block": pdf["block"], "w": out})

        return run

    x = basis.select("block", "x")
    straight = blocks.join(x.withColumnRenamed("block", "column_block"), "column_block")
    turned = blocks.filter("row_block <> column_block").join(x.withColumnRenamed("block", "row_block"), "row_block")
    parts = straight.select(F.col("row_block").alias("block"), "cells", "x").mapInPandas(multiply(False), "block int, w binary").unionByName(
        turned.select(F.col("column_block").alias("block"), "cells", "x").mapInPandas(multiply(True), "block int, w binary")
    )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, dtype=np.float64) for w in pdf["w"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "w": [total.tobytes()]})

    return parts.groupBy("block").applyInPandas(add, "block int, w binary")


def _products(table: DataFrame, of, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of the matrix that ``of`` makes of one row; only its entries reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                total += of(row)
        yield pd.DataFrame({"cell": np.arange(total.size), "total": total.ravel()})

    sums = table.mapInPandas(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(shape[0] * shape[1])
    for cell, total in sums:
        out[cell] = total
    return out.reshape(shape)


def _map_rows(table: DataFrame, to, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([to(row) for row in pdf.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    return table.mapInPandas(run, schema)


def _unit(gram: np.ndarray, scale: float) -> np.ndarray:
    """``E`` so that ``w @ E`` has orthonormal columns, for ``gram = w.T @ w``; dependent directions are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(scale, 1e-300) * 1e-22
    return vectors[:, keep] / np.sqrt(values[keep])


def leading_axes(blocks: DataFrame, points: DataFrame, axes: int, trace: float, rounds: int, tolerance: float) -> DataFrame:
    """``id, axis, coordinate, eigenvalue, relative`` for the largest positive eigenvalues.

    Block Lanczos with Rayleigh-Ritz: the basis grows by the matrix times its last columns, so the ends of
    the spectrum appear first, whatever negative eigenvalues there are. A basis above ``BASIS`` columns
    starts again from its best vectors. Ends when every wanted axis has a residual below ``tolerance`` times the largest
    eigenvalue; raises after ``rounds`` without it.
    """
    p = axes + EXTRA

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values("place")
        seeds = [np.frombuffer(hashlib.md5(f"{v}|{k}".encode()).digest()[:8], "<u8")[0] for v in pdf["id"] for k in range(p)]
        x = (np.array(seeds, dtype=np.float64) / 2.0**63 - 1).reshape(-1, p)
        return pd.DataFrame({"block": [block], "k": [b""], "x": [x.tobytes()]})

    start = points.withColumn("block", F.expr(f"int(place div {BLOCK})")).groupBy("block").applyInPandas(begin, "block int, k binary, x binary")
    table = materialize(start, "axes-start")
    unit = _unit(_products(table, lambda r: _as_matrix(r.x, p).T @ _as_matrix(r.x, p), (p, p)), 1.0)

    def first_columns(row):
        x = _as_matrix(row.x, p) @ unit
        return row.block, x.tobytes(), x.tobytes()

    table = materialize(_map_rows(table, first_columns, "block int, k binary, x binary"), "axes-first")
    m = width = unit.shape[1]
    h = np.zeros((0, 0))
    for round_no in range(rounds):
        step = materialize(table.join(_times(blocks, table, width), "block"), f"axes-{round_no}")
        c = _products(step, lambda r, m=m, q=width: _as_matrix(r.k, m).T @ _as_matrix(r.w, q), (m, width))
        grown = np.zeros((m, m))
        grown[: len(h), : len(h)] = h
        grown[:, m - width :] = c
        grown[m - width :, :] = c.T
        h = (grown + grown.T) / 2

        def rest(r, m=m, q=width, c=c):
            k = _as_matrix(r.k, m)
            w = _as_matrix(r.w, q) - k @ c
            return np.vstack([k.T @ w, w.T @ w])

        again = _products(step, rest, (m + width, width))
        fix, gram = again[:m], again[m:] - again[:m].T @ again[:m]
        values, vectors = np.linalg.eigh(h)
        order = np.argsort(-values)[:axes]
        order = order[values[order] > 1e-12 * max(abs(trace), 1e-300)]
        largest = np.abs(values).max(initial=0.0)
        unit = _unit(gram, largest**2)
        # what the matrix adds outside of the basis: norm of the last coefficients in that direction
        gap, turn = np.linalg.eigh((gram + gram.T) / 2)
        size = np.sqrt(np.maximum(gap, 0))[:, None] * turn.T
        residual = np.linalg.norm(size @ vectors[m - width :, order], axis=0)
        if unit.shape[1] == 0 or (len(order) == axes and (residual <= tolerance * largest).all()) or largest == 0:
            break
        correct, keep = c + fix, vectors[:, np.argsort(-values)[:p]]
        restart = m + unit.shape[1] > BASIS

        def extend(r, m=m, q=width, correct=correct, unit=unit, restart=restart, keep=keep):
            k = _as_matrix(r.k, m)
            if restart:
                x = k @ keep
                return r.block, x.tobytes(), x.tobytes()
            x = (_as_matrix(r.w, q) - k @ correct) @ unit
            return r.block, np.hstack([k, x]).tobytes(), x.tobytes()

        table = materialize(_map_rows(step, extend, "block int, k binary, x binary"), f"axes-basis-{round_no}")
        width = keep.shape[1] if restart else unit.shape[1]
        m = width if restart else m + width
        h = np.zeros((0, 0)) if restart else h
    else:
        raise ValueError(f"the axes did not converge in {rounds} rounds")
    chosen, found = vectors[:, order], values[order]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                y = _as_matrix(row.k, m) @ chosen
                n = len(y)
                yield pd.DataFrame(
                    {
                        "place": np.repeat(row.block * BLOCK + np.arange(n), len(found)),
                        "axis": np.tile(np.arange(1, len(found) + 1), n),
                        "u": y.ravel(),
                    }
                )

    entries = materialize(step.select("block", "k").mapInPandas(place, "place long, axis long, u double").join(points, "place"), "axes")
    # the largest entry of an axis is positive; of entries alike up to rounding, that of the smallest id
    size = F.round(F.abs("u"), 9)
    signs = entries.groupBy("axis").agg(F.signum(F.max_by("u", F.struct(size, -F.col("place")))).alias("sign"))
    scale = F.element_at(F.array(*[F.lit(float(np.sqrt(v))) for v in found]), F.col("axis").cast("int"))
    value = F.element_at(F.array(*[F.lit(float(v)) for v in found]), F.col("axis").cast("int"))
    if not len(found):
        return no_axes(points)
    return entries.join(F.broadcast(signs), "axis").select(
        "id", "axis", (F.col("u") * F.col("sign") * scale).alias("coordinate"), value.alias("eigenvalue"), (value / F.lit(float(trace))).alias("relative")
    )


def no_axes(points: DataFrame) -> DataFrame:
    """No axes: all points coincide."""
    return points.limit(0).select(
        "id", F.lit(0).cast("long").alias("axis"), F.lit(0.0).alias("coordinate"), F.lit(0.0).alias("eigenvalue"), F.lit(0.0).alias("relative")
    )


def pcoa(dist: DataFrame, axes: int = 2, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """Coordinates ``(id, axis, coordinate, eigenvalue, relative)`` on the leading axes.

    One iteration for every number of points; the distances are stored once. Fewer positive
    eigenvalues than ``axes`` give fewer axes. The sign of an axis makes its largest entry positive.
    """
    dist = materialize(dist, "distances")
    centered = materialize(double_center(dist), "centered")
    diagonal = centered.filter(F.col("id_a") == F.col("id_b"))
    points = materialize(dense_index(diagonal.select(F.col("id_a").alias("id")), ["id"], "place"), "points")
    n, trace = diagonal.agg(F.count(F.lit(1)), F.sum("b")).first()
    if not n:
        return no_axes(points)
    return leading_axes(_blocks(centered, points, n), points, min(axes, n), trace, rounds, tolerance)
