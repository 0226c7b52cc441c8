"""Embedding near-duplicates: PCA-ordered tiled comparison.

Vectors are compared only within a label. They are scaled to length 1 and
turned into the principal axes of all valid vectors, strongest first (the
axes come from one matrix of sums over the whole table, see AXES). Equal vectors of a
label become one, with their number. A label's vectors are ordered along the
first axis and cut into tiles; tiles meet only if their ranges on that axis
allow the threshold, and each meeting is a row of its own, so that a hot label
spreads over all tasks.

Within a meeting the leading axes are multiplied first. What the other axes
can add is at most the product of the two suffix norms, so a pair is dropped
as soon as sum so far + bound is under the threshold; only survivors go on to
the next block of axes, and those left are decided in double precision on the
vectors as given. A meeting hands on counts of links and connections, never a
row for each pair.

Null vectors and labels, zero vectors and ones with null or non-finite
components link with nothing. Vectors of another dimension than most of the
table are compared among their own dimension only. Rows that repeat an id are
vectors of their own that share the id (they link when alike). Vectors at the
threshold exactly link. An empty table gives no rows. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel
from quern.llm.components import components

AXES = (8, 1024)  # matrices that are sent to all tasks, at most, and their dimension: 64 MB together
SLACK = 1e-7  # bounds are compared with this much room; what is left is decided exactly


def valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v, d) of those that can link; v as array of doubles."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), F.size(v).alias("d"))


def unit(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack(frame["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # very large and very small components would not survive a square
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Of the most frequent dimensions within AXES, the principal axes as columns. One matrix of sums for each task and dimension is added up.

    Vectors of other dimensions are compared along their axes as given: the bounds hold for any, they only prune less.
    """
    often = rows.where(F.col("d") <= AXES[1]).groupBy("d").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").limit(AXES[0])
    rows = rows.join(F.broadcast(often.select("d")), "d", "left_semi")

    def work(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for d, own in frame.groupby("d"):
                x = unit(own)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pd.DataFrame({"d": [d] * d, "i": range(d), "row": list(m)})

    parts = rows.select("v", "d").mapInPandas(work, "d int, i int, row array<double>")
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    out = {}
    for d, own in cells.toArrow().to_pandas().groupby("d"):
        m = np.zeros((d, d))
        m[own["i"], own["j"]] = own["x"]
        _, vectors = np.linalg.eigh((m + m.T) / 2)
        out[int(d)] = vectors[:, ::-1].copy()
    return out


def turned(rows: DataFrame, by: dict[int, np.ndarray]) -> DataFrame:
    """rows with p0, the unit vector's component on the first principal axis."""

    def work(frames):
        for frame in frames:
            for d, own in frame.groupby("d"):
                yield own.assign(p0=unit(own) @ by[int(d)][:, 0] if int(d) in by else unit(own)[:, 0])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInPandas(work, fields + ", p0 double")


def compare(a: dict, b: dict, threshold: float, block: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) with cosine >= threshold; a and b hold p and v as matrices."""
    p, q, d = a["p"], b["p"], a["p"].shape[1]
    cuts = [*range(block, d, 2 * block), d]
    total = p[:, : cuts[0]] @ q[:, : cuts[0]].T

    def suffix(x, k):
        return np.sqrt(np.maximum((x[:, k:] ** 2).sum(1), 0))

    alive = total + suffix(p, cuts[0])[:, None] * suffix(q, cuts[0])[None] >= threshold - SLACK
    if same:
        alive &= np.arange(len(p))[:, None] < np.arange(len(q))[None]
    i, j = np.nonzero(alive)
    total = total[i, j]
    for k, until in zip(cuts, cuts[1:]):
        total = total + np.einsum("ij,ij->i", p[i, k:until], q[j, k:until])
        keep = total + suffix(p, until)[i] * suffix(q, until)[j] >= threshold - SLACK
        i, j, total = i[keep], j[keep], total[keep]
    x, y = a["v"], b["v"]
    dot = np.einsum("ij,ij->i", x[i], y[j])
    norm = a["norm"][i] * b["norm"][j]
    keep = dot / norm >= threshold
    return i[keep], j[keep]


def links(vectors: DataFrame, threshold: float = 0.93, tile: int = 512, block: int = 8, id_col="vec_id", vec_col="embedding", label_col="label"):
    """(members, found): members (id, row, cls, n) of classes of n equal vectors; what links between classes come to, as gathered() gives it."""
    rows = kernel.written(valid(vectors, id_col, vec_col, label_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # equal vectors of a label meet by value; one of them stands for all
    key = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    keyed = rows.select("id", "row", "label", "v", "d", key.alias("key"))
    classes = keyed.groupBy("label", "key").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("n"))
    members = kernel.written(keyed.select("id", "row", "label", "key").join(classes, ["label", "key"]).select("id", "row", "cls", "n"), "members")
    single = keyed.select("row", "label", "v", "d").join(classes.select(F.col("cls").alias("row"), "n"), "row").select("row", "label", "v", "d", "n")
    by = axes(single)
    # tiles along the first axis, cut from one order of all labels
    placed = kernel.in_order(turned(single, by), ["label", "d", "p0", "row"], "turned", "nth")
    placed = kernel.written(placed.withColumn("tile", F.floor(F.col("nth") / tile)).select("label", "d", "tile", "row", "p0", "n", "v"), "tiles")
    ranges = placed.groupBy("label", "d", "tile").agg(F.min("p0").alias("lo"), F.max("p0").alias("hi"))
    ranges = kernel.written(ranges, "ranges")
    # two unit vectors with first components x and y have a cosine of at most x*y + sqrt((1-x*x)(1-y*y)),
    # the cosine of the difference of their angles: tiles meet if the gap between their ranges of angles allows it
    angles = ranges.select("label", "d", "tile", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "hi"))).alias("lo"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "lo"))).alias("hi"))
    x, y = angles.alias("x"), angles.alias("y")
    reach = float(np.arccos(threshold)) + 1e-6
    near = F.expr(f"x.label = y.label AND x.d = y.d AND x.tile <= y.tile AND greatest(x.lo, y.lo) - least(x.hi, y.hi) <= {reach!r}")
    meetings = x.join(y, near).select(F.col("x.label").alias("label"), F.col("x.d").alias("d"), F.col("x.tile").alias("ta"), F.col("y.tile").alias("tb"))
    meetings = meetings.withColumn("meeting", F.xxhash64("label", "d", "ta", "tb"))
    meetings = kernel.written(meetings, "meetings")
    # each tile as one row of packed numbers, so that a meeting is a join of two rows
    packed = placed.groupBy("label", "d", "tile").applyInPandas(pack, "label " + dict(placed.dtypes)["label"] + ", d int, tile long, rows binary, n binary, v binary")
    packed = kernel.written(packed, "packed")
    left = packed.select("label", "d", F.col("tile").alias("ta"), F.col("rows").alias("ra"), F.col("n").alias("na"), F.col("v").alias("va"))
    right = packed.select("label", "d", F.col("tile").alias("tb"), F.col("rows").alias("rb"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    met = meetings.join(left, ["label", "d", "ta"]).join(right, ["label", "d", "tb"])

    def work(frames):
        for frame in frames:
            for m in frame.itertuples():
                a, b = (unpack(*own, by.get(m.d), m.d) for own in ((m.ra, m.na, m.va), (m.rb, m.nb, m.vb)))
                yield gathered(a, b, *compare(a, b, threshold, block, m.ta == m.tb))

    found = met.select("d", "ta", "tb", "ra", "na", "va", "rb", "nb", "vb").mapInPandas(work, "a long, b long, n long")
    return members, kernel.written(found, "links")


def gathered(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """What a meeting's links come to, at most a few rows a vector: (a, null, n) n vectors are linked with a; (a, b, null) a and b are connected."""
    rows = np.concatenate([a["rows"], b["rows"]])
    ends = np.concatenate([i, j + len(a["rows"])])
    linked = np.bincount(ends, np.concatenate([b["n"][j], a["n"][i]]), len(rows)).astype(np.int64)
    rows, place = np.unique(rows, return_inverse=True)  # a tile that meets itself has its rows twice
    counts = np.bincount(place, linked, len(rows)).astype(np.int64)
    x, y, label = place[i], place[j + len(a["rows"])], np.arange(len(rows))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some, moved = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({
        "a": np.concatenate([rows[some], rows[moved]]),
        "b": pd.array([*[None] * len(some), *rows[label[moved]].tolist()], "Int64"),
        "n": pd.array([*counts[some].tolist(), *[None] * len(moved)], "Int64"),
    })


def pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["p0", "row"])
    v = np.stack(frame["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"label": [frame["label"].iloc[0]], "d": [frame["d"].iloc[0]], "tile": [frame["tile"].iloc[0]], "rows": [frame["row"].to_numpy(np.int64).tobytes()], "n": [frame["n"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()]})


def unpack(rows: bytes, n: bytes, v: bytes, turn: np.ndarray | None, d: int) -> dict:
    v = np.frombuffer(v).reshape(-1, d)
    v = v / np.abs(v).max(1, keepdims=True)
    norm = np.sqrt((v * v).sum(1))
    return {"rows": np.frombuffer(rows, np.int64), "n": np.frombuffer(n, np.int64), "p": v / norm[:, None] if turn is None else (v / norm[:, None]) @ turn, "v": v, "norm": norm}


def groups(vectors: DataFrame, threshold: float = 0.93, id_col="vec_id", vec_col="embedding", label_col="label", **how) -> DataFrame:
    """(id, n_links, component_id) for each row of vectors."""
    members, found = links(vectors, threshold, id_col=id_col, vec_col=vec_col, label_col=label_col, **how)
    sizes = members.groupBy("cls").agg(F.first("n").alias("n"), F.min("id").alias("least"))
    # what a class links with: its own other members and all members of linked classes
    across = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("across"))
    label = components(found.where("b IS NOT NULL"), "a", "b").select(F.col("node").alias("cls"), "label")
    known = sizes.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(least, "label").join(across.withColumnRenamed("a", "cls"), "cls", "left")
    per_class = known.select("cls", (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"), "component_id")
    linked = members.join(per_class, "cls").select(F.col("id").alias("_id"), "n_links", "component_id")
    rest = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    v = F.col("v").cast("array<double>")
    out = F.col("label").isNull() | v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    alone = rest.where(F.coalesce(out, F.lit(True))).select(F.col("id").alias("_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id")
