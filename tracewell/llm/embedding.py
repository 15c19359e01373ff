"""Near-duplicate vectors: cover trees over cells of vectors, traversed in pairs with covering-radius bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

#: Nodes with no more points than this are not split further.
LEAF = 8
#: Rows of a table of distances that is made at once.
TILE = 1024


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, each row of x to each of y; off by less than 1e-7."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner): points of x farther than radius from each other, so that each point is within radius of one;
    owner is the number of a point's centre. Wide nets are told apart in single precision (the tree measures the radii
    it gets)."""
    x = x.astype(np.float32) if radius > 0.1 else x
    least = 1 - radius * radius / 2
    centres, held = np.zeros(len(x), np.int64), 0
    taken, owner = np.empty_like(x), np.zeros(len(x), np.int64)
    for a in range(0, len(x), 256):
        part, left = x[a : a + 256], np.arange(a, min(a + 256, len(x)))
        if held:
            near = part @ taken[:held].T
            owner[left] = near.argmax(axis=1)
            far = near[np.arange(len(left)), owner[left]] < least
            part, left = part[far], left[far]
        own = part @ part.T >= least
        np.fill_diagonal(own, True)
        free = own.sum(axis=1) == 1
        for i in np.flatnonzero(~free):
            if not free[i]:
                mine = own[i] & ~free
                owner[left[mine]] = held
                free |= mine
                centres[held], taken[held], held = left[i], part[i], held + 1
        lone = np.flatnonzero(own.sum(axis=1) == 1)
        owner[left[lone]] = np.arange(held, held + len(lone))
        centres[held : held + len(lone)], taken[held : held + len(lone)], held = left[lone], part[lone], held + len(lone)
    return centres[:held], owner


class CoverTree:
    """Nested levels with halving radii over unit vectors. The centres of a level are farther apart than its radius and
    cover all points of their node; radius holds the largest distance found, so that every point of a node lies within
    it of the node's centre, itself a point. compared counts the distances that a traversal makes."""

    def __init__(self, x: np.ndarray):
        self.x, self.order, self.compared = x, np.arange(len(x)), 0
        self.center, self.radius, self.begin, self.end, self.children = [0], [float(distances(x, x[:1]).max())], [0], [len(x)], [None]
        todo = [(0, 1.0)]
        while todo:
            node, level = todo.pop()
            a, b = self.begin[node], self.end[node]
            while level > self.radius[node] > 1e-7:
                level /= 2
            if b - a <= LEAF or self.radius[node] <= 1e-7:
                continue
            own = self.order[a:b]
            own = np.concatenate([[self.center[node]], own[own != self.center[node]]])
            centres, owner = net(x[own], level)
            rank = np.argsort(owner, kind="stable")
            self.order[a:b] = own[rank]
            made, at = [], a
            for c, n in zip(own[centres].tolist(), np.bincount(owner, minlength=len(centres)).tolist(), strict=True):
                self.center.append(c)
                self.radius.append(float(distances(x[self.order[at : at + n]], x[c : c + 1]).max()) if n > 1 else 0.0)
                self.begin.append(at)
                self.end.append(at + n)
                self.children.append(None)
                made.append(len(self.center) - 1)
                at += n
            self.children[node] = np.array(made)
            todo += [(m, level / 2) for m in made if self.end[m] - self.begin[m] > LEAF]
        self.center, self.radius, self.begin, self.end = (np.array(v) for v in (self.center, self.radius, self.begin, self.end))
        self.lone, self.coarse = self.end - self.begin == 1, x.astype(np.float32)

    def points(self, node: int) -> np.ndarray:
        return self.order[self.begin[node] : self.end[node]]


def dual_pairs(one: CoverTree, two: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of one, rows of two, sure): lists that together hold every pair within reach of each other, each once; of
    a sure one all pairs are.

    A pair of nodes is dropped when the distance of the centres exceeds reach and both radii, and taken whole when it
    and both radii are within reach. Of the others the node with the larger radius is opened (both, where they are
    alike), and the distances of the children's centres are made as one table (of nodes of one point in single
    precision, with a margin). Two leaves are left to be compared point by point. With one is two each pair of points comes once, and a leaf with itself as itself.
    """
    same = one is two
    alone, lone_reach = np.zeros(1, np.int64), 1 - (reach + 1e-4) ** 2 / 2
    todo = [(alone, alone)]
    while todo:
        many, others = todo.pop()
        own = same and many is others
        (a1, balls1), (a2, balls2) = ((nodes[t.lone[nodes]], nodes[~t.lone[nodes]]) for t, nodes in ((one, many), (two, others)))
        # A list against itself: each tile meets what is not before it, in tiles so small that little comes twice.
        tile = min(TILE, max(1, len(a1) // 32)) if own else TILE
        for first in range(0, len(a1) if len(a2) else 0, tile):
            p, q = one.center[a1[first : first + tile]], two.center[a2[first if own else 0 :]]
            i, j = np.nonzero(one.coarse[p] @ two.coarse[q].T >= lone_reach)
            one.compared += len(p) * len(q)
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield p[i], q[j], None
        tables = [(balls1, balls2), (balls1, a2)] + ([] if own else [(a1, balls2)])
        for left, right in tables:
            half = own and right is balls2
            tile = min(TILE, max(1, len(left) // 32)) if half else TILE
            for first in range(0, len(left) if len(right) else 0, tile):
                rows, cols = left[first : first + tile], right[first:] if half else right
                gap = distances(one.x[one.center[rows]], two.x[two.center[cols]])
                one.compared += gap.size
                around = one.radius[rows][:, None] + two.radius[cols][None, :]
                near = gap <= reach + around + 1e-6
                if half:
                    near &= np.arange(len(rows))[:, None] <= np.arange(len(cols))[None, :]
                whole = gap + around <= reach - 1e-5
                for i, j in zip(*np.nonzero(near), strict=True):
                    a, b = int(rows[i]), int(cols[j])
                    ca, cb = one.children[a], two.children[b]
                    if same and a == b:
                        if ca is None:
                            yield one.points(a), two.points(a), False
                        else:
                            todo.append((ca, ca))
                    elif whole[i, j]:
                        yield one.points(a), two.points(b), True
                    elif ca is None and cb is None:
                        yield one.points(a), two.points(b), False
                    elif cb is None or ca is not None and one.radius[a] > 2 * two.radius[b]:
                        todo.append((ca, np.array([b])))
                    elif ca is None or two.radius[b] > 2 * one.radius[a]:
                        todo.append((np.array([a]), cb))
                    else:
                        todo.append((ca, cb))


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each of n points reaches over the pairs, by repeated minimum."""
    root = np.arange(n)
    if not pairs:
        return root
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Links:
    """Links of the points of two trees, or of one: weighted counts, and pairs that join what is joined."""

    def __init__(self, raw: np.ndarray, times: np.ndarray, threshold: float):
        self.raw, self.times, self.threshold = raw, times, threshold
        self.norm = np.linalg.norm(raw, axis=1)
        self.count, self.pairs = np.zeros(len(raw), np.int64), []
        self.open, self.size = [], 0

    def later(self, i: np.ndarray, j: np.ndarray):
        """Pairs are confirmed many at once."""
        self.open.append((i, j))
        self.size += len(i)
        if self.size > 1 << 16:
            self.finish()

    def finish(self):
        if self.open:
            self.confirm(*(np.concatenate(x) for x in zip(*self.open, strict=True)))
        self.open, self.size = [], 0

    def confirm(self, i: np.ndarray, j: np.ndarray):
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            hit = np.einsum("ij,ij->i", self.raw[p], self.raw[q]) / (self.norm[p] * self.norm[q]) >= self.threshold
            p, q = p[hit], q[hit]
            np.add.at(self.count, p, self.times[q])
            np.add.at(self.count, q, self.times[p])
            self.pairs.append((p, q))

    def take(self, p: np.ndarray, q: np.ndarray, sure: bool | None):
        if sure is None:
            self.later(p, q)
        elif sure:
            self.count[p] += self.times[q].sum()
            self.count[q] += self.times[p].sum()
            self.pairs += [(p, q[:1].repeat(len(p))), (p[:1].repeat(len(q)), q)]
        elif p is q or len(p) == len(q) and (p == q).all():
            i, j = np.triu_indices(len(p), 1)
            self.later(p[i], p[j])
        else:
            self.later(np.repeat(p, len(q)), np.tile(q, len(p)))


def _linker(threshold: float, kind: str = "f8"):
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Both blocks of a pair (or one block with itself): per vector its weighted links, and a root it reaches."""
        pdf = pdf.sort_values("node").reset_index(drop=True)
        raw = _raw(pdf["vec"], kind)
        # Scaled first, so that squares of very small or large numbers stay in range.
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        links = Links(raw, pdf["times"].to_numpy(np.int64), threshold)
        unit = raw / links.norm[:, None]
        at = [np.flatnonzero(pdf["part"].to_numpy() == side) for side in (pdf["low"].iloc[0], pdf["high"].iloc[0])]
        if pdf["low"].iloc[0] == pdf["high"].iloc[0]:
            at = at[:1]
        if all(len(x) for x in at):
            trees = [CoverTree(unit[x]) for x in at]
            for p, q, sure in dual_pairs(trees[0], trees[-1], reach):
                links.take(at[0][p], at[-1][q], sure)
            links.finish()
        root = _roots(len(pdf), links.pairs)
        out = pd.DataFrame({"node": pdf["node"], "links": links.count, "root": pdf["node"].to_numpy()[root]})
        return out[(out["links"] > 0) | (out["node"] != out["root"])]

    return link


def _raw(vectors: pd.Series, kind: str) -> np.ndarray:
    return np.vstack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)


def _units(vectors: pd.Series, kind: str) -> np.ndarray:
    raw = _raw(vectors, kind)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _centrer(block: int, cells: int, kind: str):
    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        """The cells of one large label, from a sample of its vectors: the coarsest level of a cover tree with as many
        centres as blocks are needed; where that has more than cells centres, so many as are needed."""
        pdf = pdf.sort_values(["h", "node"])
        x, wanted = _units(pdf["vec"], kind), min(cells, int(-(-pdf["n"].iloc[0] // block)))
        level, found = 1.0, net(x, 1.0)[0]
        while len(found) < wanted and level > 1e-3:
            level /= 2
            found = net(x, level)[0]
        chosen = found if len(found) <= cells else found[:wanted]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "cell": np.arange(len(chosen), dtype=np.int32), "center": [v.tobytes() for v in x[chosen]]}).astype({"dim": "int32"})

    return centre


def _placer(kind: str):
    def place(pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        """(node, times, vec, cell, away): a part of a label's vectors, each with the nearest of the label's centres."""
        if not len(pdf) or not len(centres):
            return pd.DataFrame({c: [] for c in ("label", "dim", "node", "times", "vec", "cell", "away")})
        centres = centres.sort_values("cell")
        x, c = _units(pdf["vec"], kind), np.vstack([np.frombuffer(v, np.float64) for v in centres["center"]])
        near, away = np.zeros(len(x), np.int32), np.zeros(len(x))
        for a in range(0, len(x), TILE):
            d = distances(x[a : a + TILE], c)
            near[a : a + TILE] = d.argmin(axis=1)
            away[a : a + TILE] = d.min(axis=1)
        return pdf[["label", "dim", "node", "times", "vec"]].assign(cell=near, away=away)

    return place


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = 3000, sample: int = 4096, cells: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Vectors of one label are linked when their cosine in double precision reaches threshold. Equal vectors of a label
    are one node with a count. A label of more than block nodes is dealt to cells: from about sample of its vectors
    the top level of a cover tree is made (at most cells centres; this steers the work, not the result), every vector
    goes to its nearest centre, and a cell of more than block vectors is split by hash. Two parts are compared only if
    their cells' centres are within reach of the threshold and both radii, and of each part only the vectors that
    can be so near to the other cell (triangle inequality) are sent there. A task builds a cover tree of each part and
    traverses both at once, giving exact pairs. Pairs stay in the task; per vector a weighted count of links and
    one root come out, and the roots' links are closed by connected components. Vectors that lie all about the same
    distance apart leave no bound anything to prune; then all parts of a label meet.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
    Vectors of different lengths do not link. Null ids: no component, kept. Rows with the same id and vector count
    as separate vectors. Empty input: no rows. Other columns are not read.
    """
    # Single-precision vectors stay so on disk and between tasks; all arithmetic is in double precision.
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, one_kind = ("f4", "float") if single else ("f8", "double")
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(f"array<{one_kind}>").alias("v"))
    fine = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = src.withColumn("sound", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    src = materialise(src.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(one_kind))).withColumn("h", F.xxhash64("label", "v")))
    good = src.where("sound")
    distinct = good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("times")).withColumn("dim", F.size("v")).select("label", "dim", "h", "node", "times", "v")
    types = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    of = lambda *names: ", ".join(f"{n} {types[n]}" for n in names)
    nodes = materialise(distinct.mapInPandas(_packer(kind), f"{of('label', 'dim', 'h', 'node', 'times')}, vec binary"))

    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > block))
    many = nodes.join(large, ["label", "dim"])
    chosen = many.where(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 30)) < F.lit(sample) / F.col("n") * F.lit(1 << 30))
    centres = materialise(chosen.select("label", "dim", "h", "node", "n", "vec").groupBy("label", "dim").applyInPandas(_centrer(block, cells, kind), f"{of('label', 'dim')}, cell int, center binary"))
    shares = F.ceil(F.col("n") / F.lit(block)).cast("int")
    split = many.withColumn("share", F.pmod(F.xxhash64("h", F.lit("share")), shares).cast("int"))
    spread = centres.join(large, ["label", "dim"]).withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("n")
    placed = split.groupBy("label", "dim", "share").cogroup(spread.groupBy("label", "dim", "share")).applyInPandas(_placer(kind), f"{of('label', 'dim', 'node', 'times')}, vec binary, cell int, away double")
    few = nodes.join(large, ["label", "dim"], "left_anti").select("label", "dim", "node", "times", "vec", F.lit(0).alias("cell"), F.lit(0.0).alias("away"))
    placed = materialise(few.unionByName(placed))
    parts = materialise(placed.groupBy("label", "dim", "cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("pieces")))

    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    pair = "cell1 int, radius1 double, pieces1 int, cell2 int, radius2 double, pieces2 int, gap double"
    met = parts.join(centres, ["label", "dim", "cell"]).groupBy("label", "dim").applyInPandas(_near_cells(reach), f"{of('label', 'dim')}, {pair}")
    alone = [F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in ("cell", "radius", "pieces")]
    met = materialise(met.unionByName(parts.join(large, ["label", "dim"], "left_anti").select("label", "dim", *alone, F.lit(0.0).alias("gap"))))
    sides = met.select("label", "dim", F.col("cell1").alias("cell"), F.col("cell2").alias("other"), F.col("pieces2").alias("pieces"), F.col("radius2").alias("radius"), "gap", F.lit(True).alias("is_low"))
    sides = sides.unionByName(met.where("cell1 < cell2").select("label", "dim", F.col("cell2").alias("cell"), F.col("cell1").alias("other"), F.col("pieces1").alias("pieces"), F.col("radius1").alias("radius"), "gap", F.lit(False).alias("is_low")))
    own = parts.select("label", "dim", "cell", F.col("pieces").alias("own_pieces"))
    numbered = placed.join(own, ["label", "dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("node", F.lit("piece")), F.col("own_pieces")).cast("int"))
    sent = numbered.join(sides, ["label", "dim", "cell"]).where(F.col("gap") - F.col("away") <= F.col("radius") + F.lit(reach + 1e-5)).withColumn("piece2", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    name = lambda cell, piece: F.concat_ws(".", cell, piece)
    here, there = name("cell", "piece"), name("other", "piece2")
    within = F.col("cell") == F.col("other")
    first = F.when(within, F.col("piece") <= F.col("piece2")).otherwise(F.col("is_low"))
    dealt = sent.select("label", "dim", "node", "times", here.alias("part"), F.when(first, here).otherwise(there).alias("low"), F.when(first, there).otherwise(here).alias("high"), "vec")
    told = materialise(dealt.groupBy("label", "dim", "low", "high").applyInPandas(_linker(threshold, kind), f"{of('node')}, links long, root {types['node']}"))
    comps = connected_components(told.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = told.groupBy("node").agg(F.sum("links").alias("links"))
    reached = nodes.select("label", "h", "node", "times").join(counts, "node", "left").join(comps, "node", "left").select("label", "h", "node", F.coalesce("component", "node").alias("reached"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("linked"))
    # A row's own node is the smallest id with its vector: found by the vector, since hashes may clash.
    mine = good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("node")).join(reached, ["label", "h", "node"]).select("label", "h", "v", "reached", "linked")
    out = src.withColumn("label", F.when(F.col("sound"), F.col("label"))).join(mine, ["label", "h", "v"], "left")
    out = out.select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), F.coalesce("reached", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _near_cells(reach: float):
    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of the cells of one label, at most cells of them, whose vectors can be within reach; with the gap of
        their centres, 0 for a cell and itself."""
        pdf = pdf.sort_values("cell").reset_index(drop=True)
        x, radius = np.vstack([np.frombuffer(v, np.float64) for v in pdf["center"]]), pdf["radius"].to_numpy()
        gap = distances(x, x)
        np.fill_diagonal(gap, 0.0)
        i, j = np.nonzero(np.triu(gap <= reach + radius[:, None] + radius[None, :] + 1e-5))
        out = {"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0]}
        for name, at in (("1", i), ("2", j)):
            out |= {f"{c}{name}": pdf[c].to_numpy()[at] for c in ("cell", "radius", "pieces")}
        return pd.DataFrame(out | {"gap": gap[i, j]})

    return near


def _packer(kind: str):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.drop(columns="v").assign(vec=[np.asarray(v, kind).tobytes() for v in pdf["v"]])

    return pack
