"""Compression of vectors to codes: parts of whole numbers, and the nearest entry of a codebook for each.

Nearest entries are found in a geometric near-neighbour access tree (GNAT) over the
entries of a codebook.  A node has split points; every other entry belongs to its
nearest split point, and each pair of a split point and a child stores the range of
distances between them.  A query measures its distance to the split points and drops
a child if some range lies farther from it than the best entry so far, strictly and
after allowing for rounding.  Distances are compared as whole numbers, so ties go to
the lower index exactly.  Many queries walk the tree together as numpy arrays.

Codebooks are small, whatever the table: they are rebuilt on the driver from exact
sums for each entry, which the tasks add up and Spark adds together.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import common, vectors as V

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SPLITS, LEAF = 16, 32                   # split points of a node; a child with fewer entries is a list
ROUNDING = 1e-13                        # relative error that distances may have, many times over

#: For each length of vectors: the codebooks of its parts, one row for each entry.
Codebooks = dict[int, list[np.ndarray]]


def _holder(a: np.ndarray, b: np.ndarray) -> tuple[type, int]:
    """The type that holds squared distances exactly (doubles, 64-bit or Python numbers), and a number above them all."""
    most = 4 * max(V.bound(a), V.bound(b)) ** 2 * max(1, a.shape[1]) + 1
    return np.float64 if most < V.EXACT else np.int64 if most < 1 << 63 else object, most


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    kind, _ = _holder(a, b)
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


class Tree:
    """A GNAT over the rows of ``entries`` that ``held`` names."""

    def __init__(self, entries: np.ndarray, held: np.ndarray | None = None):
        held = np.arange(len(entries)) if held is None else held
        self.entries, self.splits = entries, held
        self.children: list[Tree] = []
        if len(held) <= LEAF:
            return
        far = squared(entries[held], entries[held])
        chosen = [0]
        nearest = far[0].copy()
        while len(chosen) < SPLITS and nearest.max() > 0:         # the next split point is the entry farthest from those before
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, far[chosen[-1]])
        if len(chosen) == 1:
            return                                                # all alike
        chosen.sort()
        distance = np.sqrt(far[chosen].astype(np.float64))
        owner = far[chosen].argmin(axis=0)
        self.splits = held[chosen]
        rest = np.ones(len(held), bool)
        rest[chosen] = False
        self.children = [Tree(entries, held[rest & (owner == j)]) for j in range(len(chosen))]
        self.low, self.high = np.full((2, len(chosen), len(chosen)), np.nan)          # of split point i to the entries below child j
        for j in range(len(chosen)):
            if len(below := np.flatnonzero(rest & (owner == j))):
                self.low[:, j], self.high[:, j] = distance[:, below].min(axis=1), distance[:, below].max(axis=1)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query the index of the nearest entry, the lower one of a tie, its exact squared distance, and how many distances all took."""
        kind, most = _holder(queries, self.entries)
        best, index = np.full(len(queries), most, kind), np.full(len(queries), len(self.entries))
        q, e = queries.astype(kind), self.entries.astype(kind)
        counted = self._walk((q, (q * q).sum(axis=1), e, (e * e).sum(axis=1)), np.arange(len(q)), best, index)
        return index, best, counted

    def _walk(self, known: tuple, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> int:
        """Improve ``best`` and ``index`` of the queries ``rows``; ``known`` holds queries and entries, each with their squared lengths."""
        if not len(rows) or not len(self.splits):
            return 0
        q, q_length, e, e_length = known
        far = q_length[rows, None] + e_length[self.splits] - 2 * (q[rows] @ e[self.splits].T)
        own = far.argmin(axis=1)                                  # split points are in order, so the lowest index of a tie
        found, entry = far[np.arange(len(rows)), own], self.splits[own]
        better = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], entry[better]
        counted = far.size
        if not self.children:
            return counted
        distance = np.sqrt(far.astype(np.float64))
        for first in (True, False):                               # the child of the nearest split point first: it makes the best entry good early
            for j, child in enumerate(self.children):
                some = np.flatnonzero((own == j) == first) if len(child.splits) else []
                if not len(some):
                    continue
                reach = np.sqrt(best[rows[some]].astype(np.float64))[:, None]
                d, low, high = distance[some], self.low[:, j], self.high[:, j]
                apart = (np.maximum(d - high, low - d) - ROUNDING * (d + high) > reach * (1 + ROUNDING)).any(axis=1)
                counted += child._walk(known, rows[some[~apart]], best, index)
        return counted


def _cut(length: int) -> list[int]:
    """Where the parts begin and end; if they cannot be equal, earlier ones are longer by one."""
    return [0, *np.cumsum([length // PARTS + (i < length % PARTS) for i in range(PARTS)]).tolist()]


def _assign(books: Codebooks, trees: dict, d: int, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, values, nearest entries, squared distances) of the vectors ``v``."""
    cut = _cut(d)
    for part in range(PARTS):
        if (d, part) not in trees:
            trees[d, part] = Tree(books[d][part])
        values = v[:, cut[part]:cut[part + 1]]
        entry, far, _ = trees[d, part].nearest(values)
        yield part, values, entry, far


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry becomes the floor of the mean of its parts, unused ones stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held = {}, {}
        for b in batches:
            for d, _, v in V.by_length(b.column("v")):
                for part, values, entry, _ in _assign(books, trees, d, v):
                    if (d, part) not in held:
                        size = (len(books[d][part]), values.shape[1])
                        held[d, part] = [np.zeros(size[0], np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)]
                    own, order = held[d, part], np.argsort(entry, kind="stable")
                    used, first, n = np.unique(entry[order], return_index=True, return_counts=True)
                    own[0][used] += n
                    for i, half in enumerate(V.halves(values), 1):
                        own[i][used] += np.add.reduceat(half[order], first, axis=0)
        for (d, part), (n, upper, lower) in held.items():
            used = np.flatnonzero(n)
            fixed = lambda value, kind: pa.array([value] * len(used), kind)
            yield pa.RecordBatch.from_pydict({"d": fixed(d, pa.int32()), "part": fixed(part, pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(n[used]),
                                              "upper": pa.array(list(upper[used]), pa.list_(pa.int64())), "lower": pa.array(list(lower[used]), pa.list_(pa.int64()))})
    parts = vectors.select("v").mapInArrow(run, "d int, part int, entry int, n bigint, upper array<bigint>, lower array<bigint>")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c.split(".")[-1])
    places = parts.select("d", "part", "entry", "n", F.posexplode(F.arrays_zip("upper", "lower")).alias("i", "h"))
    out = {d: [b.copy() for b in own] for d, own in books.items()}
    for r in places.groupBy("d", "part", "entry", "i").agg(F.sum("n").alias("n"), total("h.upper"), total("h.lower")).collect():      # at most as many numbers as the codebooks have
        out[r.d][r.part][r.entry, r.i] = (int(r.upper) * (1 << 32) + int(r.lower)) // r.n
    return out


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the table (vec_id, v): the parts of the ``entries`` vectors of smallest id, moved ``rounds`` times.

    Equal ids are taken in the order of their vectors, null ids last.
    """
    books: Codebooks = {}
    for r in vectors.groupBy(F.size("v").alias("d")).agg(F.lit(1)).collect():
        first = vectors.where(F.size("v") == r.d).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        start = np.array([x.v for x in first], np.int64).reshape(len(first), r.d)
        cut = _cut(r.d)
        books[r.d] = [start[:, a:z].copy() for a, z in zip(cut, cut[1:])]
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def _encode(books: Codebooks):
    """A ``mapInArrow`` function: the code and squared error of each vector, its other columns unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for b in batches:
            for d, at, v in V.by_length(b.column("v")):
                codes, error = [], np.zeros(len(at), object)
                for _, _, entry, far in _assign(books, trees, d, v):
                    codes.append(entry)
                    error = error + np.array([int(x) for x in far], object)
                digits = max(2, len(f"{max(len(x) for x in books[d]) - 1:x}"))
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(c.tolist() for c in codes))]
                rest = b.select([n for n in b.schema.names if n != "v"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([d] * len(at), pa.int32()), pa.array(code, pa.string()), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())],
                                                 [*rest.schema.names, "d", "code", "error"])
    return run


def codebooks_sha256(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in own for x in book.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(row_id, label, code, error, label_error, codebooks_sha256) of every row with a vector, and the codebooks.

    Rows whose vector is null or holds null or non-finite entries go.  Vectors of
    another length have codebooks of their own.  Parts that cannot be equal differ by
    one in length, and an empty vector is coded without error.  Numbers stay exact up
    to 2 ** 62, where they are cut off; an error or sum beyond 64 bits is null.  Repeated
    rows stay rows; other columns are not used.
    """
    kept = rows.where(V.is_vector(F.col(f"`{vector}`")))
    held = common.stage(kept.select(F.col(f"`{row_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), V.whole(F.col(f"`{vector}`"), SCALE).alias("v")), "whole-vectors")
    books = fit(held, entries, rounds)
    kinds = dict(held.dtypes)
    coded = common.stage(held.mapInArrow(_encode(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, d int, code string, error bigint"), "codes")
    totals = coded.groupBy("label").agg(F.count("*").alias("n"),
                                         F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint").alias("label_error"))
    out = common.join_spread(coded, common.stage(totals, "label-errors"), "label", "n")
    names = rows.sparkSession.createDataFrame([(d, codebooks_sha256(own)) for d, own in books.items()], "length int, codebooks_sha256 string")
    out = out.join(F.broadcast(names), F.col("d") == F.col("length"))
    return out.select(F.col("vec_id").alias(row_id), F.col("label").alias(label), "code", "error", "label_error", "codebooks_sha256"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    out, _ = compress(common.read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Rounds as common table expressions: parts q, codebooks c0 to c4, nearest entries a0 to a4."""
    steps = [f"""k as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"q as (select vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] as v from k, range({PARTS}) as r(p))",
             f"f as (select vec_id, row_number() over (order by vec_id) - 1 as e from k order by vec_id limit {ENTRIES})",
             "c0 as (select p, e, v from q join f using (vec_id))"]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} as (select q.vec_id, any_value(q.label) as label, q.p, any_value(q.v) as v,
  min({{'d': list_dot_product(q.v, q.v) + list_dot_product(c.v, c.v) - 2 * list_dot_product(q.v, c.v), 'e': c.e}}) as m from q join c{i} c on c.p = q.p group by q.vec_id, q.p)""")
        if i < ROUNDS:
            steps.append(f"""s{i} as (select p, e, list(x order by i) as v from (select p, m.e as e, i, floor(sum(v[i]) / count(*)) as x from a{i}, range(1, (select len(v) // {PARTS} + 1 from k limit 1)) as r(i) group by 1, 2, 3) group by 1, 2),
c{i + 1} as (select c.p, c.e, coalesce(s.v, c.v) as v from c{i} c left join s{i} s on s.p = c.p and s.e = c.e)""")
    last = ROUNDS
    return "with " + ",\n".join(steps) + f""",
r as (select vec_id, any_value(label) as label, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error from a{last} group by vec_id),
t as (select label, cast(sum(error) as bigint) as label_error from r group by label),
h as (select sha256(string_agg(array_to_string(list_transform(v, lambda x: cast(cast(x as bigint) as varchar)), ','), ',' order by p, e)) as codebooks_sha256 from c{last})
select r.vec_id, r.code, r.error, t.label_error, h.codebooks_sha256 from r join t on t.label is not distinct from r.label, h"""


OP12_SQL = _oracle()
