"""Near-duplicates by a chosen-path set similarity join on word shingles.

Documents with equal shingle sets are one class.  Classes walk down random trees:
a node selects two min-wise tokens of a document's signature, and for each of them
the document goes to the child that the token names.  Two sets of similarity s
share a child with probability 1 - (1 - s)^2, and a node of any depth with at
least (2 s - 1) / s^2, which is 0.97 at s = 0.85; four independent trees miss a
link there about once in a million, and at 0.8 about once in 65,000.  Nodes with at most LIMIT classes, and at most SHINGLES shingles in them, are compared
exhaustively, larger ones branch again.  What is still too large at DEPTH is dealt
into blocks that are compared pairwise, so no pair is lost.

Near copies stay together in every branch, so a large group of them is linked first:
each class is compared once or twice in a block of its large nodes that also holds
some classes that all blocks of the node share.  Two classes that are known to be in
one component need not meet again.  Nodes of one component end there, and where one
component has most of a node, its members are dealt into blocks that only the other
classes of the node visit.

A node first drops classes without a partner of fitting signature in another
component, or whose pairs an earlier node of at most LIMIT classes compares: one that
branches may part them.
A signature does not fit a link at the threshold about once in 6 million at 0.85,
and once in 50 million at 0.8.  Its tokens have 16 bits, so different ones are taken
for equal once in 65,536, which adds candidates and drops none.  The texts of the rest are brought together, links are
confirmed on their full sets, and each node gives at most one link for each class,
to the smallest that it reaches.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veilframe.llm import common, words as W
from veilframe.llm.components import components

SHINGLE, PERCENT = 3, 85
TOKENS, TREES, START, DEPTH = 64, 4, 2, 12
LIMIT = 2048
SHINGLES = 1 << 24        # of all classes of a node together
SHARED = 4                # classes that all blocks of a large node hold
MEETINGS = 2              # large nodes in which a class is linked first
MARGIN = 6.0              # standard deviations that an estimate may lie below the threshold
LAST = (1 << 63) - 1
COLUMNS = 1024            # shingles whose occurrences are held as a matrix at a time
ROWS = 256                # classes of a node that are compared with all others at a time

_MULTIPLY = W.mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted hashes; a text with fewer words is one shingle, one without words has none."""
    w = W.words(texts, W.BY_SPACE, W.LOWER)
    h = w.hashes()
    g = W.grams(h, size)
    out = []
    for a, z in zip(w.first.tolist(), w.first[1:].tolist()):
        if z - a >= size:
            out.append(np.unique(g[a:z - size + 1]))
        else:
            out.append(W.grams(h[a:z], z - a, 1) if z > a else np.zeros(0, np.uint64))
    return out


def _children(node: np.ndarray, signature: np.ndarray) -> np.ndarray:
    """The two children of each document's node, named by the tokens that the node selects."""
    row, out = np.arange(len(node)), []
    for branch in range(2):
        token = (W.mix(node + np.uint64(branch + 1)) % np.uint64(TOKENS)).astype(np.int64)
        out.append(W.mix(node * np.uint64(0xD6E8FEB86659FD93) + (np.uint64(branch) << np.uint64(63)) + signature[row, token].astype(np.uint64) + (token.astype(np.uint64) << np.uint64(40))))
    return np.stack(out, axis=1)


def _start_nodes(signature: np.ndarray) -> np.ndarray:
    """The nodes of all trees at depth START: one row for each document."""
    trees = []
    for tree in range(TREES):
        nodes = np.full((len(signature), 1), W.mix(np.array([tree + 1], np.uint64))[0])
        for _ in range(START):
            nodes = np.concatenate([_children(n, signature) for n in nodes.T], axis=1)
        trees.append(nodes)
    return np.concatenate(trees, axis=1)


def _signatures(column: pa.Array) -> np.ndarray:
    """One row of tokens for each signature; their length tells how wide a token is."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), f"u{len(rows[0]) // TOKENS}").reshape(len(rows), TOKENS)


def _measure(base: DataFrame, size: int) -> DataFrame:
    """Each document's set size, two hashes of its set, and its signature."""
    kind = dict(base.dtypes)["doc_id"]

    def make():
        def f(piece):
            sets = shingle_sets(piece.column("text"), size)
            n = np.array([len(s) for s in sets], np.int64)
            own = np.flatnonzero(n)
            values = np.concatenate([sets[i] for i in own] or [np.zeros(0, np.uint64)])
            first = np.concatenate([[0], np.cumsum(n[own])[:-1]]).astype(np.int64)
            sums = np.zeros((2, len(n)), np.uint64)
            signature = np.zeros((len(n), TOKENS), np.uint16)
            if len(own):
                for i in range(2):
                    sums[i, own] = np.add.reduceat(W.mix(values + np.uint64(i)), first)
                for i, m in enumerate(_MULTIPLY):
                    # 16 mixed bits of the least hash: its own upper bits are mostly zero
                    signature[own, i] = W.mix(np.minimum.reduceat(values * m, first)) >> np.uint64(48)
            return {c: piece.column(c) for c in ("doc_id", "doc", "th")} | {
                "n": pa.array(n), "c1": pa.array(sums[0].view(np.int64)), "c2": pa.array(sums[1].view(np.int64)),
                "signature": pa.array([s.tobytes() for s in signature], pa.binary())}
        return f
    return common.map_pieces(base, "text", make, f"doc_id {kind}, doc bigint, th bigint, n bigint, c1 bigint, c2 bigint, signature binary")


def _large(limit: int) -> Column:
    return (F.col("k") > limit) | (F.col("w") > SHINGLES)


def _blocks(classes: Column, shingles: Column, limit: int) -> Column:
    """How many blocks of half the size of a node are needed."""
    return F.greatest(F.ceil(2 * classes / limit), F.ceil(2 * shingles / SHINGLES)).cast("int")


def _sized(members: DataFrame) -> DataFrame:
    """(node, cid, n, k, w) of nodes with several classes: how many, and their shingles.

    Most nodes have one class alone.  What is left is written down, because all that follows
    starts from it more than once.
    """
    counts = members.groupBy("node").agg(F.count("*").alias("k"), F.sum("n").alias("w")).where("k > 1")
    return common.stage(common.few_files(members.join(counts, "node"), members.count()), "shared-nodes")


def _first_meetings(sized: DataFrame, limit: int) -> DataFrame | None:
    """(node, cid) of blocks of large start nodes, for linking groups of near copies; null if no node is large.

    Each class is in one block of MEETINGS of its large nodes, the ones with the smallest numbers, which near copies mostly share.
    """
    there = sized.where(_large(limit))
    if not there.limit(1).count():
        return None
    few = there.groupBy("cid").agg(F.slice(F.array_sort(F.collect_set(F.struct("node", "k", "w"))), 1, MEETINGS).alias("nodes")).select("cid", F.inline("nodes"))
    count = F.greatest(2 * _blocks(F.col("k"), F.col("w"), limit), F.lit(1))
    dealt = few.select("node", "cid", F.pmod(F.xxhash64("cid", "node"), count).cast("int").alias("i"))
    shared = there.groupBy("node").agg(F.first("k").alias("k"), F.first("w").alias("w"), F.array_distinct(F.array(*[F.min_by("cid", F.xxhash64("cid", F.lit(i))) for i in range(SHARED)])).alias("cids"))
    shared = shared.select("node", F.explode("cids").alias("cid"), F.sequence(F.lit(0), count - 1).alias("all")).select("node", "cid", F.explode("all").alias("i"))
    return dealt.unionByName(shared).select(F.xxhash64("node", "i").alias("node"), "cid").distinct()


def _in_nodes(members: DataFrame, classes: DataFrame, limit: int, known: DataFrame | None = None, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(node, cid, start) of nodes with 2 to ``limit`` classes, from (node, cid, n); larger nodes branch or are dealt into blocks.

    ``sized`` is what ``_sized`` says of ``members``, if it is known.  ``known`` has components (cid, label) that need no more links inside.  Also
    (cid, large): the start nodes of a class that are larger, if there are any.
    """
    out, depth, parted = None, START, None
    while True:
        sized = _sized(members) if sized is None else sized
        own = sized.where(~_large(limit)).select("node", "cid", F.lit(depth == START).alias("start"))
        out = own if out is None else out.unionByName(own)
        if not sized.where(_large(limit)).limit(1).count():
            return out, parted
        large = sized.where(_large(limit)).withColumn("label", F.col("cid"))
        if depth == START:
            parted = large.groupBy("cid").agg(F.collect_set("node").alias("large"))
        if known is not None:
            large = large.drop("label").join(known, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        labels = large.groupBy("node", "label").agg(F.count("*").alias("same"), F.sum("n").alias("same_w"))
        most = labels.groupBy("node").agg(F.max(F.struct("same", "same_w", "label")).alias("most"))
        large = large.join(most, "node").where("most.same < k")                    # of one component: nothing is left to link
        large = common.stage(large, "large-nodes")
        ruled = F.col("k") - F.col("most.same") <= limit // 2
        blocks = _blocks(F.col("most.same"), F.col("most.same_w"), limit)
        places = F.when(F.col("label") == F.col("most.label"), F.array(F.pmod(F.xxhash64("cid"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        visited = large.where(ruled).select("node", "cid", F.explode(places).alias("i"))
        out = out.unionByName(visited.select(F.xxhash64("node", "i").alias("node"), "cid", F.lit(False).alias("start")))
        large = large.where(~ruled)
        if depth >= DEPTH:
            blocks = _blocks(F.col("k"), F.col("w"), limit)
            dealt = large.select("node", "cid", blocks.alias("m"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("i"))
            pairs = dealt.select("node", "cid", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
            return out.unionByName(pairs.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "cid", F.lit(False).alias("start"))), parted
        depth += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    nodes = _children(b.column("node").to_numpy().view(np.uint64), _signatures(b.column("signature")))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), *[pa.array(np.repeat(b.column(c).to_numpy(), 2)) for c in ("cid", "n")]], ["node", "cid", "n"])
        members = common.stage(large.select("node", "cid").join(classes.select("cid", "n", "signature"), "cid").select("node", "cid", "n", "signature")
                               .mapInArrow(run, "node bigint, cid bigint, n bigint"), "nodes")       # no child comes twice: parents and branches differ
        sized = None


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one node after the other, from batches in the order of nodes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        node = b.column("node").to_numpy()
        at = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), b.num_rows]
        for a, z in zip(at, at[1:]):
            part = b.slice(a, z - a)
            if held and held[0].column("node")[0] != part.column("node")[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _with_partner(least: float):
    """A ``mapInArrow`` function: classes of a node that have a partner there, by estimate, of another component, not met in an earlier node that compares them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            signature = _signatures(group.column("signature").combine_chunks())
            keep = np.zeros(len(signature), bool)
            nodes = _start_nodes(signature)
            here = np.flatnonzero((nodes == np.uint64(group.column("node")[0].as_py() & 0xFFFFFFFFFFFFFFFF)).any(axis=0)) if group.column("start")[0].as_py() else []
            earlier = nodes[:, :here[0]] if len(here) else nodes[:, :0]
            large = group.column("large").combine_chunks()
            parted = np.unique(large.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
            compared = ~np.isin(earlier, parted)
            label = group.column("label").to_numpy()
            step = max(1, (1 << 21) // (len(signature) * TOKENS))
            for a in range(0, len(signature), step):
                part = slice(a, a + step)
                near = (signature[part, None, :] == signature[None, :, :]).sum(axis=2) >= least * TOKENS
                for i in range(earlier.shape[1]):
                    near &= (earlier[part, None, i] != earlier[None, :, i]) | ~compared[part, None, i]
                near &= label[part, None] != label[None, :]
                keep[part] |= near.any(axis=1)
            if keep.any():
                kept = group.select(["node", "cid"]).filter(pa.array(keep))
                yield from kept.to_batches()
    return run


def _link(percent: int, size: int):
    """A ``mapInArrow`` function: confirmed links of each node, from every class to the smallest one that it reaches there."""
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            for piece in common.pieces(batch, "text"):
                yield from zip(piece.column("node").to_pylist(), piece.column("cid").to_pylist(), shingle_sets(piece.column("text"), size))

    def linked(sets: list[np.ndarray]) -> np.ndarray:
        """Which classes are linked.  The counts of common shingles are the one matrix of numbers that is held whole: below 2^24, they are exact."""
        n, k = np.array([len(s) for s in sets]), len(sets)
        value, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(k), n), count > 1
        column = np.cumsum(shared) - 1
        owner, which = owner[shared[which]], column[which[shared[which]]]
        order = np.argsort(which, kind="stable")
        owner, which = owner[order], which[order]
        both = np.zeros((k, k), np.float32)
        for a in range(0, int(shared.sum()), COLUMNS):
            i, z = np.searchsorted(which, [a, a + COLUMNS])
            m = np.zeros((k, COLUMNS), np.float32)
            m[owner[i:z], which[i:z] - a] = 1
            both += m @ m.T
        near = np.empty((k, k), bool)
        for a in range(0, k, ROWS):
            shared_by = np.rint(both[a:a + ROWS]).astype(np.int64)
            near[a:a + ROWS] = 100 * shared_by >= percent * (n[a:a + ROWS, None] + n[None, :] - shared_by)
        np.fill_diagonal(near, True)
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(own: dict[int, np.ndarray]) -> pa.RecordBatch:
            cid = np.array(sorted(own), np.int64)
            near, label = linked([own[c] for c in cid.tolist()]), np.arange(len(cid))
            while True:
                new = np.concatenate([np.where(near[a:a + ROWS], label[None, :], len(cid)).min(axis=1) for a in range(0, len(cid), ROWS)])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = label != np.arange(len(cid))
            return pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[label[moved]])], ["a", "b"])

        now, own = None, {}
        for node, cid, shingles in sets_of(batches):
            if node != now and len(own) > 1:
                yield finish(own)
            if node != now:
                now, own = node, {}
            own[cid] = shingles
        if len(own) > 1:
            yield finish(own)
    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; the number of its component and the key of its row (doc, th).

    Documents are linked if 100 * intersection >= percent * union of their sets of
    ``size``-word shingles; component_id is the smallest doc_id that links reach.
    ``doc_id`` is an integer; a null id counts as larger than any other and gives a
    null component where it is alone.  Null and wordless texts have no shingles and
    are linked with nothing.  Rows that share an id are judged by their own text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    measured = common.stage(_measure(base, size), "shingles")
    classes = measured.where("n > 0").groupBy("c1", "c2", "n").agg(F.min(F.struct("doc", "th")).alias("r"), F.first("signature").alias("signature"))
    classes = common.few_files(classes, measured.count())
    classes = common.stage(classes.select(F.monotonically_increasing_id().alias("cid"), "c1", "c2", "n", "r.doc", "r.th", "signature"), "classes")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                nodes = _start_nodes(_signatures(b.column("signature")))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), *[pa.array(np.repeat(b.column(c).to_numpy(), nodes.shape[1])) for c in ("cid", "n")]], ["node", "cid", "n"])
    members = common.stage(classes.select("cid", "n", "signature").mapInArrow(start, "node bigint, cid bigint, n bigint"), "start-nodes")
    share = percent / 100
    least = share - MARGIN * (share * (1 - share) / TOKENS) ** 0.5

    def links_in(nodes: DataFrame, parted: DataFrame | None, known: DataFrame | None) -> tuple[DataFrame, int]:
        """The links, and how many there are at most."""
        described = classes.select("cid", "signature")
        described = described.join(parted, "cid", "left") if parted else described.withColumn("large", F.lit(None).cast("array<bigint>"))
        described = described.join(known, "cid", "left") if known else described.withColumn("label", F.col("cid"))
        found = nodes.join(described, "cid").select("node", "cid", "start", "signature", "large", F.coalesce("label", "cid").alias("label")) \
            .repartition("node").sortWithinPartitions("node").mapInArrow(_with_partner(least), "node bigint, cid bigint")
        found = common.stage(found, "partners")
        most = found.count()
        found = common.stage(common.few_files(found.join(classes.select("cid", "doc", "th"), "cid"), most), "partner-texts")
        texts = base.select("doc", "th", "text")
        few = common.small(found.select("doc", "th").distinct(), "count(*) * 48")
        if few is not None:                 # the other texts need not move
            texts = texts.join(few, ["doc", "th"], "left_semi")
        texts = texts.join(found.hint("shuffle_hash"), ["doc", "th"]).select("node", "cid", "text")
        return texts.repartition("node").sortWithinPartitions("node").mapInArrow(_link(percent, size), "a bigint, b bigint"), most

    sized = _sized(members)
    blocks, known, first_links = _first_meetings(sized, limit), None, None
    if blocks is not None:
        first_links = common.stage(links_in(blocks.withColumn("start", F.lit(False)), None, None)[0], "first-links")
        several = first_links.count()
        known = components(first_links, several).select(F.col("node").alias("cid"), F.col("component").alias("label"))
        known = common.stage(common.few_files(known, 2 * several), "known")
    nodes, parted = _in_nodes(members, classes, limit, known, sized)
    links, most = links_in(nodes, parted, known)
    reached = components(links, most) if first_links is None else components(links.unionByName(first_links), most + several)
    named = classes.select("cid", "c1", "c2", "n", "doc").join(reached.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("component", F.coalesce("component", "cid"))
    first = named.groupBy("component").agg(F.min("doc").alias("component_doc"))
    named = named.join(first, "component").select("c1", "c2", "n", "component", "component_doc")
    out = measured.drop("signature").join(named, ["c1", "c2", "n"], "left")
    kind = dict(docs.dtypes)["doc_id"]
    component = F.coalesce("component_doc", "doc")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(component != LAST, component).cast(kind).alias("component_id"), "component", "doc", "th")


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, one with the smallest id, and all rows without words.

    Columns keep their names, types and values, whatever they are; rows with the same
    id and text are taken for one, and an arbitrary one of them stays.
    """
    found = near_duplicates(docs.select("doc_id", "text"), percent, size)
    chosen = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc", "th")).alias("r")).select("r.doc", "r.th")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = text.rlike(r"[^\x20\x09-\x0D]")
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    again = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    keyed = docs.where(words).select(*columns, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"))
    kept = keyed.join(chosen.hint("shuffle_hash"), ["doc", "th"], "left_semi")
    first = Window.partitionBy("doc", "th").orderBy(F.lit(1))
    kept = kept.withColumn("place", F.row_number().over(first)).where("place = 1")
    return kept.select(*again).unionByName(docs.where(~words))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents; one of each group is kept."""
    out = near_duplicates(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as component_id from r group by a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept from d join m on m.a = doc_id left join n using (doc_id)
"""
