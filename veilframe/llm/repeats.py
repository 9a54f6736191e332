"""Removal of repeated word windows, found by recompression.

Rounds name the symbols of a text: words first, then pairs of neighbours.  In each
round a symbol's hash puts it on the left or the right side, and every left symbol
followed by a right one becomes a pair whose name is a hash of both.  Names depend
on contents alone, so they agree in all texts without any exchange between tasks,
and so do the borders of symbols inside equal windows: after two rounds all but
the outermost two on either side.  (Equal neighbours are on the same side: a run
never pairs with itself, since its length is not known inside a window.)

Of the borders well inside a window the one whose six surrounding words have the
least hash is the window's anchor, so that equal windows share their anchor.  The
windows of an anchor are settled at once: where all words that they cover occur
earlier around an equal anchor, all of them are repeats.  Only where equal anchors
have different surroundings, at the ends of a repeat, are single windows compared.
Groups of equal rows are cut down to their first inside each task before they are
shuffled, so that a passage in a third of all texts costs one row for each task.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import common, words as W

WINDOW = 20
AROUND = 3                # words on either side of a border that its hash covers; borders are that far inside the window
HELD = 2_000_000          # rows that a task sorts at a time
LAST = (1 << 63) - 1      # order of a null id
PLACE = 28                # bits of a place in a text
_KEY = "key bigint, ctx bigint, doc bigint, loc bigint"
_NOT = np.uint64(0xFFFFFFFFFFFFFFFF)


def _borders(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where symbols begin after two rounds."""
    at, name = np.arange(len(h)), h
    for step in range(2):
        side = (W.mix(name + np.uint64(step + 1)) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(at), bool)
        pair[:-1] = ~side[:-1] & side[1:] & (text[at[:-1]] == text[at[1:]])
        name = name.copy()
        i = np.flatnonzero(pair)
        name[i] = W.mix(name[i] * np.uint64(0xD6E8FEB86659FD93) + name[i + 1])
        keep = np.ones(len(at), bool)
        keep[i + 1] = False
        at, name = at[keep], name[keep]
    return at


def _anchors(w: W.Words) -> tuple[np.ndarray, ...]:
    """(key, surroundings, text, first window, number of windows) of every anchor; windows count from the text's start."""
    h, text, last = w.hashes(), w.text_of(), w.last()
    n = len(h) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    g = W.grams(h, 2 * AROUND)
    border = _borders(h, text)
    border = border[(border >= AROUND) & (border - AROUND < len(g))]
    low = np.uint64((1 << 30) - 1)
    value = np.full(len(h), _NOT)
    value[border] = (g[border - AROUND] & ~low) | (low - border.astype(np.uint64))      # of equal hashes the last place wins
    span = WINDOW - 2 * AROUND + 1                                                        # places from AROUND to WINDOW - AROUND
    least, size = value, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:len(least) - span + size], least[span - size:])
    window = np.flatnonzero(np.arange(n) + WINDOW <= last[:n])
    anchor = (low - (least[window + AROUND] & low)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[window[1:]] != text[window[:-1]])
    i = np.flatnonzero(new)
    count = np.diff(np.append(i, len(window)))
    first, anchor = window[i], anchor[i]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * W._power(W._BASE, len(h)))])
    covered = (total[first + count - 1 + WINDOW] - total[first]) * W._power(W._BASE_INVERSE, len(h))[first]
    shape = (anchor - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)
    return g[anchor - AROUND], W.mix(covered + W.mix(shape)), text[first], first - w.first[text[first]], count


def _windows(w: W.Words, chosen: list[list[int]]) -> tuple[np.ndarray, ...]:
    """(two hashes, text, place, 1) of the windows of the chosen anchors of each text."""
    h = w.hashes()
    at = [w.first[t] + p for t, own in enumerate(chosen) for a in own for p in range(a >> 4, (a >> 4) + (a & 15))]
    at = np.array(at, np.int64)
    one, two = W.grams(h, WINDOW, 0), W.grams(h, WINDOW, 1)
    text = np.searchsorted(w.first, at, "right") - 1
    return one[at], two[at], text, at - w.first[text], np.ones(len(at), np.int64)


def _in_order(key, ctx, doc, loc) -> tuple[np.ndarray, ...]:
    """Sorted, and without what rows that repeat an id and text bring in again."""
    order = np.lexsort((loc, doc, ctx, key))
    key, ctx, doc, loc = key[order], ctx[order], doc[order], loc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (doc[1:] != doc[:-1]) | (loc[1:] != loc[:-1])
    return key[new], ctx[new], doc[new], loc[new]


def _first_in_task(rows: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> Callable:
    """A ``mapInArrow`` function: of equal (key, ctx) the first goes on, the others are repeats already (no ctx)."""
    def settle(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, ctx, doc, loc = _in_order(*(np.concatenate(x) for x in zip(*parts)))
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])
        return pa.RecordBatch.from_arrays([pa.array(np.where(again, doc.view(np.uint64), key).view(np.int64)), pa.array(ctx.view(np.int64), mask=again),
                                           pa.array(doc), pa.array(loc.view(np.int64))], ["key", "ctx", "doc", "loc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in common.pieces(batch, "text"):
                key, ctx, text, place, count = rows(piece)
                doc, th = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "th"))
                if len(place) and int(place.max()) >> PLACE:
                    raise ValueError("a text has more words than a place can hold")
                loc = (th.astype(np.uint64)[text] << np.uint64(32)) | (place.astype(np.uint64) << np.uint64(4)) | count.astype(np.uint64)
                parts.append((key, ctx, doc.astype(np.int64)[text], loc))
                held += len(key)
                if held > HELD:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)
    return run


def _first_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal (key, ctx) in a partition all but the first are repeats; firsts are open if their key has other surroundings too.

    Gives (doc, th, at): at holds the first window, the number of windows and whether it is open.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    settled = table.column("ctx").is_null().to_numpy()
    key, ctx, doc, loc = (table.column(c).fill_null(0).to_numpy() for c in ("key", "ctx", "doc", "loc"))
    loc = loc.view(np.uint64)
    out = [(doc[settled], loc[settled], np.zeros(int(settled.sum()), bool))]
    key, ctx, doc, loc = key[~settled], ctx[~settled], doc[~settled], loc[~settled]
    if len(key):
        key, ctx, doc, loc = _in_order(key, ctx, doc, loc)
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        first = new_key | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, first)[group] > 1
        out.append((doc[~first], loc[~first], np.zeros(int((~first).sum()), bool)))
        out.append((doc[first & several], loc[first & several], np.ones(int((first & several).sum()), bool)))
    doc, loc, still = (np.concatenate(x) for x in zip(*out))
    at = ((loc & np.uint64(0xFFFFFFFF)) << np.uint64(1)) | still.astype(np.uint64)
    for i in range(0, len(doc), 100_000):
        part = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array((loc[part] >> np.uint64(32)).astype(np.int64)), pa.array(at[part].view(np.int64))], ["doc", "th", "at"])


def _keep(w: W.Words, removed: np.ndarray) -> pa.Array:
    """The words of each text that are not removed, joined by one space."""
    kept = np.flatnonzero(~removed)
    text = w.text_of()[kept]
    again = np.zeros(len(kept), bool)
    again[1:] = text[1:] == text[:-1]                     # has a kept word before it, so there is a blank byte before it
    data = w.data.copy()
    data[w.start[kept[again]] - 1] = 0x20
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, w.start[kept] - again, 1)
    np.add.at(change, w.end[kept], -1)
    sizes = np.zeros(len(w.first) - 1, np.int64)
    np.add.at(sizes, text, w.end[kept] - w.start[kept] + again)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = data[np.cumsum(change[:-1], dtype=np.int8) > 0]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(out.tobytes()))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``text`` (the kept words, joined by one space) of every document.

    A word goes if a window of WINDOW words that covers it occurs earlier: at a
    smaller id, or in the same document further ahead.  ``doc_id`` is an integer;
    null ids come last.  Different texts with one id are taken in the order of a
    hash of the text; rows that repeat id and text are one document, and each of
    them gets its result.  Null texts have no words.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"),
                       F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)).alias("th"), text.alias("text"))
    found = base.select("doc", "th", "text").mapInArrow(_first_in_task(lambda p: _anchors(W.words(p.column("text"), W.BY_SPACE))), _KEY)
    found = found.repartition("key").mapInArrow(_first_of_all, "doc bigint, th bigint, at bigint")
    found = common.stage(found, "anchors")
    still = found.where("at % 2 = 1").groupBy("doc", "th").agg(F.collect_list(F.shiftright("at", 1)).alias("at"))

    def of_open(piece):
        return _windows(W.words(piece.column("text"), W.BY_SPACE), piece.column("at").to_pylist())
    single = base.join(still.hint("shuffle_hash"), ["doc", "th"]).select("doc_id", "doc", "th", "text", "at").mapInArrow(_first_in_task(of_open), _KEY) \
        .repartition("key").mapInArrow(_first_of_all, "doc bigint, th bigint, at bigint")
    repeats = found.unionByName(single).where("at % 2 = 0").groupBy("doc", "th").agg(F.collect_list(F.shiftright("at", 1)).alias("at"))

    def make():
        def f(piece):
            w = W.words(piece.column("text"), W.BY_SPACE)
            change = np.zeros(len(w.start) + 1, np.int64)
            lists = piece.column("at")
            owner = np.repeat(np.arange(len(lists)), np.array(lists.value_lengths().fill_null(0)))
            at = lists.flatten().to_numpy()
            start = w.first[owner] + (at >> 4)
            np.add.at(change, start, 1)
            np.add.at(change, start + (at & 15) - 1 + WINDOW, -1)
            removed = np.cumsum(change[:-1]) > 0
            n = np.concatenate([[0], np.cumsum(removed)])
            return {"doc_id": piece.column("doc_id"), "n_words": pa.array(w.counts, pa.int64()),
                    "n_removed": pa.array(n[w.first[1:]] - n[w.first[:-1]], pa.int64()), "text": _keep(w, removed)}
        return f
    merged = base.join(repeats.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "doc", "th", "text", "at")
    return common.map_pieces(merged, "text", make, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows."""
    out = remove_repeats(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from g) where k > 1),
x as (select distinct doc_id, unnest(range(i, i + 20)) as p from r),
k as (select doc_id, count(*) as n from x group by doc_id),
v as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
s as (select v.doc_id, string_agg(word, ' ' order by v.p) as t from v left join x on x.doc_id = v.doc_id and x.p = v.p where x.p is null group by v.doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join k using (doc_id) left join s using (doc_id)
"""
