"""Removal of repeated 50-byte strings by prefix-free parsing (operator 10).

Parse: a rolling hash of ``TRIGGER`` bytes marks trigger positions, the leftmost minimum within every window of
``WINDOW`` bytes; hence each window holds the trigger it belongs to, and equal windows hold equal triggers at equal
places. The windows of one trigger make a phrase (with the bytes up to the end of its last window), so a document is
a sequence of overlapping phrases, and a passage that many documents share is, but for its ends, a sequence of equal
phrases.

The parse is sorted by trigger, phrase and document: the first document of each phrase is then at hand, and later
ones repeat the phrase as a whole. Phrases of
one trigger that differ (at the ends of passages, or where the text around a trigger only looks alike) go into the
dictionary with their bytes, from their smallest document. The dictionary's suffixes are sorted to the depth of a window,
trigger by trigger, which brings equal windows together, and the first document of each run tells which are repeated.

Both orders are cut at triggers, since equal windows share theirs, and at the depth of a window; nothing beyond is
needed, so no suffix array of the whole corpus is built. Dictionary windows are compared byte by byte; whole phrases by 192
bits of hashes (64 of the trigger, twice 64 of the phrase), and no bytes are fetched for those.

Memory follows neither the corpus nor a hot trigger: sorted streams are cut into slices, a batch of documents sends each of
its phrases once, and what belongs to a trigger that outgrows a slice is grouped by Spark, by phrase or by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm._common import bounded_batches, raw_bytes, table
from wayfarer.session import written

WINDOW = 50
TRIGGER = 16
SEED = 1050
#: Bytes that are parsed at a time, of one or of several documents, so that memory doesn't follow a text's length.
PIECE = 1 << 18
#: Phrases of one trigger, and dictionary windows, that a task holds at a time.
RUN_ROWS = 250_000
SLICE_WINDOWS = 250_000
LAST = np.iinfo(np.int64).max

_BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(max(n, PIECE + 2 * WINDOW), base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[which] = (both[0], both[1])
    return _powers[which][0][:n], _powers[which][1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


#: Low bits of a ranked hash that hold its position within a piece.
_PLACE = np.uint64((1 << 21) - 1)


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` consecutive hashes, by doubling.

    The position takes the place of a hash's low bits, so one minimum settles value and place; hashes that agree in
    their high bits tie, and the leftmost wins, which equal windows settle alike.
    """
    ranked = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        ranked = np.minimum(ranked[step:], ranked[:-step])
        size += step
    return (ranked & _PLACE).astype(np.int64)


def _pieces(bodies: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(document, offset, bytes) in lots of about ``PIECE`` bytes; a long text is cut so that no window is lost."""
    lot: list[tuple[int, int, bytes]] = []
    size = 0
    for i, data in enumerate(bodies):
        for at in range(0, len(data) - window + 1, PIECE):
            part = data[at : at + PIECE + window - 1]
            lot.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def parse(bodies: list[bytes], window: int = WINDOW, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Phrases of documents: document, first and last window start, and the hashes ``g`` (trigger), ``e`` and ``f`` (phrase)."""
    found = [_parse(lot, window, trigger) for lot in _pieces(bodies, window)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _parse(lot: list[tuple[int, int, bytes]], window: int, trigger: int) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(x) for *_, x in lot])
    begin = np.cumsum(lengths) - lengths
    b = np.frombuffer(b"".join(x for *_, x in lot), np.uint8)
    n = len(b)
    sums = []
    for k in range(2):
        up, _ = _power(k, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[k][b] * up[:n], out=total[1:])
        sums.append(total)
    down = _power(0, n + 1)[1]
    rolling = (sums[0][trigger:] - sums[0][: n + 1 - trigger]) * down[: n + 1 - trigger]
    at = _leftmost_minima(rolling, window - trigger + 1)
    # Windows that begin in the last bytes of a document would run into the next one.
    inside = np.ones(len(at), bool)
    for z in (begin + lengths)[:-1].tolist():
        inside[z - window + 1 : z] = False
    starts = np.flatnonzero(inside)
    at = at[starts]
    cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    first, last, p = starts[cut], starts[np.append(cut[1:], len(starts)) - 1], at[cut]
    shape = (p - first).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + (last - first).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
    e, f = (_mix((sums[k][last + window] - sums[k][first]) * _power(k, n + 1)[1][first] + shape) for k in range(2))
    piece = np.searchsorted(begin, first, "right") - 1
    who = np.array([i for i, *_ in lot])[piece]
    shift = np.array([o for _, o, _ in lot])[piece] - begin[piece]
    return who, first + shift, last + shift, _mix(rolling[p]), e, f


def _columns(schema: str, *values: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in values], names)


#: ``k`` holds the high halves of a trigger's and a phrase's hash, ``m`` the low ones: rows are sorted by the one number
#: ``k``. Of ``kind`` 0 are phrases to be compared, of kind 1 repeats that a batch has settled by itself.
_PHRASES = "kind int, k long, m long, f long, id long, rid long"
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _interleave(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High halves together and low halves together; a second call gives the two hashes back."""
    return (g & ~_LOW) | (e >> _HALF), (g << _HALF) | (e & _LOW)


def _parse_batches(window: int, trigger: int):
    """One row for each phrase of a batch and its smallest document; other documents of the batch only repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            who, _, _, g, e, f = parse(raw_bytes(batch.column(2)), window, trigger)
            if not len(who):
                continue
            key = g ^ (e * np.uint64(_BASES[0]))
            order = np.argsort(key, kind="stable")
            who, g, e, f, key = who[order], g[order], e[order], f[order], key[order]
            id_, rid = ids[who], rids[who]
            new = np.append(True, (key[1:] != key[:-1]) | (f[1:] != f[:-1]))
            head = np.flatnonzero(new)
            low = np.minimum.reduceat(id_, head)[np.cumsum(new) - 1]
            once = new | np.append(True, rid[1:] != rid[:-1])  # a phrase that a document repeats
            repeated = (id_ > low)[once]
            g, e, f, id_, rid = g[once], e[once], f[once], id_[once], rid[once]
            g = np.where(repeated, rid.view(np.uint64), g)  # settled rows are spread by document
            yield _columns(_PHRASES, repeated.astype(np.int32), *_interleave(g, e), f, id_, rid)

    return run


_DECISIONS = "id long, rid long, e long, mask long, g long, f long"
#: Stands for all windows of a phrase; a bit mask has at most as many bits as a phrase has windows, 35.
ALL = np.int64(-1)
#: Asks for the bytes of a phrase.
ASK = np.int64(0)
#: Leaves a phrase of a crowded trigger to Spark; ``g`` and ``f`` are only told then.
OPEN = np.int64(1 << 62)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Which elements of sorted arrays begin a run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _compare_parse(run_rows: int):
    """Over phrases sorted by trigger and phrase: which are repeated as a whole, and whose bytes the dictionary needs.

    A trigger is looked at as a whole: its phrases are needed if there are several and not all of one document. Those
    of a trigger that has more than ``run_rows`` rows are left open.
    """

    def told(id_, rid, e, mask, g=None, f=None) -> pa.RecordBatch:
        none = np.zeros(len(id_), np.int64)
        return _columns(_DECISIONS, id_, rid, e, mask, none if g is None else g, none if f is None else f)

    def judged(k, m, f, id_, rid) -> pa.RecordBatch:
        g, e = _interleave(k, m)
        order = np.lexsort((rid, id_, f, e, g))
        g, e, f, id_, rid = (x[order] for x in (g, e, f, id_, rid))
        phrase, trigger = _runs(g, e, f), _runs(g)
        low = id_[np.flatnonzero(phrase)][np.cumsum(phrase) - 1]
        repeated = id_ > low
        head = np.flatnonzero(trigger)
        kinds = np.add.reduceat(phrase.astype(np.int64), head)
        mixed = ((kinds > 1) & (np.minimum.reduceat(id_, head) < np.maximum.reduceat(low, head)))[np.cumsum(trigger) - 1]
        own = (repeated | mixed) & (phrase | _runs(id_, rid))
        return told(id_[own], rid[own], e[own], np.where(repeated[own], ALL, ASK))

    def left_open(k, m, f, id_, rid) -> pa.RecordBatch:
        g, e = _interleave(k, m)
        return told(id_, rid, e, np.full(len(e), OPEN), g, f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, hot = 0, None
        for batch in batches:
            kind, *rows = (batch.column(c).to_numpy() for c in range(6))
            rows = [r.view(np.uint64) if c < 3 else r for c, r in enumerate(rows)]
            if (kind == 1).any():
                k, m, _, id_, rid = (r[kind == 1] for r in rows)
                yield told(id_, rid, _interleave(k, m)[1], np.full(len(k), ALL))
            rows = [r[kind == 0] for r in rows]
            if hot is not None and len(rows[0]):
                n = int(np.searchsorted(rows[0] >> _HALF != hot, True))
                if n:
                    yield left_open(*(r[:n] for r in rows))
                rows = [r[n:] for r in rows]
            if not len(rows[0]):
                continue
            hot = None
            held.append(rows)
            size += len(rows[0])
            if size < min(run_rows, 1 << 17):
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            trigger = rows[0] >> _HALF
            n = int(np.searchsorted(trigger == trigger[-1], True))
            if n:
                yield judged(*(r[:n] for r in rows))
            rest = [r[n:] for r in rows]
            held, size = [rest], len(rest[0])
            if size > run_rows:
                hot = trigger[-1]
                yield left_open(*rest)
                held, size = [], 0
        if held:
            yield judged(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


_ENTRIES = "g long, id long, rid long, e long, size int, data binary"


def _told(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, phrase hash and mask of all that a batch is told."""
    counts = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    values = column.flatten()
    return np.repeat(np.arange(len(column)), counts), values.field(0).to_numpy().view(np.uint64), values.field(1).to_numpy()


def _find(who: np.ndarray, e: np.ndarray, told_who: np.ndarray, told_e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (phrase, what is told about it); of equal entries the last is found."""
    spread = lambda w, h: h ^ _mix(w.astype(np.uint64) + np.uint64(1))
    key = spread(told_who, told_e)
    order = np.argsort(key, kind="stable")
    place = np.searchsorted(key[order], spread(who, e), "right") - 1
    place = order[np.maximum(place, 0)]
    hit = np.flatnonzero((told_who[place] == who) & (told_e[place] == e))
    return hit, place[hit]


def _fetch_phrases(window: int, trigger: int):
    """Bytes of the phrases that are asked for, each once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = raw_bytes(batch.column("text"))
            who, first, last, g, e, _ = parse(bodies, window, trigger)
            told_who, told_e, _ = _told(batch.column("told"))
            if not len(who) or not len(told_who):
                continue
            hit, entry = _find(who, e, told_who, told_e)
            hit = hit[np.unique(entry, return_index=True)[1]]
            data = [bodies[w][a:z] for w, a, z in zip(who[hit].tolist(), first[hit].tolist(), (last[hit] + window).tolist(), strict=True)]
            ids, rids = (batch.column(c).to_numpy()[who[hit]] for c in ("_id", "_rid"))
            values = [g[hit].view(np.int64), ids, rids, e[hit].view(np.int64), (last[hit] - first[hit] + 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array(data, pa.binary())], [c.split()[0] for c in _ENTRIES.split(", ")])

    return run


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the dictionary to the depth of a window: the order, and where runs of equal ones begin."""
    n, size = windows.shape
    ended = np.ones((n, size + 1), np.uint8)  # a last byte of one, since numpy ignores trailing zeros
    ended[:, :size] = windows
    text = ended.view(f"S{size + 1}").ravel()
    order = np.argsort(text, kind="stable")
    return order, _runs(text[order])


def _windows(sizes: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of phrases that lie one after the other: phrase, number within it, bytes."""
    base = np.concatenate(([0], np.cumsum(sizes + (window - 1))[:-1]))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return owner, inner, np.lib.stride_tricks.sliding_window_view(data, window)[base[owner] + inner]


def repeated_windows(ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """Per dictionary phrase the mask of windows that a phrase of a smaller document has too."""
    owner, inner, windows = _windows(sizes, data, window)
    order, new = suffix_order(windows)
    low = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[ids[owner[order]] > low]
    masks = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << inner[hit])
    return masks


#: Rows with a ``window`` are windows of a crowded trigger, still to be compared.
_JUDGED = "id long, rid long, e long, mask long, window binary"


def _compare_dictionary(window: int, slice_windows: int):
    """Over dictionary phrases sorted by trigger: masks of the repeated windows."""

    def entries(rows: pa.Table):
        g, ids, rids, e, sizes = (rows.column(c).to_numpy() for c in ("g", "id", "rid", "e", "size"))
        order = np.lexsort((e, rids, g))
        once = order[_runs(g[order], rids[order], e[order])]
        data = rows.column("data").take(pa.array(once)).to_pylist()
        return ids[once], rids[once], e[once], sizes[once].astype(np.int64), np.frombuffer(b"".join(data), np.uint8)

    def judged(rows: pa.Table) -> pa.RecordBatch:
        ids, rids, e, sizes, data = entries(rows)
        masks = repeated_windows(ids, sizes, data, window)
        told = masks != 0
        return pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (ids, rids, e, masks)] + [pa.nulls(int(told.sum()), pa.binary())], [c.split()[0] for c in _JUDGED.split(", ")])

    def crowded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, 4096):
            ids, rids, e, sizes, data = entries(rows.slice(at, 4096))
            owner, inner, windows = _windows(sizes, data, window)
            yield pa.RecordBatch.from_arrays([pa.array(x[owner]) for x in (ids, rids, e)] + [pa.array(np.int64(1) << inner), pa.array([w.tobytes() for w in windows], pa.binary())], [c.split()[0] for c in _JUDGED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, hot = 0, None
        for batch in batches:
            g = batch.column(0).to_numpy()
            if hot is not None:
                n = int(np.searchsorted(g != hot, True)) if g[-1] != hot else len(g)
                if n:
                    yield from crowded(pa.Table.from_batches([batch.slice(0, n)]))
                batch, g = batch.slice(n), g[n:]
                if not len(g):
                    continue
                hot = None
            held.append(batch)
            size += int(batch.column(4).to_numpy().sum())
            if size < slice_windows:
                continue
            rows = pa.Table.from_batches(held)
            g = rows.column("g").to_numpy()
            n = int(np.searchsorted(g == g[-1], True))
            if n:
                yield judged(rows.slice(0, n))
            rest = rows.slice(n)
            size = int(rest.column("size").to_numpy().sum())
            if size >= slice_windows:
                hot = g[-1]
                yield from crowded(rest)
                held, size = [], 0
            else:
                held = rest.to_batches()
        if held:
            yield judged(pa.Table.from_batches(held))

    return run


def covered(size: int, first: np.ndarray, last: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes are covered by repeated windows of the given phrases."""
    edge = np.zeros(size + 1, np.int64)
    whole = masks == ALL
    np.add.at(edge, first[whole], 1)
    np.add.at(edge, last[whole] + window, -1)
    if not whole.all():
        bits = np.unpackbits(masks[~whole].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        start = first[~whole][row] + bit
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(carried: bool, as_text: bool, window: int, trigger: int):
    """Documents with the bytes kept, and what was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = raw_bytes(batch.column("text"))
            kept, removed, spans = list(bodies), [0] * len(bodies), [0] * len(bodies)
            told_who, told_e, masks = _told(batch.column("told"))
            some = np.unique(told_who)
            who, first, last, _, e, _ = parse([bodies[i] for i in some], window, trigger)
            if len(who):
                who = some[who]
                order = np.lexsort((told_e, told_who))
                told_who, told_e, masks = told_who[order], told_e[order], masks[order]
                head = np.flatnonzero(_runs(told_who, told_e))
                masks = np.bitwise_or.reduceat(masks, head)  # one phrase may have several
                hit, entry = _find(who, e, told_who[head], told_e[head])
                cuts = np.searchsorted(who[hit], np.arange(len(bodies) + 1))
                for i in some.tolist():
                    here = slice(cuts[i], cuts[i + 1])
                    gone = covered(len(bodies[i]), first[hit[here]], last[hit[here]], masks[entry[here]], window)
                    removed[i] = int(gone.sum())
                    spans[i] = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    kept[i] = np.frombuffer(bodies[i], np.uint8)[~gone].tobytes()
            out = {"doc": batch.column("_doc")} if carried else {}
            left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            out |= {"kept": left, "given": batch.column("text").is_valid(), "n_bytes": pa.array([len(x) for x in bodies], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
            out["sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _per_row(decisions: DataFrame) -> DataFrame:
    """What is told about each document, in one row; never more than the document has phrases."""
    return decisions.groupBy(F.col("id").alias("t_id"), F.col("rid").alias("t_rid")).agg(F.collect_list(F.struct("e", "mask")).alias("told"))


def without_repeats(docs: DataFrame, keep: list[str], window: int = WINDOW, trigger: int = TRIGGER, as_text: bool = False, run_rows: int = RUN_ROWS, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """For every row of ``docs`` its ``keep`` columns in a struct ``doc``, with ``kept`` (the bytes left, or as text
    what of them is valid UTF-8), ``given`` (the text isn't null), ``n_bytes``, ``n_removed``, ``n_spans`` and ``sha256``.

    A byte goes if a string of ``window`` bytes that covers it also starts in a document of a smaller ``doc_id``;
    strings don't cross documents and are judged on the input. Null texts are empty; texts shorter than a window lose
    nothing. Null ids come after all others; rows of equal ``doc_id`` don't take from each other. Repeated rows
    are treated alike. Very long texts are parsed in pieces. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rid = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_rid")
    order_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("_id")
    phrases = docs.select(order_id, rid, "text").mapInArrow(_parse_batches(window, trigger), _PHRASES)
    ordered = phrases.repartition(F.shiftrightunsigned("k", 32)).sortWithinPartitions("k")
    whole = written(ordered.mapInArrow(_compare_parse(run_rows), _DECISIONS), "repeats-parse")
    open_ = whole.where(F.col("mask") == int(OPEN))
    whole = whole.where(F.col("mask") != int(OPEN)).select("id", "rid", "e", "mask")
    if not open_.isEmpty():
        firsts = open_.groupBy("g", "e", "f").agg(F.min("id").alias("low"))
        judged = F.when(F.col("id") > F.col("low"), F.lit(int(ALL))).otherwise(F.lit(int(ASK))).alias("mask")
        whole = whole.unionByName(open_.join(firsts, ["g", "e", "f"]).select("id", "rid", "e", judged).distinct())

    # What is carried along travels in one struct, so that no name can clash.
    carried = [c for c in keep if c != "text"]
    rows = docs.select(*([F.struct(*carried).alias("_doc")] if carried else []), "text", order_id, rid)
    same = (F.col("_id") == F.col("t_id")) & (F.col("_rid") == F.col("t_rid"))
    asked = _per_row(whole.where(F.col("mask") == int(ASK)))
    entries = rows.select("_id", "_rid", "text").join(asked, same).mapInArrow(_fetch_phrases(window, trigger), _ENTRIES)
    ordered = entries.repartition("g").sortWithinPartitions("g")
    some = written(ordered.mapInArrow(_compare_dictionary(window, slice_windows), _JUDGED), "repeats-dictionary")
    told = whole.where(F.col("mask") != int(ASK)).unionByName(some.where("window IS NULL").drop("window"))
    crowded = some.where("window IS NOT NULL")
    if not crowded.isEmpty():
        firsts = crowded.groupBy("window").agg(F.min("id").alias("low"))
        told = told.unionByName(crowded.join(firsts, "window").where("id > low").select("id", "rid", "e", "mask"))

    kind = T.StructType([T.StructField("doc", f.dataType) for f in rows.schema.fields if f.name == "_doc"])
    for name, of in (("kept", T.StringType() if as_text else T.BinaryType()), ("given", T.BooleanType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("sha256", T.StringType())):
        kind.add(name, of)
    return rows.join(_per_row(told), same, "left").mapInArrow(_apply(bool(carried), as_text, window, trigger), kind)


def cleaned_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text`` and ``n_chars`` (where there is one) counted anew.

    Of a character cut in two, what is left isn't valid UTF-8 and goes too. Documents that lost bytes and have no word
    left go; those without words to begin with stay. Texts that lose nothing, null ones too, stay as they are.
    """
    left = without_repeats(docs, [c for c in docs.columns if c != "text"], window, as_text=True)
    left = left.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for name, kind in docs.dtypes:
        if name == "text":
            columns.append(F.when(F.col("given"), F.col("kept")).alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("doc")[name]).cast(kind).alias(name))
        else:
            columns.append(F.col("doc")[name].alias(name))
    return left.select(*columns)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return left.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, o, c, substr(h, 2 * c + 1, {2 * (200 + WINDOW - 1)}) AS h FROM (SELECT r, o, h, unnest(range(0, len(h) // 2, 200)) AS c FROM d)),
starts AS (SELECT r, o, c, h, unnest(range(0, len(h) // 2 - {WINDOW - 1})) AS s FROM pieces WHERE len(h) >= {2 * WINDOW}),
windows AS (SELECT r, o, c + s AS s, substr(h, 2 * s + 1, {2 * WINDOW}) AS w FROM starts),
firsts AS (SELECT w, min(o) AS low FROM windows GROUP BY w),
hits AS (SELECT r, s FROM windows JOIN firsts USING (w) WHERE o > low),
islands AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS island FROM (
  SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hits)),
spans AS (SELECT r, min(s) AS a, max(s) + {WINDOW} AS z FROM islands GROUP BY r, island),
gaps AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans),
cut AS (
  SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
