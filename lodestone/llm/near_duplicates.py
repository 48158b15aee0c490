"""Operator 8: n-gram Jaccard join with filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, lean, materialise, slices, tidy, utf8
from lodestone.llm.token_store import mix

#: Words of a gram, least Jaccard similarity (half: a copy with a tenth of its words changed, scattered, has about 0.57 with its original; two such copies have about 0.36 with each other and are linked by the original alone), and how many global orders a candidate must pass.
GRAM, THRESHOLD, ORDERS = 3, 0.5, 3
#: Bytes of text hashed at a time, grams of one block of documents, bytes of text whose grams make one bucket, pairs held before they are handed on.
PIECE, BLOCK_GRAMS, BUCKET_BYTES, HELD_PAIRS = 1 << 19, 1_000_000, 16 << 20, 1_000_000
#: Documents from which on a gram is hot, sets of one home, grams of one side of a cell of pairs that is verified in one place, and grams that a set counts for there at least.
HOT, CHUNK, CELL_GRAMS, LEAST_GRAMS = 16, 1_024, 1_000_000, 512
#: Kinds of what is sent of a gram and a home.
ROWS = (np.int32, np.int32, np.int32, np.int64, np.int64)
#: Grams of a bucket that are sorted and counted, or of a cell that are ordered or compared, at a time: what is made of them stays as small however large the bucket or cell. It changes no result.
PART_GRAMS = 1 << 18
#: Documents to drop that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 4_000_000

_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_RANDOM = np.random.default_rng(11)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"]


def gram_hashes(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, from the bytes of lower-case texts.

    A word is a run of a-z, 0-9 and characters beyond ASCII. A text of fewer words than ``gram`` has them all as its only gram.
    """
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    up, down = _powers(len(data))
    wordy = _WORDY[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begins = wordy.copy()
    begins[1:] &= ~wordy[:-1] | fresh[1:-1]
    ends = wordy.copy()
    ends[:-1] &= ~wordy[1:] | fresh[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64), 1)
    at = np.searchsorted(first, offsets)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(gram)]
    full = max(0, len(words) - gram + 1)
    grams = np.zeros(full, np.uint64)
    for k in range(gram):
        grams += words[k : k + full] * factors[k]
    grams = mix(grams, 2)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= gram:
            own = np.sort(grams[a : b - gram + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(b - a):
                short = short + words[a + k : a + k + 1] * factors[k]
            out.append(mix(short, 3))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """Grams of a set of n that come first in an order, so that two similar sets share one of them."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _least_overlap(total: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(np.int64)


def _ranked(tokens: np.ndarray, classes: np.ndarray, group: np.ndarray, order: int) -> np.ndarray:
    """Positions that sort by group, then by the global order: rare grams first, those alike in frequency by a hash that differs from order to order."""
    return np.lexsort((mix(tokens, 100 + order), classes, group))


def _buckets(docs: DataFrame) -> int:
    """Buckets of grams: one for every BUCKET_BYTES of text, and at least as many as the session has shuffle partitions, so that a bucket fits a task at any size."""
    size = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES), 1)


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes of equal width, so that sorted grams lie bucket by bucket."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _homes(sets: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, classes: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """The home of each set, by the grams of its prefix (tokens and classes, of the set ref).

    A set with a hot gram lives with those of about its size whose hot gram of least hash is the same, so the texts of one template share a few homes; homes are cut by the sets' hashes
    into about CHUNK sets and a quarter of CELL_GRAMS. Any other set lives alone. A home is only where sets are compared together: which one it is changes no result.
    """
    home = mix(sets.view(np.uint64), 20)
    hot = np.flatnonzero(classes >= 8 * np.log2(HOT))
    if len(hot):
        hot = hot[np.lexsort((mix(tokens[hot], 21), ref[hot]))]
        hot = hot[np.append(True, ref[hot[1:]] != ref[hot[:-1]])]
        own = ref[hot]
        octave, most = np.floor(np.log2(sizes[own])), np.exp2((classes[hot] + 1.0) / 8)  # most: an upper bound of the gram's frequency
        parts = np.ceil(np.maximum(most / CHUNK, most * np.exp2(octave + 3) / CELL_GRAMS)).astype(np.uint64)
        home[own] = mix(mix(tokens[hot], 22) + (octave.astype(np.uint64) << np.uint64(40)) + mix(sets[own].view(np.uint64), 23) % parts, 24)
    return home.view(np.int64)


def pack(ordered: np.ndarray) -> bytes:
    """Distinct ascending 64-bit numbers: the first, then the bytes that the gaps need, plane by plane."""
    if not len(ordered):
        return b""
    gaps = np.diff(ordered)
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    return ordered[:1].tobytes() + bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first, width = np.frombuffer(data, np.uint64, 1), data[8]
    if not width:
        return first
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(np.concatenate((first, gaps.view(np.uint64).ravel())), dtype=np.uint64)


def _blocks(docs: DataFrame, buckets: int, gram: int) -> DataFrame:
    """Documents in blocks, their grams by bucket. A row (bucket, block) holds the bucket's grams that the block has once, with their document (tok, ref), and those that it has
    several times, with how often (more, times): a gram of every document comes to its bucket once a block. One further row a block keeps its ids, sizes and digests and, for the grams of ``more``, the
    documents (held). A block's name depends alone on what it holds, in its order, so a repeated task gives the same; so does a repeated block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int32)
            grams = np.concatenate(sets)
            edges = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            one, two = (np.add.reduceat(mix(grams, seed), edges) for seed in (4, 5))
            rows_in_order = mix(mix(np.array(ids, np.int64).view(np.uint64) + one, 6) + np.arange(len(ids), dtype=np.uint64), 10)
            name = int(mix(np.array([np.add.reduce(rows_in_order) + np.uint64(len(ids))], np.uint64), 7).view(np.int64)[0])
            order = np.argsort(grams)
            grams, ref = grams[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
            starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            times = np.diff(np.append(starts, len(grams)))
            once, several = starts[times == 1], np.flatnonzero(times > 1)
            tok, ref_once = grams[once], ref[once]
            more, times = grams[starts[several]], times[several]
            again = np.repeat(starts[several] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            times = times.astype(np.uint32)
            cuts, more_cuts = (np.searchsorted(_bucket_of(x, buckets), np.arange(buckets + 1)) for x in (tok, more))
            rows = [
                (int(b), name, None, None, None, None, None, pack(tok[i:j]), ref_once[i:j].tobytes(), pack(more[k:n]), times[k:n].tobytes())
                for b, i, j, k, n in zip(range(buckets), cuts[:-1].tolist(), cuts[1:].tolist(), more_cuts[:-1].tolist(), more_cuts[1:].tolist()) if j > i or n > k
            ]
            rows.append((abs(name) % buckets, name, np.array(ids, np.int64).tobytes(), sizes.tobytes(), mix(one + sizes.astype(np.uint64), 8).tobytes(), two.tobytes(), ref[again].tobytes(), None, None, pack(more), times.tobytes()))
            ids.clear()
            sets.clear()
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 9]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "block", "ids", "sizes", "sets", "checks", "held", "tok", "ref", "more", "times"])

        for batch in slices(batches):
            keys = batch.column(0).to_numpy()
            data, offsets = utf8(pc.utf8_lower(batch.column(1).cast(pa.large_string())))
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
                for key, own in zip(keys[at:to].tolist(), gram_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], gram)):
                    if len(own):
                        ids.append(key)
                        sets.append(own)
                        held += len(own)
                        if held >= BLOCK_GRAMS or len(ids) == 65_536:
                            yield flush()
                            held = 0
                at = to
        if ids:
            yield flush()

    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).where("doc_id is not null and text is not null")
    return keyed.mapInArrow(lean(run), "bucket int, block long, ids binary, sizes binary, sets binary, checks binary, held binary, tok binary, ref binary, more binary, times binary")


def roomy(group):
    """The same function of a group, tidy() after one that takes room."""

    def tidied(*args):
        out = group(*args)
        if sum(a.nbytes for a in args if isinstance(a, pa.Table)) > 4 << 20:
            tidy()
        return out

    return tidied


def _arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist() if x is not None]


def _cells(column: pa.ChunkedArray, rows: np.ndarray) -> Iterator[memoryview]:
    """Bytes of those rows, not copied."""
    return (memoryview(column[i].as_buffer()) for i in rows.tolist())


def _parts(sizes: np.ndarray, most: int) -> np.ndarray:
    """Bounds of runs of sets that have about so many grams together."""
    run = (np.cumsum(sizes) - sizes) // most
    return np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(sizes)) if len(sizes) else np.zeros(1, np.int64)


def _frequencies(grams: list[np.ndarray], times: list[np.ndarray | None]) -> list[np.ndarray]:
    """The frequency class of each gram of each array, over all of them. Arrays ascend, and each gram counts as often as its array's times say, or once.

    Grams are counted a range of hashes at a time, so beside the arrays there is only a byte a gram.
    """
    out = [np.empty(len(x), np.uint8) for x in grams]
    some = [x for x in grams if len(x)]
    if not some:
        return out
    low, high = min(int(x[0]) for x in some), max(int(x[-1]) for x in some)
    parts = -(-sum(map(len, some)) // PART_GRAMS)
    bounds = np.array([low + (high - low) * k // parts for k in range(1, parts)], np.uint64)
    cuts = np.array([[0, *np.searchsorted(x, bounds).tolist(), len(x)] for x in grams])
    for k in range(parts):
        spans = [slice(a, b) for a, b in cuts[:, k : k + 2].tolist()]
        every = np.concatenate([x[own] for x, own in zip(grams, spans)])
        if not len(every):
            continue
        weight = np.concatenate([np.ones(own.stop - own.start, np.int64) if w is None else w[own].astype(np.int64) for w, own in zip(times, spans)])
        order = np.argsort(every)
        every = every[order]
        edges = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        cls = np.minimum(255, 8 * np.log2(np.add.reduceat(weight[order], edges))).astype(np.uint8)
        mixed = np.empty(len(every), np.uint8)
        mixed[order] = np.repeat(cls, np.diff(np.append(edges, len(every))))
        at = 0
        for x, own in zip(out, spans):
            x[own] = mixed[at : at + own.stop - own.start]
            at += own.stop - own.start
    return out


def _numbers(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """Each token's place among the distinct ones, and how many these are."""
    order = np.argsort(tokens)
    ordered = tokens[order]
    places = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]), dtype=np.int32)
    out = np.empty(len(tokens), np.int32)
    out[order] = places
    return out, int(places[-1]) + 1 if len(places) else 0


def signatures(docs: DataFrame, buckets: int, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(doc_id, set_id, check, home, n, n_prefix, tokens, classes) of each document that shares a gram of its prefix with another.

    Every gram of every document is counted: blocks of documents send their distinct grams, packed, to the gram's bucket, and get back those that occur in
    several documents, with their frequency. Grams of a single document come first in each order and can match nothing, so they never move again.
    tokens and classes hold the shared grams in the first order.
    """

    def once(blocks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One row a block: blocks of one name hold the same rows in the same order, as where a file was read twice, and count as one."""
        return rows[np.sort(np.unique(blocks[rows], return_index=True)[1])]

    @roomy
    def count(table: pa.Table) -> pa.Table:
        bucket, kept = table["bucket"][0].as_py(), ("block", "ids", "sizes", "sets", "checks", "held", "more", "times")
        names, is_told = table["block"].to_numpy(), table["ids"].is_valid().to_numpy()
        told, own = (once(names, np.flatnonzero(x)) for x in (is_told, ~is_told))
        told = table.select(kept).take(pa.array(told))
        rows = [(b, bucket, i, n, s, c, h, m, t, None, None, None, None) for b, i, n, s, c, h, m, t in zip(*(told[c].to_pylist() for c in kept))]
        if len(own):
            toks, more, times, refs = ([read(x) for x in _cells(table[c], own)] for c, read in (("tok", unpack), ("more", unpack), ("times", lambda x: np.frombuffer(x, np.uint32)), ("ref", lambda x: np.frombuffer(x, np.uint16))))
            classes = _frequencies([x for pair in zip(toks, more) for x in pair], [x for w in times for x in (None, w)])
            for k, (block, ref) in enumerate(zip(names[own].tolist(), refs)):
                cls, more_cls = classes[2 * k : 2 * k + 2]
                shared = cls > 0
                rows.append((block, bucket, *[None] * 7, pack(toks[k][shared]), ref[shared].tobytes(), cls[shared].tobytes(), more_cls.tobytes()))
                toks[k] = None
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 11]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "bucket", "ids", "sizes", "sets", "checks", "held", "more", "times", "tok", "ref", "cls", "more_cls"])

    @roomy
    def gather(table: pa.Table) -> pa.Table:
        told = table.filter(table["ids"].is_valid())
        ids, sizes, sets, checks, held, times = (_arrays(told[c], k)[0] for c, k in (("ids", np.int64), ("sizes", np.int32), ("sets", np.int64), ("checks", np.int64), ("held", np.uint16), ("times", np.uint32)))
        table = table.filter(table["ids"].is_null()).sort_by("bucket")
        part = lambda name, kind: np.concatenate([np.zeros(0, kind), *_arrays(table[name], kind)])
        tokens = np.concatenate([*(unpack(x) for x in table["tok"].to_pylist()), np.repeat(unpack(told["more"][0].as_py()), times)])
        ref = np.concatenate((part("ref", np.uint16), held))
        cls = np.concatenate((part("cls", np.uint8), np.repeat(part("more_cls", np.uint8), times)))
        order = _ranked(tokens, cls, ref, 1)
        tokens, cls, ref = tokens[order], cls[order], ref[order]
        cuts = np.searchsorted(ref, np.arange(len(ids) + 1))
        shared = np.diff(cuts)
        prefix = np.clip(_prefix(sizes.astype(np.int64), threshold) - (sizes - shared), 0, shared)
        some = np.flatnonzero(prefix)
        cell = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())
        first = np.repeat(cuts[some] - (np.cumsum(prefix[some]) - prefix[some]), prefix[some]) + np.arange(prefix[some].sum())
        homes = _homes(sets[some], sizes[some], tokens[first], cls[first], np.repeat(np.arange(len(some)), prefix[some]))
        columns = [pa.array(ids[some]), pa.array(sets[some]), pa.array(checks[some]), pa.array(homes), pa.array(sizes[some]), pa.array(prefix[some].astype(np.int32)), cell(tokens), cell(cls)]
        return pa.table(columns, ["doc_id", "set_id", "check", "home", "n", "n_prefix", "tokens", "classes"])

    replies = "block long, bucket int, ids binary, sizes binary, sets binary, checks binary, held binary, more binary, times binary, tok binary, ref binary, cls binary, more_cls binary"
    counted = _blocks(docs, buckets, gram).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda table: count(table), replies)
    return counted.groupBy("block").applyInArrow(lambda table: gather(table), "doc_id long, set_id long, check long, home long, n int, n_prefix int, tokens binary, classes binary")


def candidates(sigs: DataFrame, buckets: int, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (a, b) of homes, a <= b, of which sets share a prefix gram in the first order and may be near enough in size and in the gram's positions.

    Of a gram's list each home is one entry, with the bounds of its sets, so the texts of a template make pairs of a few homes, not of each two texts, however many of their grams they share.
    """

    def bounds(tokens: np.ndarray, homes: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        """A row for each gram and home, of the least size, the greatest, the most grams from the place on, and the number of rows or whether there are several sets."""
        order = np.lexsort((homes, tokens))
        tokens, homes = tokens[order], homes[order]
        starts = np.flatnonzero(np.append(True, (tokens[1:] != tokens[:-1]) | (homes[1:] != homes[:-1])))
        return [tokens[starts], homes[starts], *(f.reduceat(c[order], starts) for f, c in zip((np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), columns))]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of copies in one task the first is enough
        for batch in slices(batches, 2_000):
            fresh = []
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s not in seen:
                    seen.add(s)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            if not batch.num_rows:
                continue
            sets, homes, sizes, prefix = (batch.column(i).to_numpy() for i in range(4))
            texts = batch.column(4).to_pylist()
            tokens = np.concatenate([np.frombuffer(t, np.uint64, k) for t, k in zip(texts, prefix.tolist())])
            ref = np.repeat(np.arange(len(sets)), prefix)
            unique = sizes - np.array([len(x) // 8 for x in texts])
            left = (sizes - unique)[ref] - np.arange(len(tokens)) + np.repeat(np.cumsum(prefix) - prefix, prefix)
            tokens, homes, *rows = bounds(tokens, homes[ref], sizes[ref], sizes[ref], left, sets[ref], sets[ref])
            bucket = (mix(tokens, 9) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            cells = []
            for b in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[b] : cuts[b + 1]]
                cells.append((int(b), tokens[at].tobytes(), homes[at].tobytes(), *(x[at].astype(k).tobytes() for x, k in zip(rows, ROWS))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells), [pa.int32(), *[pa.binary()] * 7])], ["bucket", "tok", "home", "least", "most", "left", "one", "other"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                for part, x, kind in zip(parts, row, (np.uint64, np.int64, *ROWS)):
                    part.append(np.frombuffer(x, kind))
        if not parts[0]:
            return
        tokens, homes, least, most, left_over, one, other = bounds(*map(np.concatenate, parts))
        parts.clear()
        known, number = np.unique(homes, return_inverse=True)
        edges = np.append(np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])), len(tokens))
        several = number[one < other]
        lengths, held, n_held = np.diff(edges), [np.unique(several) * (len(known) + 1)], 0

        def emit() -> pa.RecordBatch:
            code = np.unique(np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(known[code // len(known)]), pa.array(known[code % len(known)])], ["a", "b"])

        for length in np.unique(lengths[lengths > 1]):
            runs = edges[:-1][lengths == length]
            step = max(1, HELD_PAIRS // int(length))
            # partner distances, so that a long run is paired a slice at a time
            for gap in range(1, int(length)):
                for at in range(0, len(runs), step):
                    left = (runs[at : at + step, None] + np.arange(length - gap)[None, :]).ravel()
                    right = left + gap
                    near = (most[left] >= threshold * least[right] - 1e-9) & (most[right] >= threshold * least[left] - 1e-9)
                    good = near & (np.minimum(left_over[left], left_over[right]) >= _least_overlap(least[left].astype(np.int64) + least[right], threshold))
                    if good.any():
                        held.append(number[left[good]] * len(known) + number[right[good]])
                        n_held += len(held[-1])
                        if n_held >= HELD_PAIRS:
                            held[:] = [np.unique(np.concatenate(held))]
                            n_held = len(held[0])
                            if n_held >= HELD_PAIRS // 2:
                                yield emit()
                                n_held = 0
        if held:
            yield emit()

    rows = sigs.select("set_id", "home", "n", "n_prefix", "tokens").mapInArrow(lean(spread), "bucket int, tok binary, home binary, least binary, most binary, left binary, one binary, other binary")
    return rows.repartition(buckets, "bucket").mapInArrow(lean(pair), "a long, b long").distinct()


def _members(sigs: DataFrame) -> DataFrame:
    """(set_id, home, doc_id, m, n): each set once, with the least id and the number of its documents."""
    return sigs.groupBy("set_id", "home").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("m"), F.max("n").alias("n"))


def gathered(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(hub, part, a, b): the place where each pair of homes is verified, written.

    Pairs gather around the least neighbour of their first home, so members of one group meet in one place and each set travels there once. Where the sets of one
    side have more than CELL_GRAMS grams together, the pairs are cut into a grid by both homes' hashes, so a home with many partners and a group of many homes are shared out alike.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    hub = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("hub"))
    placed = pairs.join(hub, "a")
    weights = _members(sigs).groupBy("home").agg(F.sum(F.greatest("n", F.lit(LEAST_GRAMS))).alias("n"))
    sides = placed.select("hub", F.posexplode(F.array("a", "b")).alias("side", "home")).distinct().join(weights, "home")
    cells = lambda k: F.ceil(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)) / F.lit(CELL_GRAMS)).cast("long")
    load = sides.groupBy("hub").agg(cells(0).alias("ka"), cells(1).alias("kb"))
    part = (F.pmod(F.xxhash64("a"), "ka") * F.col("kb") + F.pmod(F.xxhash64("b"), "kb")).alias("part")
    return materialise(placed.join(load, "hub").select("hub", part, "a", "b"), "pairs")


def united(root: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The roots of vertices after edges between them; a root is the least vertex of its component and its own root."""
    while True:
        x, y = root[one], root[other]
        apart = x != y
        if not apart.any():
            return root
        one, other, x, y = one[apart], other[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def verified(sigs: DataFrame, placed: DataFrame, threshold: float = THRESHOLD, orders: int = ORDERS, spelt: bool = False) -> DataFrame:
    """What is similar of the pairs of sets that the pairs of homes hold, each compared once, in one cell; ``placed`` is what gathered() gave.

    Sets without a common prefix gram in one of the other orders are passed over. A row (set_id, root, linked) is of a set in a cell: the set that it is connected with there, and the number of documents
    of other sets that it is similar to there; so a cell gives no more rows than it has sets. With ``spelt`` a row (a, b, overlap, na, nb) for each similar pair of sets.
    """
    needed = placed.select("hub", "part", F.explode(F.array("a", "b")).alias("home")).distinct().toDF("own_hub", "own_part", "home")
    needed = needed.join(_members(sigs).drop("n"), "home").join(sigs.select("set_id", "doc_id", "n", "tokens", "classes"), ["set_id", "doc_id"])

    def verify(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _, first = np.unique(right["set_id"].to_numpy(), return_index=True)
        first = first[np.argsort(right["home"].to_numpy()[first], kind="stable")]
        sets, homes, n, m = (right[c].to_numpy()[first] for c in ("set_id", "home", "n", "m"))
        n = n.astype(np.int64)
        joined, cls = (np.concatenate([np.frombuffer(x, kind) for x in _cells(right[c], first)]) for c, kind in (("tokens", np.uint64), ("classes", np.uint8)))
        sizes = np.array([len(x) for x in _cells(right["classes"], first)])
        edges = np.cumsum(sizes) - sizes
        number, distinct = _numbers(joined)
        prefix = np.clip(_prefix(n, threshold) - (n - sizes), 0, sizes)
        views = [(number, sizes)]
        runs = _parts(sizes, PART_GRAMS)
        for order in range(2, orders + 1):
            parts = []
            for i, j in zip(runs[:-1].tolist(), runs[1:].tolist()):
                own, sizes_own = slice(edges[i], edges[j - 1] + sizes[j - 1]), sizes[i:j]
                ranked = number[own][_ranked(joined[own], cls[own], np.repeat(np.arange(j - i), sizes_own), order)]
                parts.append(ranked[np.arange(len(ranked)) - np.repeat(edges[i:j] - edges[i], sizes_own) < np.repeat(prefix[i:j], sizes_own)])
            views.append((np.concatenate(parts), prefix))
        del joined, cls
        views = [(v, c, np.cumsum(c) - c) for v, c in views]
        flag = np.zeros(distinct, bool)

        def span(home: int) -> tuple[int, int]:
            return np.searchsorted(homes, home, "left"), np.searchsorted(homes, home, "right")

        def common(x: int, others: np.ndarray, view: tuple) -> np.ndarray:
            values, counts, starts = view
            own = values[starts[x] : starts[x] + counts[x]]
            flag[own] = True
            sizes = counts[others]
            at = np.repeat(starts[others] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            sums = np.concatenate(([0], np.cumsum(flag[values[at]])))
            flag[own] = False
            ends = np.cumsum(sizes)
            return sums[ends] - sums[ends - sizes]

        out, linked, root = [], np.zeros(len(sets), np.int64), np.arange(len(sets))
        a, b = left["a"].to_numpy(), left["b"].to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
        for s, e in zip(cuts[:-1], cuts[1:]):
            own, (begin, end) = a[s] in b[s:e], span(a[s])
            beyond = np.concatenate([np.zeros(0, np.int64), *(np.arange(*span(h)) for h in b[s:e] if h != a[s])])
            for x in range(begin, end):
                against = np.concatenate((np.arange(x + 1, end), beyond)) if own else beyond
                against = against[np.minimum(n[x], n[against]) >= threshold * np.maximum(n[x], n[against]) - 1e-9]
                runs = _parts(np.maximum(sizes[against], PART_GRAMS // 2000), PART_GRAMS)
                for i, j in zip(runs[:-1].tolist(), runs[1:].tolist()):
                    others = against[i:j]
                    for view in views[1:]:
                        others = others[common(x, others, view) > 0]
                    overlap = common(x, others, views[0])
                    good = overlap >= _least_overlap(n[x] + n[others], threshold)
                    if not good.any():
                        continue
                    others = others[good]
                    if spelt:
                        out.append((np.full(len(others), sets[x]), sets[others], overlap[good].astype(np.int32), np.full(len(others), n[x], np.int32), n[others].astype(np.int32)))
                    else:
                        linked[x] += m[others].sum()
                        linked[others] += m[x]
                        root = united(root, np.full(len(others), x), others)
        if not spelt:
            some = np.flatnonzero(linked)
            return pa.table([pa.array(sets[some]), pa.array(sets[root[some]]), pa.array(linked[some])], ["set_id", "root", "linked"])
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, k) for k in kinds]
        return pa.table([pa.array(c) for c in columns], ["a", "b", "overlap", "na", "nb"])

    cells = placed.groupBy("hub", "part").cogroup(needed.groupBy("own_hub", "own_part"))
    return cells.applyInArrow(lambda key, left, right: roomy(verify)(key, left, right), "a long, b long, overlap int, na int, nb int" if spelt else "set_id long, root long, linked long")


def _similar(docs: DataFrame, threshold: float, gram: int, orders: int, spelt: bool) -> tuple[DataFrame, DataFrame]:
    """(members: distinct doc_id, set_id, check; what verified() gives), both written."""
    buckets = _buckets(docs)
    sigs = materialise(signatures(docs, buckets, threshold, gram), "signatures")
    pairs = materialise(candidates(sigs, buckets, threshold), "candidates")
    placed = gathered(pairs, sigs)
    similar = materialise(verified(sigs, placed, threshold, orders, spelt), "similar")
    discard(pairs, placed)
    return sigs.select("doc_id", "set_id", "check").distinct(), similar


def join(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, orders: int = ORDERS) -> DataFrame:
    """The links between different texts, and who has the same: (doc_id_a, doc_id_b, jaccard).

    Documents with the same set of word n-grams are one text, which its least id stands for. Each pair of texts with a Jaccard similarity of at least
    ``threshold`` is a row with those two ids, the lesser first, and each further document of a text a row of its own with the text's least id and 1.
    Exact: prefixes under ``orders`` global orders only rule out what can't be similar, and what passes all of them is compared in full (grams as
    64-bit hashes). Nothing is capped, and copies aren't expanded into pairs.
    Documents with a null id or text, or without words, are similar to none. Rows with the same id and grams count as one; of an id with several
    texts each is compared, but an id makes no pair with itself. Ties need no rule, as all links are returned. An empty table gives none; further columns are ignored.
    """
    members, similar = _similar(docs, threshold, gram, orders, True)
    least = members.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    score = (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("jaccard")
    apart = similar.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select("x", "y", score)
    same = members.join(least.withColumnRenamed("doc_id", "x"), "set_id").select("x", F.col("doc_id").alias("y"), F.lit(1.0).alias("jaccard"))
    return apart.union(same).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, orders: int = ORDERS) -> DataFrame:
    """One row for each document: (doc_id, class_id, n_links).

    class_id is the least doc_id of the class, the documents that similar pairs connect; n_links is the number of documents that this one is similar
    to itself. Similarity is that of join(), and every link counts, those among copies without being spelt out: a text is compared once and its links are multiplied by the number of its documents.
    A document that is similar to none (as are those with a null text, or without words) is a class of its own, with 0. Repeated rows of an id count
    as one; an id with several texts connects their classes, and its links are those of all its texts added up. Rows with a null id are left out, an empty table gives none; further columns are ignored.
    """
    members, found = _similar(docs, threshold, gram, orders, False)
    several = members.groupBy("doc_id").agg(F.collect_set("set_id").alias("sets")).where(F.size("sets") > 1)
    within = several.select(F.array_min("sets").alias("a"), F.explode("sets").alias("b")).where("a <> b")
    roots = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")).union(within))
    grouped = members.join(roots, members.set_id == roots.v, "left").select("doc_id", "set_id", F.coalesce("root", "set_id").alias("root"))
    first = grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    sizes = members.groupBy("set_id").agg(F.count("*").alias("m"))
    links = found.groupBy("set_id").agg(F.sum("linked").alias("linked"))
    own = sizes.join(links, "set_id", "left").select("set_id", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("links"))
    rows = grouped.join(first, "root").join(own, "set_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    every = docs.select(docs["doc_id"].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return every.join(rows, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (a, b): the least vertex of its connected component, by large and small stars until nothing changes."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        e = e.union(e.select("b", "a")).toDF("a", "b") if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = e.join(least, "a")
        if large:
            return e.where("b > a").select("b", "m").toDF("a", "b").distinct()
        return e.select("b", "m").union(least.select("a", "m")).toDF("a", "b").where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while (now := state(edges)) != before:
        before, older = now, edges
        edges = materialise(stars(stars(older, True), False), "edges")
        discard(older)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, orders: int = ORDERS) -> DataFrame:
    """The rows of docs with one document left, that with the least id, of each class of classes(); all columns.

    Rows of one id stay or go together, repeated rows included. Rows with a null id or text, or without words, are in no class and stay. An empty table gives none.
    """
    found = classes(docs.select("doc_id", "text"), threshold, gram, orders)
    gone = materialise(found.where("class_id <> doc_id").select(F.col("doc_id").alias("gone")), "gone")
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


_PAIRS_SQL = rf"""cut AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= {GRAM} THEN list_transform(range(1, len(w) - {GRAM} + 2), lambda i: array_to_string(w[i : i + {GRAM - 1}], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
    FROM cut WHERE len(w) > 0),
flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS overlap FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT x, y FROM shared WHERE overlap >= ceil({THRESHOLD} / (1 + {THRESHOLD}) * (na + nb) - 1e-9)),
ends AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs)"""
CLASSES_SQL = f"""
WITH RECURSIVE {_PAIRS_SQL},
reached AS (SELECT DISTINCT doc_id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, e.y FROM reached r JOIN ends e ON r.other = e.x)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM ends e WHERE e.x = reached.doc_id) AS n_links FROM reached GROUP BY doc_id"""
