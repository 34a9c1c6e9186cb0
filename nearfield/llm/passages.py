"""Near-duplicate passages by seeds: the least key of each run of words that a near passage must share, then exact verification.

Between steps seeds travel as NumPy records, packed by the bucket that they are dealt to; a bucket has a bounded share of the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, grown, released, saved, shrunk, slices, string_buffers, texts

#: A token is a shingle of SHINGLE words. Where equal tokens of two passages break off, the two lack BREAK tokens at least: 10 for a
#: replaced word, 9 for one inserted or deleted, 8 where parts change places, 7 for a word that one says once and the other twice.
SHINGLE, BREAK = 5, 7
#: Members of a seed's group whose pairs are all compared at once, and about how many of each of two blocks a task of the last comparison has.
SMALL, BLOCK = 8, 2048
WORDS, PERCENT = 50, 80
#: Bytes of text whose seeds share a bucket, and the fewest buckets.
BUCKET, BUCKETS = 16 << 20, 32

#: A seed or part: its hash, text and first word. An equal part: its text, the least one in this bucket or the table, first word and hash.
PART = np.dtype([("v", "<u8"), ("t", "<i8"), ("s", "<i4"), ("told", "?")])
EQUAL = np.dtype([("t", "<i8"), ("u", "<i8"), ("s", "<i4"), ("v", "<u8")])
#: A shared seed with hashes of the one before and after it, and of the repeated parts that begin and end with it; 0 for none.
MEMBER = np.dtype([("v", "<u8"), ("t", "<i8"), ("s", "<i4"), ("before", "<u8"), ("after", "<u8"), ("begins", "<u8"), ("ends", "<u8")])


def tokens(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The hash of the k words from each word on; fewer words than k give none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = W.mix(out * W._BASE + h[i : i + n])
    return out


def compact_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int):
    """(left, pivot, right) of the nodes of Cartesian trees over values[start:end] whose span has ``least`` values or more.

    Every part of a node's span around its pivot has the pivot's value as its minimum, the first of equals. Trees are cut level by
    level: all least values of a span are pivots, of what follows the one before, and what lies between them are spans of the
    next level, so equal values don't make a tree deep.
    """
    lefts, pivots, rights = [], [], []
    keep = ends - starts >= least
    a, b = starts[keep], ends[keep]
    while len(a):
        sizes = b - a
        at = np.cumsum(sizes) - sizes
        flat = np.repeat(a - at, sizes) + np.arange(int(sizes.sum()))
        x = values[flat]
        hit = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, at), sizes))
        span = np.searchsorted(at, hit, "right") - 1
        c = flat[hit]
        follows = np.diff(span, prepend=-1) == 0
        left = np.where(follows, np.roll(c, 1) + 1, a[span])
        right = b[span] - 1
        wide = right - left + 1 >= least
        lefts.append(left[wide])
        pivots.append(c[wide])
        rights.append(right[wide])
        last = np.flatnonzero(np.append(~follows[1:], True))
        a, b = np.concatenate([left, c[last] + 1]), np.concatenate([c, b])
        keep = b - a >= least
        a, b = a[keep], b[keep]
    if not lefts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(lefts), np.concatenate(pivots), np.concatenate(rights)


def run_of(least: int, percent: int) -> int:
    """Tokens that two passages of ``least`` tokens or more share in one run at least if 100 I >= percent (m + n - I).

    They lack m + n - I - I <= I (100 - percent) / percent tokens together. Each break between runs takes BREAK of them, so there are
    few, and the longest run has the mean length at least. It grows with I between breaks, so the ends of I's stretches tell.
    """
    fewest = -(-percent * 2 * least // (100 + percent))
    return min(-(-i // (i * (100 - percent) // (BREAK * percent) + 1)) for i in range(fewest, fewest + 64 * BREAK * least))


def firsts(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` neighbours, the first of equals."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = x[:n].copy(), np.arange(n)
    for i in range(1, width):
        less = x[i : i + n] < best
        best[less] = x[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return at


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbours, by prefix sums of a polynomial."""
    if len(x) < width:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(W._BASE), -1, 1 << 64))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * np.cumprod(np.full(len(x), W._BASE)), out=sums[1:])
    n = len(x) - width + 1
    return W.mix((sums[width:] - sums[:-width]) * np.cumprod(np.full(n, inverse)))


# --- verification --------------------------------------------------------------------------------------
def aligned(x: np.ndarray, y: np.ndarray, least: int, percent: int):
    """(pair, first in x, end in x, first in y, end in y) of passages around the middle of rows of two matrices of tokens, whose sets are alike enough.

    0 in x and 1 in y stand for no token. From the middle, which both rows share, equal tokens are followed to either side, each on the nearest diagonal
    and in the same order in x and y, so words may be replaced, inserted or deleted. With I equal tokens a passage of
    m and n tokens is alike enough if 100 I >= percent (m + n - I). Ends fall on equal tokens, or as many tokens further out
    as the passage lacks to ``least``; of the passages that reach, the longest is taken, and confirmed on its sets of tokens.
    """
    n, width = x.shape
    half = width // 2
    band = half * (100 - percent) // percent  # more inserted and deleted tokens than that cost more than all of a side gains
    none = 1 << 14
    shift = np.full((n, width), none, np.int16)
    for s in sorted(range(-band, band + 1), key=lambda s: -abs(s)):  # the nearest diagonal comes last and stays
        low, high = max(0, -s), min(width, width - s)
        np.copyto(shift[:, low:high], np.int16(s), where=x[:, low:high] == y[:, low + s : high + s])

    def side(sign: int, first: int):
        """Gain and length in y of the part from the middle to each place of x on a side."""
        k = np.arange(first, half + 1)
        s = shift[:, half + sign * k].astype(np.int32)
        far = k + sign * s
        far = np.where((s < none) & (far >= first), far, -1)
        before = np.concatenate([np.full((n, 1), -1), np.maximum.accumulate(far, 1)[:, :-1]], 1)
        ok = far > before
        count = np.cumsum(ok, 1)
        lengths = (k + 1 - first) + (far + 1 - first)
        return np.where(ok, (100 + percent) * count - percent * lengths, -(1 << 28)).astype(np.int32), (far + 1 - first).astype(np.int32), count[:, -1]

    gain, right, many = side(1, 0)
    gain_left, left, many_left = side(-1, 1)
    gain_left = np.concatenate([np.zeros((n, 1), np.int32), gain_left], 1)
    left = np.concatenate([np.zeros((n, 1), np.int32), left], 1)
    live = np.flatnonzero((many + many_left) * (100 + percent) >= percent * 2 * least)
    k = np.arange(half + 1, dtype=np.int32)
    for part in (0.125, 0.25, 0.5, 1):  # a lack costs no less than a part of what is short of ``least``, which each side has a bound of by itself
        price = np.float32(percent * part)
        bound = (gain[live] + price * (k + 1 + right[live])).max(1) + (gain_left[live] + price * (k + left[live])).max(1)
        live = live[bound >= 2 * price * least - 1]
    long_x = k[:, None] + 1 + k[None, :]
    lack_x = np.maximum(least - long_x, 0)
    found = []
    for low in range(0, len(live), 128):
        rows = live[low : low + 128]
        long_y = right[rows][:, :, None] + left[rows][:, None, :]
        total = gain[rows][:, :, None] + gain_left[rows][:, None, :] - percent * (lack_x + np.maximum(least - long_y, 0))
        best = np.where(total >= 0, long_x, 0).reshape(len(rows), -1)
        at = best.argmax(1)
        ok = best[np.arange(len(rows)), at] > 0
        found.append(np.stack([rows[ok], at[ok] // (half + 1), at[ok] % (half + 1)], 1))
    row, far_right, far_left = np.concatenate(found).T if found else (np.zeros(0, np.int64),) * 3
    a, b = half - far_left, half + far_right + 1
    p, q = half - left[row, far_left], half + right[row, far_right]
    x, y = x[row], y[row]

    def padded(held, a, b):
        columns = np.arange(width)
        first = np.where(held, columns, width).min(1)
        end = np.where(held, columns, -1).max(1) + 1
        b = np.maximum(b, np.minimum(end, a + least))
        return np.minimum(a, np.maximum(first, b - least)), b

    a, b = padded(x > 0, a, b)
    p, q = padded(y > 1, p, q)
    ok = (b - a >= least) & (q - p >= least) & alike(x, y, a, b, p, q, percent)
    return row[ok], a[ok], b[ok], p[ok], q[ok]


def alike(x, y, a, b, p, q, percent: int) -> np.ndarray:
    """Which rows' sets of x[a:b] and y[p:q] have a Jaccard similarity of percent or more."""
    if not len(x):
        return np.zeros(0, bool)
    top = np.iinfo(np.uint64).max
    columns = np.arange(x.shape[1])

    def distinct(x, a, b):
        x = np.sort(np.where((columns >= a[:, None]) & (columns < b[:, None]), x, top), 1)
        x[:, 1:][x[:, 1:] == x[:, :-1]] = top
        return x, (x < top).sum(1)

    (x, m), (y, n) = distinct(x, a, b), distinct(y, p, q)
    both = np.sort(np.concatenate([x, y], 1), 1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < top)).sum(1)
    return 100 * common >= percent * (m + n - common)


def lacking(usual: np.ndarray, least: int, percent: int) -> np.ndarray:
    """How many tokens besides the usual ones that it has a row must share, at least, if a passage lies around its middle.

    A passage of m and n tokens that shares I has 100 I >= percent (m + n - I), where m and n are ``least`` or more and n is I or
    more. No more of the I are usual ones than the row has in the passage's m, for any m around the middle.
    """
    n, width = usual.shape
    half = width // 2
    right = np.cumsum(usual[:, half:], 1, dtype=np.int16)
    left = np.concatenate([np.zeros((n, 1), np.int16), np.cumsum(usual[:, :half][:, ::-1], 1, dtype=np.int16)], 1)
    k = np.arange(half + 1)
    m = np.maximum(k[:, None] + k[None, :] + 1, least)
    fewest = -(-percent * (m + least) // (100 + percent))
    fewest = np.where(fewest <= least, fewest, -(-percent * m // 100)).astype(np.int16)
    out = np.zeros(n, np.int16)
    for low in range(0, n, 64):
        rows = slice(low, low + 64)
        out[rows] = (fewest - right[rows, :, None] - left[rows, None, :]).min((1, 2))
    return out


def candidates(x: np.ndarray, component: np.ndarray, run: np.ndarray, side: np.ndarray, across: bool, least: int, percent: int):
    """(first row of each class, each row's class, pairs of classes) of a matrix of tokens, 0 for none: those in different components that may have a passage around their middles in common.

    Equal rows are a class, compared once for all of them. Pairs whose runs are equal are known. If ``across``, pairs are of different sides. Tokens that few classes have are
    counted for each pair; of the others, which much of the group has, as many count as found as the row has (lacking()).
    """
    _, first, of = np.unique(np.column_stack([x, run.astype(np.int64).view(np.uint64), side.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    n = len(first)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, of, component)
    np.maximum.at(high, of, component)
    mixed = low < high
    x, run, side = x[first], run[first], side[first]
    ids = np.unique(x, return_inverse=True)[1].reshape(x.shape)
    order = np.argsort(np.where(x > 0, ids, -1), axis=None, kind="stable")[np.count_nonzero(x == 0) :]
    held_by, flat = order // x.shape[1], ids.ravel()[order]
    start = np.searchsorted(flat, np.arange(ids.max(initial=-1) + 2))
    new = (np.diff(flat, prepend=-1) != 0) | (np.diff(held_by, prepend=-1) != 0)
    usual = np.bincount(flat[new], minlength=len(start) - 1) > max(16, n // 8)
    need = lacking(usual[ids] & (x > 0), least, percent)
    kinds, many = np.unique(component, return_counts=True)
    alone = mixed | (low != kinds[many.argmax()])
    pairs = [np.zeros((0, 2), np.int64)]
    for k in np.flatnonzero(alone):
        mine = np.unique(ids[k][x[k] > 0])
        places = [held_by[start[i] : start[i + 1]] for i in mine[~usual[mine]]]
        count = np.bincount(np.concatenate(places), minlength=n) if places else np.zeros(n, np.int64)
        other = (count >= np.maximum(need, need[k])) & (mixed | mixed[k] | (low != low[k])) & ((run == 0) | (run != run[k]))
        other = np.flatnonzero(other & (side != side[k]) if across else other)
        other = other[~alone[other] | (other >= k)]
        pairs.append(np.stack([np.full(len(other), k), other], 1))
    return first, of, np.concatenate(pairs)


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """(first, end) in tokens of the parts that spans cover; those whose words meet or overlap are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1] + SHINGLE:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


# --- records -------------------------------------------------------------------------------------------
def shared(rows: np.ndarray, *last: str):
    """(rows in order of v, t and ``last``; which begin a v; the number of each row's v; which v's have several texts)."""
    rows = rows[np.lexsort([rows[c] for c in (*reversed(last), "t", "v")])]
    new = np.diff(rows["v"], prepend=~rows["v"][:1]) != 0
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(rows))[: len(first)] - 1
    return rows, new, of, rows["t"][first] != rows["t"][end]


def record(dtype: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(next(iter(columns.values()))), dtype)
    for name, x in columns.items():
        out[name] = x
    return out


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def dealt(parts: list[tuple[int, np.ndarray, np.ndarray]]):
    """Arrow columns (kind, bucket, data) of records: (kind, each one's bucket, records). Within a bucket a text's records follow one another, which the shuffle's compression makes small."""
    import pyarrow as pa

    kinds, buckets, data = [], [], []
    for kind, bucket, rows in parts:
        order = np.lexsort([rows[rows.dtype.names[2]], rows["t"], bucket])
        bucket, rows = bucket[order], rows[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(rows)), strict=False):
            kinds.append(kind)
            buckets.append(int(bucket[low]))
            data.append(rows[low:high].tobytes())
    return [pa.array(kinds, pa.int8()), pa.array(buckets, pa.int64()), pa.array(data, pa.binary())]


def held(table, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("data").to_pylist()), dtype)


RECORDS, NAMES = "kind byte, bucket long, data binary", ["kind", "bucket", "data"]


LINK = np.dtype([("t", "<i8"), ("u", "<i8"), ("c", "<i4"), ("d", "<i4")])


def near_passages(df: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_passages, n_words, component_id, kept, passages) for each row of df; keys are whole numbers.

    A passage is a part of ``words`` words or more whose 5-word shingles have a Jaccard similarity of percent or more with a
    part of another row's text. passages has (first word, number of words) of each, joined where they overlap;
    n_words counts the words in them. component_id is the least key that shared passages reach, kept says that it is the row's own.

    1. Two such parts share a run of words (run_of()), in which the same key of a few words is the least: a seed. Seeds of all distinct texts are
       grouped over the whole table; those that no other text has go.
    2. Parts of a passage's length whose seeds are all left are grouped by their whole content. So every part that is repeated word
       for word is found, and its texts are linked to the least of them.
    3. The surroundings of texts that share a seed are aligned word by word (aligned()), with replaced, inserted and deleted words; equal parts in
       another order are not put together. Pairs whose run began with an earlier seed, or goes on for a repeated part, are known and left out; the
       texts of a repeated part are compared with the least one only, for what is alike on either side of the part.
    4. In a seed's group of more than SMALL members each is first compared with the least and three others. Then those of its members that links haven't brought into one
       component are compared with those of all others, and those that no passage found so far covers with all. So no link is lost that would change a component and no place of a passage, while near copies
       in any number cost about one comparison each; how far a passage goes is what the compared members share. Places with equal surroundings are one there, and surroundings' rare tokens are counted first (candidates()), so that texts that have but a line of words
       in common give few pairs. Groups are cut into blocks, and each two blocks are a task's, so a group's size isn't one task's.

    Values and parts that many texts of a bucket share are reduced there to one before they are dealt, so that a common one
    comes to one task as few records. Texts are named by a hash of their content: which text stands for a group, and with it the
    result, depends on the data alone and not on partitions. What is lost: passages whose breaks take less than BREAK tokens, for which
    phrases of several words must be said twice in one and once in the other, more than once in a passage.

    Equal texts are one text with several rows: if it has ``words`` words, all of it is a passage of each.
    Null and empty texts and texts with fewer words have none. Rows with a null key have a null component and are kept; rows
    that repeat a key are several texts of one document. Other columns are left out. An empty table gives no rows.
    """
    import pyarrow as pa

    least = words - SHINGLE + 1
    if not 1 <= least <= 255:
        raise ValueError(f"a passage has {SHINGLE} to {254 + SHINGLE} words at least")
    run = run_of(least, percent) + SHINGLE - 1
    width = max(1, run * 7 // 10)  # words of a seed; a run has one of them at least
    reach = 2 * least  # tokens on either side of a place that are compared; places of a longer passage are nearer to each other

    def pack(batches):
        for whole in batches:
            for some in slices(whole, 1):
                data, at = string_buffers(some.column(1))
                raw = [data[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)]
                digest = [hashlib.md5(r).digest() for r in raw]
                name = np.frombuffer(b"".join(digest), "<i8")[::2]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(digest, pa.binary()), pa.array(name), pa.array([len(r) for r in raw], pa.int64()), pa.array([shrunk(r) for r in raw], pa.binary())], ["id", "digest", "t", "size", "z"])

    kind = df.schema[key].dataType.simpleString()
    packed = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(pack, f"id {kind}, digest binary, t long, size long, z binary")
    texts = saved(packed.groupBy("digest").agg(F.first("t").alias("t"), F.first("size").alias("size"), F.first("z").alias("z"), F.min("id").alias("rep"), F.count("*").alias("copies")))
    released(df.sparkSession)
    n_buckets = max(BUCKETS, (texts.agg(F.sum("size")).first()[0] or 0) // BUCKET)
    bucket = F.pmod(F.conv(F.hex("t"), 16, 10).cast("decimal(20,0)"), F.lit(n_buckets)).cast("long")
    side = texts.withColumn("bucket", bucket).select("bucket", "t", "z", "size")

    def flat_words(zs: list[bytes]):
        raw = [grown(z) for z in zs]
        h, _, at = W.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return h, at

    def seeded(h: np.ndarray, at: np.ndarray):
        """(runs' first words, their seeds, all keys) of texts that are long enough for a passage."""
        keys = rolling(h, width)
        seed = firsts(keys, run - width + 1)
        size = np.diff(at)
        end = np.repeat(np.where(size >= words, at[1:], 0), size)[: len(seed)]
        first = np.flatnonzero(np.arange(len(seed)) + run <= end)
        return first, seed[first], keys

    def seeds(batches):
        for whole in batches:
            for batch in slices(whole, 2, 4 << 20, 4096):
                h, at = flat_words(batch.column(1).to_pylist())
                _, seed, keys = seeded(h, at)
                seed = seed[np.diff(seed, prepend=-1) > 0]
                of = np.searchsorted(at, seed, "right") - 1
                rows, new, of, many = shared(record(PART, v=keys[seed], t=batch.column(0).to_numpy()[of], s=seed - at[of]), "s")
                if len(rows):
                    known = many[of]  # what several texts of this batch have is known to be shared; one seed goes on for the others
                    one = ~known | new
                    told = rows[one].copy()
                    told["told"] = known[one]
                    yield pa.RecordBatch.from_arrays(dealt([(0, bucket_of(told["v"], n_buckets), told), (1, bucket_of(rows["t"][known], n_buckets), rows[known])]), NAMES)

    def keep_shared(table):
        if table.column("kind")[0].as_py():
            return table.select(NAMES)
        rows, new, of, many = shared(held(table, PART), "s")
        if len(rows):
            many |= np.logical_or.reduceat(rows["told"], np.flatnonzero(new))
        rows = rows[many[of] & ~rows["told"]]
        return pa.table(dealt([(1, bucket_of(rows["t"], n_buckets), rows)]), names=NAMES)

    left = saved(texts.select("t", "z", "size").mapInArrow(seeds, RECORDS).groupBy("kind", "bucket").applyInArrow(keep_shared, RECORDS))
    released(df.sparkSession)

    def parts(mine, side):
        """Contents of parts whose seeds are all shared; equal ones of this bucket are linked here."""
        out = []
        if mine.num_rows:
            rows = held(mine, PART)
            names, of = np.unique(rows["t"], return_inverse=True)
            order = np.argsort(of, kind="stable")
            place, cuts = rows["s"][order], np.searchsorted(of[order], np.arange(len(names) + 1))
            t, z = side.column("t").to_numpy(), side.column("z")
            order = np.argsort(t)
            where = order[np.searchsorted(t[order], names)]
            done, low = [], 0
            sizes = np.cumsum(side.column("size").to_numpy()[where])
            while low < len(names):
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + (4 << 20), "right")))
                h, at = flat_words([z[int(n)].as_py() for n in where[low:high]])
                left = np.zeros(len(h) + 1, bool)
                left[np.repeat(at[:-1], np.diff(cuts[low : high + 1])) + place[cuts[low] : cuts[high]]] = True
                first, seed, _ = seeded(h, at)
                whole = np.zeros(len(h) + words + 1, np.int64)
                whole[first + 1] = left[seed]
                whole = np.cumsum(whole)
                begin = np.flatnonzero(whole[words - run + 1 : len(h) + words - run + 1] - whole[: len(h)] == words - run + 1)
                of = np.searchsorted(at, begin, "right") - 1
                done.append(record(PART, v=rolling(h, words)[begin] | np.uint64(1), t=names[low + of], s=begin - at[of]))
                low = high
            rows, new, of, many = shared(np.concatenate(done), "s")
            lead = np.flatnonzero(new)[of]
            known = many[of]
            other = rows["t"] != rows["t"][lead]
            told = rows[~other].copy()
            told["told"] = known[~other]
            again = rows[other]
            out = [(0, bucket_of(told["v"] >> np.uint64(1), n_buckets), told), (1, bucket_of(again["t"], n_buckets), record(EQUAL, t=again["t"], u=rows["t"][lead][other], s=again["s"], v=again["v"]))]
        return pa.table(dealt(out), names=NAMES)

    def equal(table):
        if table.column("kind")[0].as_py():
            return table.select(NAMES)
        rows, new, of, many = shared(held(table, PART), "s")
        first = np.flatnonzero(new)
        many |= np.maximum.reduceat(rows["told"], first) if len(rows) else many
        rows, u = rows[many[of]], rows["t"][first][of][many[of]]
        return pa.table(dealt([(1, bucket_of(rows["t"], n_buckets), record(EQUAL, t=rows["t"], u=u, s=rows["s"], v=rows["v"]))]), names=NAMES)

    by_bucket = lambda a, b: a.groupBy("bucket").cogroup(b.groupBy("bucket"))
    same = by_bucket(left, side).applyInArrow(parts, RECORDS).groupBy("kind", "bucket").applyInArrow(equal, RECORDS)

    def sign(mine, same):
        """Repeated parts as spans (kind 2) and links (kind 3), and shared seeds with what surrounds them (kind 0)."""
        if not mine.num_rows:
            return pa.table(dealt([]), names=NAMES)
        equals = held(same, EQUAL)
        names, of = np.unique(equals["t"], return_inverse=True)
        size = np.zeros(len(names), np.int64)
        np.maximum.at(size, of, equals["s"] + 1)
        base = np.cumsum(size + 1) - size  # a gap ends a run with its text
        again = np.zeros(int(base[-1] + size[-1]) + 2 if len(names) else 1, np.uint64)
        again[base[of] + equals["s"]] = equals["v"]
        change = np.diff((again > 0).astype(np.int8))
        first, last = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1)
        text = np.searchsorted(base, first, "right") - 1
        spans = record(LINK, t=names[text], u=names[text], c=first - base[text], d=last - base[text] + least)
        pairs = np.stack([equals["t"], equals["u"]], 1)[equals["t"] != equals["u"]]
        pairs = np.unique(pairs, axis=0)
        links = record(LINK, t=pairs[:, 0], u=pairs[:, 1])

        rows = held(mine, PART)
        rows = rows[np.lexsort([rows["s"], rows["v"], rows["t"]])]
        same_text = np.diff(rows["t"], prepend=~rows["t"][:1]) == 0
        # a seed that comes again within its own length is part of a repetition with fewer tokens than a run
        rows = rows[~(same_text & (np.diff(rows["v"], prepend=~rows["v"][:1]) == 0) & (np.diff(rows["s"], prepend=-1) <= width))]
        rows = rows[np.lexsort([rows["s"], rows["t"]])]
        gap = np.diff(rows["s"]).astype(np.int64)
        touch = (np.diff(rows["t"]) == 0) & (gap <= width)
        step = W.mix(gap.astype(np.uint64) + np.uint64(1))
        before, after = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        before[1:] = np.where(touch, W.mix(rows["v"][:-1] ^ step) | np.uint64(1), 0)
        after[:-1] = np.where(touch, W.mix(rows["v"][1:] ^ step) | np.uint64(1), 0)

        def part(s):
            k = np.minimum(np.searchsorted(names, rows["t"]), max(0, len(names) - 1))
            if not len(names):
                return np.zeros(len(rows), np.uint64)
            ok = (names[k] == rows["t"]) & (s >= 0) & (s < size[k])
            return np.where(ok, again[np.where(ok, base[k] + s, 0)], 0)

        members = record(MEMBER, v=rows["v"], t=rows["t"], s=rows["s"], before=before, after=after, begins=part(rows["s"]), ends=part(rows["s"] + width - words))
        return pa.table(dealt([(0, bucket_of(members["v"], n_buckets), members), (2, bucket_of(spans["t"], n_buckets), spans), (3, bucket_of(links["t"], n_buckets), links)]), names=NAMES)

    def compared(rows, i, j):
        """Which pairs of members are of different texts and not known from an earlier seed of their run or from a repeated part."""
        a, b = rows[i], rows[j]
        known = np.zeros(len(a), bool)
        for c in ("before", "begins", "ends"):
            known |= (a[c] > 0) & (a[c] == b[c])
        return (a["t"] != b["t"]) & ~known

    LINKED = "kind byte, t long, u long, c long, d long, v long, before long"

    def told_of(kind, t, u, c, d, v=None, before=None):
        none = np.zeros(len(t), np.int64)
        columns = [x.astype("i8") if x.dtype != np.uint64 else x.view("i8") for x in (t, u, c, d, none if v is None else v, none if before is None else before)]
        return pa.table([pa.array(np.full(len(t), kind, np.int8)), *map(pa.array, columns)], names=["kind", "t", "u", "c", "d", "v", "before"])

    def link(table):
        what = table.column("kind")[0].as_py()
        if what:
            rows = held(table, LINK)
            return told_of(what, rows["t"], rows["u"], rows["c"], rows["d"])
        rows, new, of, many = shared(held(table, MEMBER), "s")
        some = many[of]
        rows, new = rows[some], new[some]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        of = np.cumsum(new) - 1
        pairs = []
        # what a repeated part has on either side is compared with its least text
        for part_, beside in (("begins", "before"), ("ends", "after")):
            k = np.flatnonzero(rows[part_] > 0)
            k = k[np.lexsort([k, rows[part_][k], of[k]])]
            lead = np.maximum.accumulate(np.where((np.diff(rows[part_][k], prepend=0) != 0) | (np.diff(of[k], prepend=-1) != 0), np.arange(len(k)), 0))
            i, j = k, k[lead]
            differ = (rows["t"][i] != rows["t"][j]) & ((rows[beside][i] == 0) | (rows[beside][i] != rows[beside][j]))
            pairs.append((i[differ], j[differ]))
        # all pairs of small groups; in large ones each member with the least and, as texts' names are random, with some at random
        rank = np.arange(len(rows)) - first[of]
        small = size[of] <= SMALL
        for k in range(1, SMALL):
            i = np.flatnonzero(small & (rank >= k))
            pairs.append((i, i - k))
        i = np.flatnonzero(~small & (rank > 0))
        pairs.append((i, first[of[i]]))
        for k in (1, 2, 3):
            i = np.flatnonzero(~small & (rank > k))
            pairs.append((i, i - k))
        for n in range(2, len(pairs)):
            i, j = pairs[n]
            ok = compared(rows, i, j)
            pairs[n] = i[ok], j[ok]
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        both = np.unique(np.stack([i, j], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        near = told_of(1, rows["t"][both[:, 0]], rows["t"][both[:, 1]], rows["s"][both[:, 0]], rows["s"][both[:, 1]])
        # members of a group whose runs all began before are settled there
        begun = rows["before"][first]
        mixed = np.zeros(len(first), bool)
        np.logical_or.at(mixed, of, (rows["before"] == 0) | (rows["before"] != begun[of]))
        late = rows[~small & mixed[of]]
        return pa.concat_tables([near, told_of(4, late["t"], late["t"], late["s"], late["s"], late["v"], late["before"])])

    told = saved(by_bucket(left, same).applyInArrow(sign, RECORDS).groupBy("kind", "bucket").applyInArrow(link, LINKED))
    released(df.sparkSession)

    def surroundings(mine, side):
        """mine(bucket, t, c, ...) with the words around each token c of text t, as 32-bit hashes, and how many of them come before it."""
        out, before = [], []
        where = {t: k for k, t in enumerate(side.column("t").to_pylist())}
        z = side.column("z")
        t, c = mine.column("t").to_numpy(), mine.column("c").to_numpy()
        order = np.lexsort([c, t])
        last = None
        for k in order:
            if t[k] != last:
                last = t[k]
                raw = np.frombuffer(grown(z[where[last]].as_py()), np.uint8)
                h = (W.words(raw, np.array([0, len(raw)]))[0] >> np.uint64(32)).astype("<u4")
            low = max(0, c[k] - reach)
            out.append(h[low : c[k] + reach + SHINGLE].tobytes())
            before.append(c[k] - low)
        return mine.take(pa.array(order)).append_column("words", pa.array(out, pa.binary())).append_column("before", pa.array(before, pa.int64()))

    def matrix(found: list[bytes], before: np.ndarray, none: int) -> np.ndarray:
        """A row of tokens for each place, the place's own in the middle."""
        size = np.array([len(w) // 4 for w in found], np.int64)
        first = reach - before
        h = np.zeros((len(found), 2 * reach + SHINGLE), np.uint64)
        columns = np.arange(h.shape[1])
        h[(columns >= first[:, None]) & (columns < (first + size)[:, None])] = np.frombuffer(b"".join(found), "<u4")
        out = np.full((len(found), 2 * reach + 1), SHINGLE, np.uint64)
        for i in range(SHINGLE):
            out = W.mix(out * W._BASE + h[:, i : i + 2 * reach + 1])
        columns = columns[: 2 * reach + 1]
        out[(columns < first[:, None]) | (columns >= (first + size - SHINGLE + 1)[:, None])] = none
        return out

    FOUND = ["t", "u", "a", "b"]

    def spans_of(t, u, x, y, a, b, p, q):
        """Rows of FOUND: passages of texts t that texts u have too, and u's own."""
        return np.unique(np.stack([np.concatenate(z) for z in ((t, u), (u, u), (a + x, p + y), (b + x, q + y))], 1), axis=0)

    def verify(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                t, u, c, d, before, theirs = (batch.column(k).to_numpy() for k in (0, 1, 2, 3, 5, 7))
                row, a, b, p, q = aligned(matrix(batch.column(4).to_pylist(), before, 0), matrix(batch.column(6).to_pylist(), theirs, 1), least, percent)
                out = spans_of(t[row], u[row], c[row] - reach, d[row] - reach, a, b, p, q)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(4)], FOUND)

    def crossing(table):
        """The passages of a group's members in different components, of a block or of two; a place that no passage covers is a component of its own."""
        table = table.sort_by([("t", "ascending"), ("c", "ascending")])
        t, c, runs, component, before, block, i, j = (table.column(k).to_numpy() for k in ("t", "c", "run", "component", "before", "block", "i", "j"))
        x = matrix(table.column("words").to_pylist(), before, 0)
        first, of, pairs = candidates(x, component, runs, block == j, bool(i[0] < j[0]), least, percent)
        order = np.argsort(of, kind="stable")  # a class' members, by their texts
        cuts = np.searchsorted(of[order], np.arange(len(first) + 1))
        out = [np.zeros((0, 4), np.int64)]
        for low in range(0, len(pairs), 1024):
            m, o = pairs[low : low + 1024].T
            row, *ends = aligned(x[first[m]], np.where(x[first[o]] == 0, np.uint64(1), x[first[o]]), least, percent)
            for r, a, b, p, q in zip(row, *ends, strict=True):
                # all members have the passage; each is linked to the other class' first or last text, one that isn't its own
                ours, theirs = (order[cuts[k] : cuts[k + 1]] for k in (m[r], o[r]))
                for some, others, begin, end in ((ours, theirs, a, b), (theirs, ours, p, q)):
                    u = np.where(t[others[0]] != t[some], t[others[0]], t[others[-1]])
                    out.append(np.stack([t[some], u, c[some] - reach + begin, c[some] - reach + end], 1)[t[some] != u])
        out = np.unique(np.concatenate(out), axis=0)
        return pa.table([pa.array(out[:, k]) for k in range(4)], names=FOUND)

    def verified(near):
        """(t, u, a, b) of the passages around pairs of places, and (u, u, a, b) of their counterparts."""
        named = near.withColumn("bucket", bucket)
        mine = by_bucket(named, side).applyInArrow(lambda a, b: surroundings(a, b).select(["t", "u", "c", "d", "words", "before"]), "t long, u long, c long, d long, words binary, before long")
        wanted = near.select(F.col("u").alias("t"), F.col("d").alias("c")).distinct().withColumn("bucket", bucket)
        theirs = by_bucket(wanted, side).applyInArrow(lambda a, b: surroundings(a, b).select(["t", "c", "words", "before"]), "t long, c long, words binary, before long")
        theirs = saved(theirs.select(F.col("t").alias("u"), F.col("c").alias("d"), F.col("words").alias("theirs"), F.col("before").alias("theirs_before")))
        released(df.sparkSession)
        both = mine.join(theirs, ["u", "d"]).select("t", "u", "c", "d", "words", "before", "theirs", "theirs_before")
        return saved(both.mapInArrow(verify, "t long, u long, a long, b long"))

    spans_by_text = lambda found: found.where("b > 0").groupBy("t").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    ends = lambda found: found.select(F.col("t").alias("a"), F.col("u").alias("b")).where("a <> b")
    found = verified(told.where("kind = 1").select("t", "u", "c", "d"))
    released(df.sparkSession)
    found = found.unionByName(told.where("kind in (2, 3)").select("t", "u", F.col("c").alias("a"), F.col("d").alias("b")))
    linked = components(ends(found))

    late = told.where("kind = 4").select("v", "t", "c", "before")
    # a place that no passage covers is compared with all others, whatever else links its text: it counts as a component of its own
    covered = F.exists("spans", lambda p: (p["a"] <= F.col("c")) & (F.col("c") < p["b"]))
    late = late.join(linked, late["t"] == linked["id"], "left").join(spans_by_text(found), "t", "left")
    late = late.select("v", "t", "c", "before", F.when(covered, F.coalesce("component", "t")).otherwise(F.bitwise_not("t")).alias("component"))
    apart = late.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("v", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    late = saved(late.join(apart, "v"))
    if not late.isEmpty():
        named = late.withColumnRenamed("before", "run").withColumn("bucket", bucket)
        around = by_bucket(named, side).applyInArrow(lambda a, b: surroundings(a, b).select(["v", "t", "c", "run", "component", "blocks", "words", "before"]), "v long, t long, c long, run long, component long, blocks long, words binary, before long")
        # each two blocks of a group are a task's
        around = around.withColumn("block", F.pmod(F.xxhash64("t", "c"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        around = around.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).drop("blocks", "with")
        more = saved(around.groupBy("v", "i", "j").applyInArrow(crossing, "t long, u long, a long, b long"))
        found = found.unionByName(more)
        linked = components(ends(more).union(linked.select("id", "component")))
    released(df.sparkSession)
    spans = spans_by_text(found)
    whole = texts.select("t", "rep").join(linked, texts["t"] == linked["id"], "left").select("t", "rep", F.coalesce("component", "t").alias("component"))
    least_key = saved(whole.where("rep is not null").groupBy("component").agg(F.min("rep").alias("component_id")))
    whole = whole.join(least_key, "component", "left").select("t", "component_id")

    def finish(batches):
        for batch in batches:
            rows = []
            for z, copies, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                n = 0
                if copies > 1:
                    raw = np.frombuffer(grown(z), np.uint8)
                    n = len(W.words(raw, np.array([0, len(raw)]))[0])
                all_of_it = [(0, n - SHINGLE + 1)] if n >= words else [(s["a"], s["b"]) for s in spans or []]
                rows.append([{"first": a, "words": b + SHINGLE - 1 - a} for a, b in joined(all_of_it)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(rows, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))], ["digest", "component_id", "passages"])

    done = texts.join(spans, "t", "left").join(whole, "t", "left").select("digest", "z", "copies", "spans", "component_id").mapInArrow(finish, f"digest binary, component_id {kind}, passages array<struct<first: long, words: long>>")
    rows = df.select(F.col(key).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("digest")).join(done, "digest")
    # copies of a text that is too short for a passage have nothing to do with each other
    component = F.when(F.col("id").isNotNull(), F.when(F.size("passages") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")))
    size = F.aggregate("passages", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return rows.select(F.col("id").alias(key), F.size("passages").alias("n_passages"), size.alias("n_words"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "passages")


def query(spark, sf_dir):
    """op5: documents with the near-duplicate passages that others share: doc_id, n_passages, n_words, component_id, kept, passages."""
    return near_passages(texts(spark, sf_dir), "doc_id", "text")
