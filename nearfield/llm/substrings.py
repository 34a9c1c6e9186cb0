"""Exact repeated substrings: front-coded runs of sorted suffixes, exchanged and merged by loser trees that keep common prefixes."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import grown, saved, shrunk, slices, string_buffers, texts

LENGTH, GRAM = 400, 64
#: Bytes of text looked at in one go, of suffixes sorted into one run, and of runs merged by one task on average.
CHUNK, RUN, MERGE = 1 << 19, 32 << 20, 24 << 20
#: Suffixes whose anchor occurs more often than this are judged window by window, by counts, and not gathered.
HOT = 20_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(W._BASE), -1, 1 << 64))
    p, q = np.cumprod(np.full(n + 1, W._BASE)), np.cumprod(np.full(n + 1, inverse))
    return p, q


def rolling(data: np.ndarray, width: int, powers) -> np.ndarray:
    """A hash of each ``width`` bytes, by prefix sums of a polynomial."""
    p, q = powers
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return W.mix((sums[width:] - sums[:-width]) * q[: len(data) - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(x) - width + 1
    filled = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max)
    filled[: len(x)] = x
    blocks = filled.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, anchor's hash, anchor, first, last) arrays: for each run of windows of ``length`` bytes with one anchor its text's number and places in the text.

    A window's anchor is its gram with the least hash, the first of equals: a matter of its bytes alone. So
    two equal windows have equal anchors at the same place, and only windows around a repeated gram can repeat.
    """
    out = []
    powers = _powers(min(CHUNK, len(data)) + length)
    low = 0
    starts_of = offsets[:-1]
    while low + length <= len(data):
        high = min(len(data), low + CHUNK + length - 1)
        b = data[low:high]
        h = rolling(b, gram, powers)
        packed = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
        best = sliding_min(packed, length - gram + 1)
        at = (best & np.uint64((1 << 22) - 1)).astype(np.int64)
        p = np.arange(low, low + len(at))
        of = np.searchsorted(offsets, p, "right") - 1
        of = np.minimum(of, len(starts_of) - 1)
        whole = p + length <= offsets[of + 1]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(at)) - 1
        ok = whole[first]
        first, last = first[ok], last[ok]
        text = of[first]
        base = offsets[text]
        out.append((text, h[at[first]], at[first] + low - base, first + low - base, last + low - base))
        low = high - length + 1
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.uint64 if i == 1 else np.int64) for i in range(5))


# --- front-coded runs ----------------------------------------------------------------------------------
def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of a and b, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + (m - (d.bit_length() + 7) // 8 if d else m)
        known += len(x)
    return n


_ENTRY = "<HHHH"  # common prefix, rest, back, references
_REF = "<16sq"  # text, anchor


def write_run(entries: list[tuple[bytes, bytes, list]]) -> bytes:
    """Sorted (suffix, back, references) as one run: each suffix without the prefix that it shares with the one before."""
    out, before = [], b""
    for suffix, back, refs in entries:
        for low in range(0, len(refs), 60_000):
            some = refs[low : low + 60_000]
            shared = common_prefix(before, suffix)
            out.append(struct.pack(_ENTRY, shared, len(suffix) - shared, len(back), len(some)) + suffix[shared:] + back + b"".join(struct.pack(_REF, *r) for r in some))
            before = suffix
    return shrunk(b"".join(out))


def read_run(run: bytes):
    """(common prefix with the one before, suffix, back, references) of a run."""
    data, at, before = grown(run), 0, b""
    while at < len(data):
        shared, rest, n_back, n_refs = struct.unpack_from(_ENTRY, data, at)
        at += 8
        before = before[:shared] + data[at : at + rest]
        at += rest
        back = data[at : at + n_back]
        at += n_back
        refs = [struct.unpack_from(_REF, data, at + 24 * i) for i in range(n_refs)]
        at += 24 * n_refs
        yield shared, before, back, refs


def merge_runs(runs: list):
    """(common prefix with the one before, suffix, back, references) over all runs in order, by a loser tree.

    A player carries its common prefix with the last winner. Of two players the one with the longer such prefix is
    smaller, and they differ right after the shorter; only with equal prefixes are bytes compared, from there on.
    A run's own front coding gives the prefix of its next entry, so no known prefix is compared again.
    """
    n = len(runs)
    size = 1 << max(0, (n - 1).bit_length())
    sources = [iter(r) for r in runs] + [iter(())] * (size - n)

    def draw(k):
        e = next(sources[k], None)
        return None if e is None else [e[0], e[1], e[2], e[3], k]

    def play(x, y):
        """(winner, loser); the loser's prefix becomes the one that it shares with the winner."""
        if x is None or y is None:
            return (y, x) if x is None else (x, y)
        if x[0] != y[0]:
            return (x, y) if x[0] > y[0] else (y, x)
        a, b, known = x[1], y[1], x[0]
        shared = common_prefix(a, b, known)
        if a[shared : shared + 1] <= b[shared : shared + 1]:
            y[0] = shared
            return x, y
        x[0] = shared
        return y, x

    losers: list = [None] * size
    level = [draw(k) for k in range(size)]
    for e in level:
        if e is not None:
            e[0] = 0
    width = size
    while width > 1:
        above = []
        for i in range(0, width, 2):
            win, lose = play(level[i], level[i + 1])
            losers[(width + i) // 2] = lose
            above.append(win)
        level, width = above, width // 2
    top = level[0]
    while top is not None:
        yield top[0], top[1], top[2], top[3]
        k = top[4]
        top = draw(k)
        node = (size + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated(group: list[tuple[bytes, bytes, list]], length: int) -> list[tuple[bytes, int, int]]:
    """(text, first, end) of the bytes under repeated windows, of the suffixes of one anchor. A suffix's text is back + suffix; windows start in back or at the anchor."""
    out = []
    if len(group) == 1 and len(group[0][2]) == 1:
        return out
    texts = [back + suffix for suffix, back, _ in group]
    depth = max(len(back) for _, back, _ in group)
    powers = _powers(max(map(len, texts)))
    hashes, places, owner = [], [], []
    for i, (t, (_, back, _)) in enumerate(zip(texts, group, strict=True)):
        h = rolling(np.frombuffer(t, np.uint8), length, powers)
        hashes.append(h)
        places.append(np.arange(len(h)) - len(back) + depth)
        owner.append(np.full(len(h), i))
    h, place, own = np.concatenate(hashes), np.concatenate(places), np.concatenate(owner)
    many = np.array([len(refs) for _, _, refs in group])
    order = np.lexsort((h, place))
    hs, ps = h[order], place[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (ps[1:] != ps[:-1]))
    number = np.cumsum(new) - 1
    counts = np.bincount(number, many[own[order]])
    double = np.zeros(len(h), bool)
    double[order] = counts[number] > 1
    ends = np.cumsum([len(x) for x in hashes])
    # equal hashes aren't equal bytes yet: windows side by side whose first of equal hash is in one other text are compared with it in one go
    like = np.empty(len(h), np.int64)
    like[order] = own[order[np.flatnonzero(new)[number]]]
    edges = np.append(np.flatnonzero((np.diff(like, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0)), len(h))
    unlike = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        i, k = int(own[a]), int(like[a])
        if i != k:
            base = int(ends[i]) - len(hashes[i])
            shift = len(group[k][1]) - len(group[i][1])
            p, q = a - base, b - base
            if texts[i][p : q - 1 + length] != texts[k][p + shift : q - 1 + shift + length]:
                unlike += [base + w for w in range(p, q) if texts[i][w : w + length] != texts[k][w + shift : w + shift + length]]
    if unlike:
        begin = np.append(np.flatnonzero(new), len(h))
        found = np.empty(len(h), np.int64)
        found[order] = number
        for n in np.unique(found[unlike]).tolist():
            same: dict[bytes, list[int]] = {}
            for w in order[begin[n] : begin[n + 1]].tolist():
                at = w - int(ends[own[w]]) + len(hashes[own[w]])
                same.setdefault(texts[own[w]][at : at + length], []).append(w)
            for members in same.values():
                double[members] = many[own[members]].sum() > 1
    for i, (_, back, refs) in enumerate(group):
        hit = np.flatnonzero(double[ends[i] - len(hashes[i]) : ends[i]])
        if len(hit):
            cut = np.flatnonzero(np.diff(hit) > length)
            for a, b in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True):
                out += [(ref, at - len(back) + a, at - len(back) + b + length) for ref, at in refs]
    return out


def places(raw: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text, anchor's hash, anchor) arrays: each anchor of the texts once, with its text's number and its place there.

    A window has one anchor wherever the bytes are cut into chunks, but a run of windows is cut with them: so anchors, and
    not runs, say what is chosen.
    """
    text, h, anchor, _, _ = anchors(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), length, gram)
    new = (np.diff(text, prepend=-1) != 0) | (np.diff(anchor, prepend=-1) != 0)
    return text[new], h[new], anchor[new]


def suffixes(raw: bytes, chosen: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor's hash, anchor, first, last) arrays: a text's runs of windows whose anchors are at the chosen places."""
    _, h, anchor, first, last = anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), length, gram)
    pick = np.isin(anchor, chosen)
    return h[pick], anchor[pick], first[pick], last[pick]


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(digest, first, end): bytes of distinct texts(digest, z, n_bytes) under windows that start elsewhere too. Parts overlap."""
    import pyarrow as pa

    def unpack(batch, i):
        return [grown(z) for z in batch.column(i).to_pylist()]

    def find(batches):
        for whole in batches:
            for batch in slices(whole, 2, 4 << 20):
                text, h, anchor = places(unpack(batch, 1), length, gram)
                if len(text):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(h.view(np.int64)), pa.array(anchor)], ["digest", "h", "anchor"])

    found = saved(texts.select("digest", "z", "n_bytes").mapInArrow(find, "digest binary, h long, anchor long"))
    # counted in advance: a join whose both sides are exchanges can split an anchor that many texts have
    often = saved(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    wanted = found.join(often, "h").groupBy("digest").agg(F.sort_array(F.collect_list(F.when(F.col("c") <= HOT, F.col("anchor")))).alias("some"), F.sort_array(F.collect_list(F.when(F.col("c") > HOT, F.col("anchor")))).alias("hot"))
    held = saved(wanted)
    n_wanted = held.agg(F.sum(F.size("some"))).first()[0] or 0
    parts = max(64, n_wanted * 3 * length // 2 // MERGE)
    rows = texts.select("digest", "z").join(held, "digest")

    def sort(batches):
        def runs(entries):
            by_part: dict[int, list] = {}
            for (suffix, back), refs in sorted(entries.items()):
                by_part.setdefault(int.from_bytes(suffix[:8], "big") % parts, []).append((suffix, back, refs))
            yield pa.RecordBatch.from_arrays([pa.array(list(by_part), pa.int64()), pa.array([write_run(e) for e in by_part.values()], pa.binary())], ["part", "run"])

        entries, size = {}, 0
        for batch in batches:
            for digest, z, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                chosen = some.values.to_numpy()
                if not len(chosen):
                    continue
                raw = grown(z)
                for h, a, p, q in zip(*(x.tolist() for x in suffixes(raw, chosen, length, gram)), strict=True):
                    key = (h.to_bytes(8, "big") + raw[a : q + length], raw[p:a])
                    refs = entries.get(key)
                    if refs is None:
                        refs = entries[key] = []
                        size += len(key[0]) + len(key[1]) + 200
                    refs.append((digest, a))
                    size += 100
                    if size > RUN:
                        yield from runs(entries)
                        entries, size = {}, 0
        if entries:
            yield from runs(entries)

    sorted_runs = rows.where("size(some) > 0").select("digest", "z", "some").mapInArrow(sort, "part long, run binary")

    def merge(table):
        out = []
        group, name, reach = [], None, []

        def close():
            # an entry's windows can only match those of another if the suffixes share what a window has after the anchor
            deepest = max((len(back) for _, back, _ in group), default=0)
            keep = [g for i, g in enumerate(group) if len(g[2]) > 1 or max(reach[i], reach[i + 1] if i + 1 < len(group) else 0) - 8 >= length - deepest]
            return repeated([(s[8:], b, r) for s, b, r in keep], length) if keep else []

        for shared, suffix, back, refs in merge_runs([read_run(r) for r in table.column("run").to_pylist()]):
            if suffix[:8] != name:
                if group:
                    out += close()
                group, name, reach = [], suffix[:8], []
                shared = 0
            if group and group[-1][0] == suffix and group[-1][1] == back:
                group[-1][2].extend(refs)
            else:
                group.append((suffix, back, list(refs)))
                reach.append(shared)
        if group:
            out += close()
        return pa.table({"digest": pa.array([o[0] for o in out], pa.binary()), "first": pa.array([o[1] for o in out], pa.int64()), "end": pa.array([o[2] for o in out], pa.int64())})

    merged = sorted_runs.groupBy("part").applyInArrow(merge, "digest binary, first long, end long")

    def windows(batches):
        for batch in batches:
            for digest, z, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = grown(z)
                for _, _, p, q in zip(*(x.tolist() for x in suffixes(raw, some.values.to_numpy(), length, gram)), strict=True):
                    names = [hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in range(p, q + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(names), pa.binary()), pa.array(names, pa.binary()), pa.array(range(p, q + 1), pa.int64())], ["digest", "name", "first"])

    single = rows.where("size(hot) > 0").select("digest", "z", "hot").mapInArrow(windows, "digest binary, name binary, first long")
    twice = single.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name")
    counted = single.join(twice, "name", "left_semi").select("digest", "first", (F.col("first") + length).alias("end"))
    return merged.unionByName(counted)


def remove_repeats(df: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of df.

    A byte is removed if a string of ``length`` bytes over it also starts anywhere else in the rows, as the input
    has them; matches don't cross rows. n_spans counts maximal removed parts; kept has the rest, in which
    a character may be cut. Null texts count as empty. Equal texts have equal results, so each distinct text is
    worked on once; of a text that occurs twice all is removed, if it has length bytes. Keys may be null or
    repeat; other columns are left out. An empty table gives no rows.
    """
    import pyarrow as pa

    def pack(batches):
        for whole in batches:
            for some in slices(whole, 0):
                data, at = string_buffers(some.column(0))
                raw = [data[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array([shrunk(r) for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64())], ["digest", "z", "n_bytes"])

    packed = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(pack, "digest binary, z binary, n_bytes long")
    texts = saved(packed.groupBy("digest").agg(F.first("z").alias("z"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies")))
    long = texts.where(F.col("n_bytes") >= length)
    spans = repeats(long, length, gram).groupBy("digest").agg(F.collect_set(F.struct("first", "end")).alias("spans"))

    def cut(batches):
        for batch in batches:
            rows = []
            for z, n, copies, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                gone = [(0, n)] if copies > 1 and n >= length else sorted((s["first"], s["end"]) for s in spans or [])
                joined: list[list[int]] = []
                for a, b in gone:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                raw = grown(z)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(j[1] for j in joined)], [*(j[0] for j in joined), n], strict=True))
                rows.append((n - len(kept), len(joined), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_bytes
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["digest", "n_bytes", *names])

    names = ["n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    done = texts.join(spans, "digest", "left").select("digest", "z", "n_bytes", "copies", "spans").mapInArrow(cut, "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
    rows = df.select(F.col(key).alias("__key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("digest"))
    return rows.join(done, "digest").select(F.col("__key").alias(key), "n_bytes", *names)


def query(spark, sf_dir):
    """op10: documents' bytes under repeated strings of 400 bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(texts(spark, sf_dir), "doc_id", "text")
