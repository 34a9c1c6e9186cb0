"""Best-fit packing of tokenized documents into sequences of bounded length, in rounds over range-sorted pieces and gaps."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_worker, saved, slices, texts

CAPACITY, ROWS_EACH, ROUNDS = 2048, 20_000, 500
#: Fixed value: the pattern that splits a text before the merges, in its public form without backtracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, added: bool = False):
    """text -> ids of the byte-level BPE in a tokenizers file; the file's added tokens as ordinary text or, with ``added``, as their own ids.

    The latter is what the tokenizers library does by default, with or without add_special_tokens.

    Vocabulary and merges are read from the file. Merges of such a file are in order of rank, so
    its vocabulary without special tokens is a rank table, from which tiktoken gives the same ids in a
    fifth of the time; the tests hold them against the tokenizers library.
    """
    import json

    import tiktoken
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    if held["normalizer"] or held["pre_tokenizer"]["type"] != "ByteLevel" or held["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level BPE")
    # the library's own letters for the 256 bytes: printable ones stand for themselves, the others follow from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    assert set(letters) == set(pre_tokenizers.ByteLevel.alphabet())
    special = {t["content"] for t in held["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in special}
    if not added:
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if any(t[how] for t in held["added_tokens"] for how in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in or look at what is beside them")
    own = {t["content"]: t["id"] for t in held["added_tokens"]}
    encode = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=own).encode
    return lambda text: encode(text, allowed_special="all")


def pieces(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): each row's tokens and a closing 0, cut if longer than capacity.

    All pieces of a document but the first are capacity long. Texts are tokenized whole, null as
    empty (one piece with the 0 alone); an added token that a text spells out has its own id. The file at path must be on every machine.
    """
    import pyarrow as pa

    path = path or tokenizer_path()
    names = ["__key", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def run(batches):
        encode = on_worker(("encoder", path, "added"), lambda: encoder(path, added=True))
        for batch in batches:
            for some in slices(batch, 1):
                of, out = [], []
                for k, value in enumerate(some.column(1).to_pylist()):
                    tokens = np.array([*encode(value or ""), 0], "<u4")
                    first = (len(tokens) - 1) % capacity + 1
                    cuts = [0, *range(first, len(tokens) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                        of.append(k)
                        out.append((p, a, b - a, zlib.crc32(tokens[a:b].tobytes()), tokens[a:b].astype(np.int32) if ids else None))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of, pa.int64())), *[pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, f"__key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def best_fit_runs(counts: dict[int, int], gaps: list[tuple[int, int, int]], capacity: int = CAPACITY):
    """Best fit over sorted runs: (plan, left, gaps).

    Pieces of one length are a run of the sorted pieces, and gaps(size, first sequence, many) are runs of the sorted gaps. The
    longest run is swept to its successors, the smallest gaps that hold its length; ranks decide which piece gets which
    gap. A gap takes as many of the run's pieces as it holds, the next gap comes after; what remains of gaps goes back
    into order, and the next run follows. plan has runs (first rank, first sequence, offset, a gap's places) for each length, left
    the number of pieces of each length that no gap holds.
    """
    held: dict[int, deque] = defaultdict(deque)
    held_at, plan, missing = 0, {}, {}  # held_at has a bit for each size with a gap

    def put(gap: int, first: int, many: int) -> None:
        nonlocal held_at
        if gap and many:
            held[gap].append((first, many))
            held_at |= 1 << gap

    for gap in sorted(gaps):
        put(*gap)
    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError("a piece must have 1 to capacity tokens")
        rank, left, runs = 0, counts[length], []
        while left:
            fits = held_at >> length
            if not fits:
                missing[length] = left
                break
            gap = length + (fits & -fits).bit_length() - 1
            first, many = held[gap].popleft()
            holds = gap // length
            filled = min(many, left // holds)
            rest = min(left - filled * holds, holds) if filled < many else 0
            runs.append((rank, first, capacity - gap, holds))
            used = filled + bool(rest)
            if used < many:
                held[gap].appendleft((first + used, many - used))
            if not held[gap]:
                held_at &= ~(1 << gap)
            put(gap - holds * length, first, filled)
            if rest:
                put(gap - rest * length, first + filled, 1)
            taken = filled * holds + rest
            rank, left = rank + taken, left - taken
        plan[length] = np.array(runs, np.int64).reshape(-1, 4)
    return plan, missing, [(gap, *run) for gap, runs in held.items() for run in runs]


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str | None = None, ids: bool = False, rows_each: int = ROWS_EACH) -> DataFrame:
    """pieces() with ``sequence_id`` and ``offset``, its place there; sequences are gapless from 0.

    In rounds, until all pieces are placed:

    1. A piece's successor is the smallest size of any gap that holds it; the sizes, at most capacity, are known from a count. Pieces without
       one go to new sequences, as many as their tokens need at least.
    2. Pieces and gaps are sorted by ranges of (successor's size, salt). A size with more than rows_each pieces has several salts, so
       no task gets more than about that many, however many pieces have one length.
    3. Within a size and salt pieces are ranked, the longest first, and swept over the gaps by best fit (best_fit_runs()); where more pieces want
       gaps than they hold, the first ranks get them, and the others look for their next successor in the next round.
    4. What remains of gaps is sorted again by its new size.

    The first round places nearly all; the few pieces that a salt's last gaps don't hold meet the gaps of all salts in those that follow.
    Gaps of equal size and neighbouring sequences travel as one row. Each round's result is a checkpoint. Equal rows are pieces of their own; null keys
    stay; other columns are left out. An empty table gives no rows.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    columns = ["__key", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    cut = saved(pieces(df, key, text, capacity, path, ids))
    spark = df.sparkSession
    whole = cut.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in (("sequence_id", "long"), ("offset", "long"), ("size", "int"), ("many", "long"))])
    names = whole.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)

    def fit(table):
        kind = table.column("kind").to_numpy()
        target, salt, turn = (table.column(c)[0].as_py() for c in ("target", "salt", "turn"))
        mine = table.filter(pa.array(kind == 1)).select(names)
        rest = table.filter(pa.array(kind == 2))
        gaps = list(zip(*(rest.column(c).to_pylist() for c in ("size", "sequence_id", "many")), strict=True))
        order = pc.sort_indices(mine, [("length", "descending"), *[(c, "ascending") for c in ("__key", "piece", "start", "ids_crc32")]])
        mine = mine.take(order)
        length = mine.column("length").to_numpy()
        if not target:  # new sequences, numbered apart from those of other rounds and salts
            gaps = [(capacity, turn << 54 | salt << 24, -(-int(length.sum()) // capacity))]
        sizes, counts = np.unique(length, return_counts=True)
        plan, missing, gaps = best_fit_runs(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), gaps, capacity)
        sequence, offset, placed = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), bool)
        starts = np.searchsorted(-length, -sizes)
        for size, many, at in zip(sizes.tolist(), counts.tolist(), starts.tolist(), strict=True):
            runs = plan[size]
            if not len(runs):
                continue
            rank = np.arange(many)
            r = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
            within = rank - r[:, 0]
            sequence[at : at + many], offset[at : at + many] = r[:, 1] + within // r[:, 3], r[:, 2] + within % r[:, 3] * size
            placed[at : at + many] = True
        # the last ranks of a length are those that no gap holds
        for size, many in missing.items():
            at = int(starts[np.searchsorted(sizes, size)] + counts[np.searchsorted(sizes, size)])
            placed[at - many : at] = False
        mine = mine.set_column(mine.schema.get_field_index("sequence_id"), "sequence_id", pa.array(sequence, mask=~placed))
        mine = mine.set_column(mine.schema.get_field_index("offset"), "offset", pa.array(offset, mask=~placed))
        mine = mine.append_column("kind", pa.array((~placed).astype(np.int8)))
        left = {c: pa.nulls(len(gaps), mine.schema.field(c).type) for c in mine.schema.names}
        left |= {"size": pa.array([g[0] for g in gaps], pa.int32()), "sequence_id": pa.array([g[1] for g in gaps], pa.int64()), "many": pa.array([g[2] for g in gaps], pa.int64()), "kind": pa.array(np.full(len(gaps), 2, np.int8))}
        return pa.concat_tables([mine, pa.table(left, schema=mine.schema)])

    todo, gaps, placed = whole, None, []
    for turn in range(ROUNDS):
        # at most a row for each length and each size
        lengths = {r["length"]: r["n"] for r in todo.groupBy("length").agg(F.count("*").alias("n")).collect()}
        if not lengths:
            break
        sizes, idle = {}, None
        if gaps is not None:
            gaps = gaps.where(F.col("size") >= min(lengths))
            sizes = {r["size"]: r["n"] for r in gaps.groupBy("size").agg(F.count("*").alias("n")).collect()}
        known = np.array(sorted(sizes), np.int64)
        wanted, targets = defaultdict(int), {}
        for length, n in lengths.items():
            at = int(np.searchsorted(known, length))
            targets[length] = int(known[at]) if at < len(known) else 0
            wanted[targets[length]] += n
        salts = {t: max(1, min(-(-n // rows_each), sizes.get(t, n))) for t, n in wanted.items()}
        of_length = spark.createDataFrame([(length, t, salts[t]) for length, t in targets.items()], "length long, target int, salts int")
        rows = todo.join(F.broadcast(of_length), "length").withColumn("salt", F.pmod(F.xxhash64("__key", "piece", "ids_crc32", F.lit(turn)), F.col("salts"))).withColumn("kind", F.lit(1).cast("byte"))
        rows = rows.select("kind", "target", "salt", *names)
        if sizes:
            of_size = spark.createDataFrame([(t, n) for t, n in salts.items() if t] or [(-1, 1)], "target int, salts int")
            here = gaps.join(F.broadcast(of_size), F.col("size") == F.col("target")).withColumn("salt", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.col("salts"))).withColumn("kind", F.lit(2).cast("byte"))
            rows = rows.unionByName(here.select("kind", "target", "salt", *names))
            idle = gaps.where(~F.col("size").isin([t for t in salts if t])) if any(salts) else gaps
        rows = rows.withColumn("turn", F.lit(turn)).repartitionByRange("target", "salt")
        out = saved(rows.groupBy("target", "salt").applyInArrow(fit, kinds + ", kind byte"))
        placed.append(out.where("kind = 0"))
        todo, left = out.where("kind = 1").drop("kind"), out.where("kind = 2").drop("kind")
        gaps = left if idle is None else left.unionByName(idle)
    else:
        raise RuntimeError("pack: pieces are left; raise ROUNDS")
    done = placed[0] if placed else whole
    for more in placed[1:]:
        done = done.unionByName(more)
    return done.select(F.col("__key").alias(key), *columns[1:], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences from pack(..., ids=True); a group has capacity tokens at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def query(spark, sf_dir):
    """op2: all documents' pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(texts(spark, sf_dir), "doc_id", "text")
