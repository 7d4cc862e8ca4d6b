"""Overlap of texts in runs of tokens, with little on disk: packed numbers of runs instead of rows, and a bitmap before each join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import Scratch

LOW = 24  # the bits of a run's number that choose its bucket; the other 40 are packed
FILTER_BITS = 1 << 29  # 64 MB; beyond that the bitmap only lets more runs through
BITS_PER_RUN = 16


def token_numbers(texts: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, tokens): the tokens of the lower-cased texts as numbers of 64 bits."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    return texts.where("text IS NOT NULL").select(F.col(key).cast("long").alias("key"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("tokens"))


def runs(tokens: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, run): the place of a text in its batch and the numbers of 64 bits of its runs of k tokens, sorted and distinct."""
    v = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    text = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    m = max(0, len(v) - k + 1)
    h = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        h = (h ^ v[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    one = text[:m] == text[k - 1 :][:m]
    text, h = text[:m][one], h[one]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def _plain(x: np.ndarray, width: int) -> bytes:
    """Little-endian numbers of `width` bytes, all first bytes, then all second ones, which compresses better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(parts: list[bytes], width: int) -> np.ndarray:
    out = []
    for b in parts:
        x = np.zeros((len(b) // width, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(b, dtype=np.uint8).reshape(width, -1).T
        out.append(x.reshape(-1).view("<u8"))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _pieces(to: np.ndarray, of: np.ndarray, key: np.ndarray, size: np.ndarray, columns: dict[str, tuple[np.ndarray, int]], names: tuple[str, ...], more: dict[str, int]) -> pa.RecordBatch:
    """One row for each number in `to`, with its elements packed; of: the place of an element's text in `key` and `size`; elements come by text."""
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, dtype=np.int64)
    rows: dict[str, list] = {n: [] for n in names}
    for a, b in zip(cuts, np.r_[cuts[1:], len(to)][: len(cuts)], strict=True):
        t, n = np.unique(of[a:b], return_counts=True)
        rows["at"].append(int(to[a]))
        rows["keys"].append(_plain(key[t], 8))
        rows["sizes"].append(_plain(size[t], 4))
        rows["counts"].append(_plain(n, 4))
        for c, (x, width) in columns.items():
            rows[c].append(_plain(x[order[a:b]], width))
        for c, x in more.items():
            rows[c].append(x)
    kinds = {"at": pa.int32(), "bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(rows[n], type=kinds.get(n, pa.binary())) for n in names], names=list(names))


def _elements(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, size) of packed rows; place: of each element's text in `key` and `size`."""
    col = lambda n: t.column(n).to_pylist()
    counts = _numbers(col("counts"), 4).astype(np.int64)
    return np.repeat(np.arange(len(counts)), counts), _numbers(col("keys"), 8).view(np.int64), _numbers(col("sizes"), 4).astype(np.int64)


def _needed(n: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(least * n - 1e-9).astype(np.int64)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mask = np.uint64(bits - 1)
    return (h >> np.uint64(34)) & mask, (h ^ (h >> np.uint64(31))) & mask


def _bitmap(spark, rows: DataFrame):
    """A broadcast bitmap of the column `run`."""
    bits = 1 << 15
    want = rows.count() * BITS_PER_RUN
    while bits < min(want, FILTER_BITS):
        bits *= 2

    def places(batches):
        for b in batches:
            x = np.unique(np.concatenate(_places(b.column("run").to_numpy(), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x + 1)], names=["at"])  # bitmaps count from 1

    parts = rows.select("run").mapInArrow(places, "at long").groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for bucket, bitmap in parts.toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bitmap), dtype=np.uint8)
    return spark.sparkContext.broadcast(out)


def text_pairs(scratch: Scratch, texts: DataFrame, key: str, k: int, pattern: str, least: float) -> DataFrame:
    """(a, b, shared, overlap): pairs a < b of texts (key, text) that share `least` of the smaller set of runs of k tokens or more, exactly. Keys are whole numbers.

    A run that no other text holds counts as a miss. Of n runs a smaller set may miss m = n - ceil(least * n), so that of its
    first 2m + 1 runs (or all n), from rare to common, all but m are in the larger. Every run is shuffled once, as 5 bytes and
    its text's share of a key, to find those of two texts or more and their number; these go back to their texts, packed too, and leave each
    text's first runs. A bitmap of them keeps all others of the second reading out of the join. Equal parts of 64 bits only
    let more pairs through; what is left is counted in full.
    """
    spark = scratch.spark
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbers = token_numbers(texts, key, pattern)
    packed = ("at", "keys", "sizes", "counts", "runs")

    def pack(batches):
        for b in batches:
            of, h = runs(b.column("tokens"), k)
            size = np.bincount(of, minlength=b.num_rows)
            to = ((h & np.uint64((1 << LOW) - 1)) % np.uint64(buckets)).astype(np.int64)
            yield _pieces(to, of, b.column("key").to_numpy(), size, {"runs": (h >> np.uint64(LOW), 5)}, packed, {})

    def common(t: pa.Table) -> pa.Table:
        bucket = t.column("at")[0].as_py()
        of, key_, size = _elements(t)
        h = _numbers(t.column("runs").to_pylist(), 5)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        n = np.diff(np.r_[first, len(s)])
        df = np.empty(len(h), dtype=np.int64)
        df[order] = np.repeat(n, n)
        two = df > 1
        to = (key_[of[two]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
        return pa.Table.from_batches([_pieces(to, of[two], key_, size, {"runs": (h[two], 5), "df": (np.minimum(df[two], 65535), 2)}, (*packed, "df", "bucket"), {"bucket": bucket})])

    def first(t: pa.Table) -> pa.Table:
        per = np.array([len(x) // 5 for x in t.column("runs").to_pylist()])
        run = (_numbers(t.column("runs").to_pylist(), 5).view(np.int64) << 23) | np.repeat(t.column("bucket").to_numpy(), per).astype(np.int64)
        df = _numbers(t.column("df").to_pylist(), 2)
        of, key_, size = _elements(t)
        keys, text = np.unique(key_, return_inverse=True)
        n = np.zeros(len(keys), dtype=np.int64)
        n[text] = size
        text = text[of]
        order = np.lexsort((run, df, text))
        text, run = text[order], run[order]
        held = np.bincount(text, minlength=len(keys))
        alone = (n - held)[text]
        pos = np.arange(len(text)) - (np.cumsum(held) - held)[text] + alone + 1
        miss = n - _needed(n, least)
        keep = (held >= n - miss)[text] & (pos <= 2 * miss[text] + 1)
        return pa.table({"small": keys[text[keep]], "n_small": n[text[keep]], "run": run[keep]})

    shape = "at int, keys binary, sizes binary, counts binary, runs binary"
    shared = numbers.mapInArrow(pack, shape).groupBy("at").applyInArrow(common, f"{shape}, df binary, bucket int")
    prefix = scratch.write(shared.groupBy("at").applyInArrow(first, "small long, n_small long, run long"), "prefix")
    scratch.let_go()
    bitmap = _bitmap(spark, prefix)

    def held(batches):
        bits = bitmap.value
        for b in batches:
            of, h = runs(b.column("tokens"), k)
            run = ((h >> np.uint64(LOW)).view(np.int64) << 23) | ((h & np.uint64((1 << LOW) - 1)) % np.uint64(buckets)).view(np.int64)
            hit = np.ones(len(run), dtype=bool)
            for p in _places(run, 8 * len(bits)):
                hit &= (bits[(p >> np.uint64(3)).view(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            size = np.bincount(of, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.column("key").to_numpy()[of[hit]], size[of[hit]], run[hit])], names=["large", "n_large", "run"])

    large = numbers.mapInArrow(held, "large long, n_large long, run long")
    hits = prefix.join(large, "run").where("n_large > n_small OR (n_large = n_small AND large <> small)").groupBy("small", "large", "n_small").agg(F.count("*").alias("hits"))
    miss = F.col("n_small") - F.ceil(F.lit(least) * F.col("n_small") - 1e-9)
    need = F.least(2 * miss + 1, "n_small") - miss
    near = scratch.write(hits.where(F.col("hits") >= need).select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b")).distinct(), "near")
    scratch.let_go()

    def sets(batches):
        for b in batches:
            of, h = runs(b.column("tokens"), k)
            ends = np.r_[0, np.cumsum(np.bincount(of, minlength=b.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["key", "runs"])

    ends = scratch.write(near.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "ends")
    whole = scratch.write(token_numbers(texts.join(ends, key, "left_semi"), key, pattern).mapInArrow(sets, "key long, runs array<long>"), "whole")
    side = lambda end: whole.select(F.col("key").alias(end), F.col("runs").alias(f"runs_{end}"))
    shared_n = F.size(F.array_intersect("runs_a", "runs_b")).cast("long")
    x = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", shared_n.alias("shared"), F.least(F.size("runs_a"), F.size("runs_b")).alias("n"))
    return x.select("a", "b", "shared", (F.col("shared") / F.col("n")).alias("overlap")).where(F.col("overlap") >= least - 1e-12)


BLOCK = 40_000  # sets held against each other at a time
COMMON = 512  # runs held as bits


def all_pairs(texts: DataFrame, key: str, group: str, k: int, pattern: str, least: float, block: int = BLOCK) -> DataFrame:
    """(symbol, other, overlap), in both directions: texts (key, group, text) that share `least` of the smaller set of runs of k tokens or more and differ in `group`, exactly.

    For short texts of one style, of which any two share something, so that no filter on single runs keeps the pairs few. Blocks
    of sets meet in cells. In a cell the runs that most sets hold are bits; all others are counted by lists of the sets that hold
    them, and the bits are compared only where count and bits may add up. What is shuffled is 8 bytes a run for each block of `block` texts.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    held = texts.where("text IS NOT NULL").select(F.col(key).alias("key"), F.xxhash64(group).alias("hash"), F.xxhash64(key).alias("draw"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("tokens"))
    blocks = max(1, -(-texts.count() // block))
    shape = "i int, j int, own int, keys array<string>, hashes binary, counts binary, runs binary"

    def pack(batches):
        for b in batches:
            of, h = runs(b.column("tokens"), k)
            size = np.bincount(of, minlength=b.num_rows)
            mine = (b.column("draw").to_numpy().view(np.uint64) % np.uint64(blocks)).astype(np.int64)
            hashes = b.column("hash").to_numpy()
            for own in range(blocks):
                at = np.flatnonzero((mine == own) & (size > 0))
                if not len(at):
                    continue
                row = {"own": own, "keys": b.column("key").take(pa.array(at)).to_pylist(), "hashes": _plain(hashes[at], 8), "counts": _plain(size[at], 4), "runs": h[(mine == own)[of]].tobytes()}
                yield pa.RecordBatch.from_pylist([{"i": min(own, o), "j": max(own, o)} | row for o in range(blocks)], schema=_CELL)

    def side(t: pa.Table, own: int):
        t = t.filter(pa.array(t.column("own").to_numpy() == own))
        keys = t.column("keys").combine_chunks().flatten()
        data = np.frombuffer(b"".join(t.column("runs").to_pylist()), dtype=np.uint64)
        return keys, _numbers(t.column("hashes").to_pylist(), 8), _numbers(t.column("counts").to_pylist(), 4).astype(np.int64), data

    def cell(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ka, ha, na, ra = side(t, i)
        kb, hb, nb, rb = (ka, ha, na, ra) if i == j else side(t, j)
        found = [x for x in _found(ha, na, ra, hb, nb, rb, i == j, least) if len(x[1])]
        a = np.concatenate([np.full(len(b), x) for x, b, _ in found]) if found else np.zeros(0, dtype=np.int64)
        b = np.concatenate([x for _, x, _ in found]) if found else np.zeros(0, dtype=np.int64)
        shared = np.concatenate([x for _, _, x in found]) if found else np.zeros(0)
        overlap = pa.array(shared / np.minimum(na[a], nb[b]))
        one, two = ka.take(pa.array(a)), kb.take(pa.array(b))
        return pa.concat_tables([pa.table([one, two, overlap], names=_PAIR), pa.table([two, one, overlap], names=_PAIR)])

    return held.mapInArrow(pack, shape).groupBy("i", "j").applyInArrow(cell, "symbol string, other string, overlap double")


_PAIR = ["symbol", "other", "overlap"]
_CELL = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("keys", pa.list_(pa.string())), ("hashes", pa.binary()), ("counts", pa.binary()), ("runs", pa.binary())])


def _found(ha, na, ra, hb, nb, rb, same: bool, least: float):
    """(a, others, shared) for each set of the first side with the sets of the second that overlap with it; if the sides are the same, with later ones only."""
    if not len(na) or not len(nb):
        return
    values, ids = np.unique(ra if same else np.r_[ra, rb], return_inverse=True)
    df = np.bincount(ids, minlength=len(values))
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(values))
    ids = rank[ids]
    ia, ib = ids[: len(ra)], ids if same else ids[len(ra) :]

    def bits(x, n):
        of = np.repeat(np.arange(len(n)), n)
        few = x < COMMON
        out = np.zeros((len(n), COMMON // 64), dtype=np.uint64)
        np.bitwise_or.at(out, (of[few], x[few] >> 6), np.uint64(1) << (x[few] & 63).astype(np.uint64))
        return out, np.bincount(of[few], minlength=len(n)).astype(np.int32), of[~few], x[~few] - COMMON

    bits_a, common_a, of_a, rare_a = bits(ia, na)
    bits_b, common_b, of_b, rare_b = bits(ib, nb)
    order = np.argsort(rare_b, kind="stable")
    holders = of_b[order]
    ends = np.r_[0, np.cumsum(np.bincount(rare_b, minlength=max(1, len(values) - COMMON)))]
    cut = np.r_[0, np.cumsum(np.bincount(of_a, minlength=len(na)))]
    need = _needed(np.arange(max(na.max(), nb.max()) + 1), least).astype(np.int32)
    need_b = need[nb]
    start, stop = ends[rare_a].tolist(), ends[rare_a + 1].tolist()
    empty = np.zeros(0, dtype=np.int64)
    for a in range(len(na)):
        lists = [holders[start[p] : stop[p]] for p in range(cut[a], cut[a + 1])]
        counts = np.bincount(np.concatenate(lists) if lists else empty, minlength=len(nb))
        wanted = np.minimum(need_b, need[na[a]])
        maybe = counts + np.minimum(common_b, common_a[a]) >= wanted
        if same:
            maybe[: a + 1] = False
        b = np.flatnonzero(maybe)
        shared = counts[b] + np.bitwise_count(bits_b[b] & bits_a[a]).sum(axis=1, dtype=np.int64)
        ok = (shared >= wanted[b]) & (shared > 0) & (hb[b] != ha[a])
        yield a, b[ok], shared[ok]
