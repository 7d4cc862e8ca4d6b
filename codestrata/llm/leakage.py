"""Evaluation texts leaking into training text, found by spaced-seed hashing.

Fixed masks over the words of a text ignore some places: what they leave is hashed, at every place of every test item
and of every document. The hashes of both are joined. A hit carries the words around it on either side, so that
the join's rows alone tell whether the passage is one: they are compared on the hit's diagonal and its neighbours,
and what passes is aligned with substitutions, added and dropped words allowed, within a band. A document holds an
item if an alignment covers MIN_WORDS successive words.

The documents are read once, whatever the number of items. A Bloom filter of the items' hashes keeps back nearly all
other windows before the shuffle; equal windows of documents, as copies and boilerplate have them, are joined and
aligned once.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import Scratch, table

MIN_WORDS = 14
# 1: the word counts, 0: it is ignored. MIN_WORDS words with up to two words changed or added hold five equal words in a row, or four, a changed one and one more.
MASKS = ("11111", "111101")
SPAN = max(map(len, MASKS))
AROUND = 20  # words before and behind a seed that its window holds
LENGTH = AROUND + SPAN + AROUND
BAND = 8  # added less dropped words that an alignment may gather
EDITS = 3  # of which MIN_WORDS words may have so many; NEAR_WORDS agree then, at shifts of no more than EDITS
NEAR_WORDS = MIN_WORDS - EDITS
MISS, GAP = 3, 3
BITS_PER_SEED, PROBES = 24, 3
MAX_FILTER_BITS = 1 << 31  # 256 MB; with more than some 90 M seeds of items more windows pass it, and none is lost
PIECE = 2000  # texts or pairs of windows looked at at once

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrt])|(.))")
_PREFIX = re.compile(
    r"^[ \t]*(?:(?:[>|*#+;%~\-]|//|/\*|--|\d{1,4}[.):|](?=\s)|[-*] \[[ x]\]|\[?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\]?(?=\s)|\[?\d{4}-\d{2}-\d{2}[T ]?(?:\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?Z?)?\]?(?=\s)|"
    r"(?:info|warn|warning|debug|error|trace|fatal)\b:?)[ \t]*)+", re.M | re.I,
)
_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_HYPHEN = re.compile(r"(?<=[a-z])-\n[ \t]*(?=[a-z])")


def words(text: str) -> list[str]:
    """Lower-case words without markup, escapes and line prefixes."""
    t = text
    if "\\" in t:
        t = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " " if m[3] else m[4], t)
    if "<" in t:
        t = _TAG.sub("", t)
    if "&" in t:
        t = html.unescape(t)
        if "<" in t:
            t = _TAG.sub("", t)
    if "%20" in t:
        t = _PERCENT.sub(lambda m: chr(int(m[1], 16)), t)
    if "­" in t or "​" in t or "⁠" in t:
        t = re.sub("[­​⁠﻿]", "", t)
    t = _PREFIX.sub(" ", _HYPHEN.sub("", t))
    return _WORD.findall(t.lower())


def openings(items: DataFrame) -> DataFrame:
    """(item_id, text, opening): each distinct item with its first sentence if others begin with the same one, else NULL."""
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    first = items.withColumn("first", F.lower(F.regexp_extract("text", r"^\s*([^.!?:]*[.!?:])\s", 1)))
    shared = first.where("first <> ''").groupBy("first").agg(F.countDistinct("item_id").alias("n")).where("n > 1").select("first", F.lit(True).alias("is_shared"))
    return first.join(shared, "first", "left").select("item_id", "text", F.when(F.col("is_shared"), F.regexp_extract("text", r"^\s*([^.!?:]*[.!?:])\s", 1)).alias("opening"))


_R = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _hashes(tokens: list[str]) -> np.ndarray:
    codes, uniques = pd.factorize(np.array(tokens, dtype=object))
    return pd.util.hash_array(np.array(uniques, dtype=object)).astype(np.uint64)[codes] if len(tokens) else np.array([], dtype=np.uint64)


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k, c in enumerate(mask):
        if c == "1" and n > 0:
            out += h[k : k + n] * _R[k]
    return out ^ (out >> np.uint64(29))


def _places(seeds, bits: int) -> list:
    """Where in a filter of `bits` bits (a power of two) each seed stands; the same for columns and for arrays."""
    shifts = range(0, 8 * PROBES, 8)
    if isinstance(seeds, np.ndarray):
        return [(seeds >> np.uint64(k)) & np.uint64(bits - 1) for k in shifts]
    return [F.shiftrightunsigned(seeds, k).bitwiseAND(F.lit(bits - 1)) for k in shifts]


def seed_filter(spark: SparkSession, seeds: DataFrame):
    """A broadcast bitmap of the column `seed`, of a size that the seeds' number decides, up to MAX_FILTER_BITS."""
    bits = 1 << 15
    want = seeds.count() * BITS_PER_SEED
    while bits < min(want, MAX_FILTER_BITS):
        bits *= 2
    at = seeds.select(F.explode(F.array(*_places(F.col("seed"), bits))).alias("at")).select((F.col("at") + 1).alias("at"))  # bitmaps count from 1
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for bucket, bitmap in parts.toLocalIterator():  # 4 kB each, the filter in all
        start = (bucket - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bytes(bitmap), dtype=np.uint8)
    return spark.sparkContext.broadcast(out)


def _windows(texts: list[list[str]], fill: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, seed, and words around it, of each seed of the texts that the filter lets through; `fill` stands beyond a text's ends."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    h = _hashes([x for w in texts for x in w])
    text = np.repeat(np.arange(len(texts)), sizes)
    first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    of, seeds, at = [], [], []
    for mask in MASKS:
        s = _seeds(h, mask)
        p = np.arange(len(s))
        ok = p + len(mask) <= last[text[p]] if len(p) else np.array([], dtype=bool)
        if bitmap is not None and len(p):
            for place in _places(s, 8 * len(bitmap)):
                ok &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        p = p[ok]
        of.append(text[p])
        seeds.append(s[p].view(np.int64))
        at.append(p)
    of, seeds, at = np.concatenate(of), np.concatenate(seeds), np.concatenate(at)
    places = at[:, None] + np.arange(-AROUND, LENGTH - AROUND)
    inside = (places >= first[of][:, None]) & (places < last[of][:, None])
    names = (h & np.uint64(0x7FFFFFFF)).astype(np.int32)
    around = np.where(inside, names[np.clip(places, 0, max(len(h) - 1, 0))], np.int32(fill)) if len(of) else np.zeros((0, LENGTH), dtype=np.int32)
    return of, seeds, around


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether NEAR_WORDS of some MIN_WORDS words of the item's window agree with the document's, on the hit's own diagonal or the next ones."""
    agree = a == b
    for e in range(1, EDITS + 1):
        agree[:, :-e] |= a[:, :-e] == b[:, e:]
        agree[:, e:] |= a[:, e:] == b[:, :-e]
    total = np.concatenate([np.zeros((len(a), 1), dtype=np.int16), agree.cumsum(axis=1, dtype=np.int16)], axis=1)
    return (total[:, MIN_WORDS:] - total[:, :-MIN_WORDS]).max(axis=1) >= NEAR_WORDS


def covered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most successive words of each item window (a row of `a`) that an alignment with the document window (of `b`) covers, about the diagonal.

    The best-scoring local alignment is taken; its ends are equal words, and a word changed or dropped within counts
    as covered. A word changed or added near an end costs such an alignment more than the words beyond it gain, so
    that the ends are then grown over one edit each, as long as there are two edits in all: with three, most sentences of one
    pattern would pass. All rows are aligned side by side.
    """
    n, length = a.shape
    width = 2 * BAND + 1
    above = np.zeros((3, n, width + 2), dtype=np.int16)  # score, first item word and its place in b, by diagonal
    best = np.zeros((5, n), dtype=np.int16)  # score, words, place of the first in b, last item word, its place in b
    rows = np.arange(n)
    for i in range(length):
        lo, hi = max(0, BAND - i), min(width, length + BAND - i)
        j = np.arange(i + lo - BAND, i + hi - BAND, dtype=np.int16)
        equal = b[:, j] == a[:, i : i + 1]
        score, start, place = (x[:, lo + 1 : hi + 1].copy() for x in above)
        fresh = equal & (score <= 0)
        start[fresh], place = i, np.where(fresh, j, place)
        score = np.where(equal, score + 1, score - MISS).astype(np.int16)
        up = above[0][:, lo + 2 : hi + 2] - GAP
        take = ~equal & (up > score)
        score, start, place = (np.where(take, y, x) for x, y in zip((score, start, place), (up, above[1][:, lo + 2 : hi + 2], above[2][:, lo + 2 : hi + 2]), strict=True))
        for k in range(1, hi - lo):
            left = score[:, k - 1] - GAP
            take = ~equal[:, k] & (left > score[:, k])
            if take.any():
                score[take, k], start[take, k], place[take, k] = left[take], start[take, k - 1], place[take, k - 1]
        np.maximum(score, 0, out=score)
        above = np.zeros_like(above)
        above[0][:, lo + 1 : hi + 1], above[1][:, lo + 1 : hi + 1], above[2][:, lo + 1 : hi + 1] = score, start, place
        key = np.where(equal, score.astype(np.int32) * 1024 + (i - start), -1)
        k = key.argmax(axis=1)
        more = key[rows, k] > best[0].astype(np.int32) * 1024 + best[1] - 1
        r, k = rows[more], k[more]
        best[:, more] = np.stack([score[r, k], i - start[r, k] + 1, place[r, k], np.full(len(r), i), j[k]])
    out = best[1].copy()
    for r in np.flatnonzero((out > 0) & (out < MIN_WORDS)):
        score, words_, place, i, j = map(int, best[:, r])
        start = i - words_ + 1
        grown = [_grown(a[r, :start][::-1].tolist(), b[r, max(place - start - 1, 0) : place][::-1].tolist()), _grown(a[r, i + 1 :].tolist(), b[r, j + 1 :].tolist())]
        within = -(-(words_ - score) // (MISS + 1))  # edits of the alignment, at least
        out[r] += sum(sorted(grown)[within:])
    return out


def _grown(a: list[int], b: list[int]) -> int:
    """The words at the start of `a` that the start of `b` goes on with after one word changed or added."""
    most = 0
    for i in (0, 1):
        j = 1
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
            most = max(most, i)
    return most


def same_passage(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of windows, of an item and of a document, holds MIN_WORDS successive words of the item."""
    out = np.zeros(len(a), dtype=bool)
    near = np.flatnonzero(_near(a, b)) if len(a) else []
    if len(near):
        equal = np.concatenate([np.zeros((len(near), 1), dtype=np.int16), (a[near] == b[near]).cumsum(axis=1, dtype=np.int16)], axis=1)
        run = ((equal[:, MIN_WORDS:] - equal[:, :-MIN_WORDS]) == MIN_WORDS).any(axis=1)
        out[near[run]] = True
        rest = near[~run]
        out[rest] = covered(a[rest], b[rest]) >= MIN_WORDS
    return out


_SHAPE = "seed long, around binary"


def _packed(around: np.ndarray) -> pd.Series:
    return pd.Series([x.tobytes() for x in around], dtype=object)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, seed, around) of every place of the items (item_id, text, opening) under every mask, the opening left out."""

    def run(batches):
        for pdf in batches:
            texts = []
            for text, opening in zip(pdf["text"], pdf["opening"], strict=True):
                w = words(text)
                texts.append(w[len(words(opening)) :] if opening else w)
            of, seeds, around = _windows(texts, -1, None)
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[of], "seed": seeds, "around": _packed(around)})

    return items.select("item_id", "text", "opening").mapInPandas(run, f"item_id long, {_SHAPE}")


def document_seeds(docs: DataFrame, bitmap) -> DataFrame:
    """(doc_id, seed, around) of the places of documents (doc_id, text) that the broadcast filter lets through."""

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), PIECE):
                part = pdf.iloc[k : k + PIECE]
                of, seeds, around = _windows([words(t) for t in part["text"]], -2, bitmap.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[of], "seed": seeds, "around": _packed(around)})

    return docs.mapInPandas(run, f"doc_id long, {_SHAPE}")


def _verified(hits: DataFrame) -> DataFrame:
    """(window, item_id) of the joined hits (window, item_id, item_words, doc_words) whose words make a passage."""

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), PIECE):
                part = pdf.iloc[k : k + PIECE]
                ok = same_passage(*(np.frombuffer(b"".join(part[c]), dtype=np.int32).reshape(-1, LENGTH) for c in ("item_words", "doc_words")))
                yield part.loc[ok, ["window", "item_id"]]

    return hits.select("window", "item_id", "item_words", "doc_words").mapInPandas(run, "window long, item_id long")


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document that holds MIN_WORDS successive words of an item, its shared opening left out.

    docs: doc_id, text; items: item_id, text; other columns are ignored. NULL and blank texts hold nothing; items
    of fewer words, or none beyond their opening, are never found. Repeated rows give one row, copies of a text
    under other ids one each. Documents are taken whole and read once. A seed that very many windows and items share is one
    key of the join; AQE splits it, and no group of hits is ever gathered.
    """
    scratch = Scratch(spark, "leaks")
    of_items = scratch.write(item_seeds(openings(items)), "items")
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    hits = document_seeds(docs, seed_filter(spark, of_items)).withColumn("window", F.xxhash64("seed", "around"))
    hits = scratch.write(hits, "hits")
    windows = hits.select("window", "seed", F.col("around").alias("doc_words")).distinct()
    same = windows.join(of_items.withColumnRenamed("around", "item_words"), "seed")
    found = _verified(same).distinct()
    return hits.select("doc_id", "window").distinct().join(found, "window").select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite and item that leaked: how many documents hold it."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct()
    return p9_found(spark, sf_dir).join(items, "item_id").groupBy("suite", "item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict = {}
