"""Filling fixed-capacity containers with texts: online best-fit with a fixed number of open containers.

Texts are measured once in tokens of a public tokenizer. They are then dealt to lanes of LANE_TOKENS tokens or more
by a hash of their id, and each lane is packed as a stream: a text goes to the open container that it leaves
fullest; if it fits into none, the fullest open container is closed and a new one opened. The open containers are
found in a bitset keyed by free space. A text that alone exceeds the capacity fills containers of its own and only
its last part is packed with others.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import Scratch, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind part a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN = 64
LANE_TOKENS = 4_000_000


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of each row of documents (doc_id, text); NULL and empty texts have 0 tokens. Texts are measured whole."""

    def run(batches):
        enc = encoder(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, tokens long")


class Packer:
    """Open containers of one lane. `place` returns the container of the next item."""

    def __init__(self, capacity: int, open_bins: int = OPEN):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def _put(self, number: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(number)
        self.bits |= 1 << free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return number

    def place(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            number, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        self._put(number, free - size)
        return number

    def whole(self) -> int:
        """A container that one part fills; it is never open."""
        self.made += 1
        return self.made - 1


def pack(spark: SparkSession, docs: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER, open_bins: int = OPEN, lanes: int | None = None) -> DataFrame:
    """(budget_id, doc_id, part, container, tokens) for each budget (budget_id, capacity) and document (doc_id, text).

    `part` is 0 for a text in one piece, else counts from 1. `container` is unique within its budget. Empty and NULL
    texts take no room and are put into any container. Budgets with a NULL or non-positive capacity are left out, as
    are rows with a NULL id. Repeated rows are packed as often as they occur. No documents or no budgets: no rows.
    The containers depend on ids, sizes and the number of lanes alone, not on how the tables are partitioned. `lanes`
    fixes that number; else it is a power of two that doubles with the tokens, so that a lane's texts stay together
    between doublings and part in two at one. A lane ends with up to `open_bins` containers that are not full.
    """
    scratch = Scratch(spark, "packing")
    sizes = scratch.write(token_sizes(docs.where("doc_id IS NOT NULL"), tokenizer), "sizes")
    if lanes is None:
        total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        lanes = 1
        while total >= 2 * lanes * LANE_TOKENS:
            lanes *= 2
    caps = budgets.where("budget_id IS NOT NULL AND capacity > 0").select(F.col("budget_id").cast("long"), F.col("capacity").cast("long")).distinct()
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(lanes))
    # One row of every text for each budget: the budgets are a table of settings, in the plan as an array of its rows.
    every = caps.agg(F.array_sort(F.collect_set(F.struct("budget_id", "capacity"))).alias("c")).scalar()
    items = sizes.select("doc_id", "tokens", lane.alias("lane"), F.explode(every).alias("c")).select("doc_id", "tokens", "lane", "c.*")
    items = items.repartition("budget_id", "lane").sortWithinPartitions("budget_id", "lane", "doc_id", "tokens")

    def run(batches):
        packer, at = None, None
        for pdf in batches:
            rows = []
            for doc, tokens, lane, budget, capacity in pdf[["doc_id", "tokens", "lane", "budget_id", "capacity"]].itertuples(index=False):
                if at != (budget, lane, capacity):
                    packer, at = Packer(int(capacity), open_bins), (budget, lane, capacity)
                part = 0
                while tokens > capacity:
                    part += 1
                    rows.append((budget, doc, part, f"{lane}-{packer.whole()}", capacity))
                    tokens -= capacity
                rows.append((budget, doc, part + (part > 0), f"{lane}-{packer.place(int(tokens))}", tokens))
            yield pd.DataFrame(rows, columns=["budget_id", "doc_id", "part", "container", "tokens"])

    return items.mapInPandas(run, "budget_id long, doc_id long, part int, container string, tokens long")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: containers, tokens in them, and the share of their room that is used."""
    budgets = table(spark, sf_dir, "context_budgets").select("budget_id", "label", "capacity")
    used = p8_containers(spark, sf_dir).groupBy("budget_id", "container").agg(F.sum("tokens").alias("used"))
    return (
        used.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).join(budgets, "budget_id")
        .select("budget_id", "label", "capacity", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
    )


LEAST_FILL = 0.95


def p8_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget what a packing must keep: documents placed, overfull containers, texts divided though they would fit, and whether LEAST_FILL of the room is used."""
    docs, budgets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_budgets").select("budget_id", "capacity")
    placed = Scratch(spark, "promises").write(pack(spark, docs, budgets), "placed")
    bins = placed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("used")).join(budgets, "budget_id")
    bins = bins.groupBy("budget_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), (F.sum("used") >= LEAST_FILL * F.sum("capacity")).alias("full"))
    texts = placed.groupBy("budget_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts")).join(budgets, "budget_id")
    texts = texts.groupBy("budget_id").agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("divided"))
    return texts.join(bins, "budget_id").select("budget_id", "documents", "overfull", "divided", "full")


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_promises": p8_promises}
SQL = {"p8_promises": "SELECT budget_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS divided, TRUE AS \"full\" FROM context_budgets"}
