"""Similar texts and vectors: shingles, overlap joins, cosine and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import Scratch

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of k tokens as strings; none for shorter texts."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
    return F.when(n >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shingle_table(texts: DataFrame, key: str, k: int, pattern: str = TOKEN, hashed: bool = False) -> DataFrame:
    """(key, shingle), distinct, over whole lower-cased texts; hashed: numbers of 64 bits in place of the shingles, a quarter of their size in every shuffle."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    # The one-element explode keeps the optimizer from writing the tokenizer into the lambda, where it would run for every run of tokens.
    held = texts.where("text IS NOT NULL").select(key, F.explode(F.array(tokens)).alias("tokens"))
    runs = shingles(F.col("tokens"), k)
    return held.select(key, F.explode(F.transform(runs, lambda s: F.xxhash64(s)) if hashed else runs).alias("shingle"))


def overlap_pairs(sets: DataFrame, key: str, least: float, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, shared, overlap): pairs a < b that share `least` of the smaller set or more, exactly.

    Prefix filter: elements are ordered from rare to common; if two sets share that much, one of the first
    n - ceil(least * n) + 1 elements of the smaller set of n is in the larger. Only those prefixes are joined with
    the sets of at least the size, so that common elements hardly take part; what is found is then counted in full.
    sets: key, shingle without repeats. With a scratch folder the sets and their order are worked out once and
    written, else as often as the plan reads them.
    """
    held = (lambda df: scratch.write(df, "sets")) if scratch else (lambda df: df)
    sets = held(sets)
    df = sets.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    size = sets.groupBy(key).agg(F.count("*").alias("n"))
    ranked = sets.join(df, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    w = Window.partitionBy(key).orderBy("df", "shingle")
    ranked = held(ranked.withColumn("pos", F.row_number().over(w)).join(size, key).where("df > 1"))
    prefix = ranked.where((F.col("pos") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)).select(F.col(key).alias("small"), "shingle", F.col("n").alias("n_small"))
    full = ranked.select(F.col(key).alias("large"), "shingle", F.col("n").alias("n_large"))
    near = prefix.join(full, "shingle").where("n_large > n_small OR (n_large = n_small AND large <> small)").select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b")).distinct()
    one = near.join(full.select(F.col("large").alias("a"), "shingle"), "a")
    shared = one.join(full.select(F.col("large").alias("b"), "shingle"), ["b", "shingle"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    x = shared.join(size.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    x = x.withColumn("overlap", F.col("shared") / F.least("na", "nb"))
    return x.where(F.col("overlap") >= least - 1e-12).select("a", "b", "shared", "overlap")


def copy_classes(texts: DataFrame, key: str) -> DataFrame:
    """(key, rep): each text's smallest key of equal content, white space aside."""
    plain = texts.where("text IS NOT NULL").select(key, F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("h"))
    return plain.join(plain.groupBy("h").agg(F.min(key).alias("rep")), "h").select(key, "rep")


def function_texts(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, body_hash, text) of the functions and methods that have a body hash: their lines of their file's text (file, text).

    A file's symbols are brought to its text, not the text to each of them.
    """
    eligible = symbols.where(F.col("kind").isin("Function", "Method") & F.col("body_hash").isNotNull())
    per = eligible.groupBy("file").agg(F.collect_list(F.struct("id", "body_hash", "start_line", "end_line")).alias("s"))  # the symbols of one file
    x = texts.where("text IS NOT NULL").join(per, "file").select("s", F.split(F.regexp_replace("text", "\r", ""), "\n").alias("lines"))
    cut = lambda v: F.array_join(F.slice("lines", v["start_line"], F.greatest(v["end_line"] - v["start_line"] + 1, F.lit(0))), "\n")
    return x.select(F.explode(F.transform("s", lambda v: F.struct(v["id"].alias("id"), v["body_hash"].alias("body_hash"), cut(v).alias("text")))).alias("r")).select("r.*")


def code_near_duplicates(functions: DataFrame, least: float = 0.5, k: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(symbol, other, overlap) in both directions, for functions (id, text, body_hash) that overlap by `least` in runs of k tokens and differ in body hash."""
    sets = shingle_table(functions, "id", k, hashed=True)
    pairs = overlap_pairs(sets, "id", least, scratch)
    h = functions.select("id", "body_hash")
    x = pairs.join(h.select(F.col("id").alias("a"), F.col("body_hash").alias("ha")), "a").join(h.select(F.col("id").alias("b"), F.col("body_hash").alias("hb")), "b").where("NOT (ha <=> hb)")
    return x.select(F.col("a").alias("symbol"), F.col("b").alias("other"), "overlap").union(x.select("b", "a", "overlap"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, length_a: Column | None = None, length_b: Column | None = None) -> Column:
    """Cosine of two vectors of doubles, with their lengths if known; 0 for unequal sizes or a zero vector."""
    norm = (F.sqrt(dot(a, a)) if length_a is None else length_a) * (F.sqrt(dot(b, b)) if length_b is None else length_b)
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, cosine, rank): each query's k nearest vectors but itself.

    vectors: id, vec; queries: query_id, query_vec, a stated set held against all rows in one pass. Each partition's
    best k are kept by a heap-like aggregate before anything is shuffled.
    """
    v = vectors.select("id", F.explode(F.array(F.col("vec").cast("array<double>"))).alias("v"))
    q = queries.select("query_id", F.explode(F.array(F.col("query_vec").cast("array<double>"))).alias("q"))
    v, q = v.withColumn("lv", F.sqrt(dot(F.col("v"), F.col("v")))), q.withColumn("lq", F.sqrt(dot(F.col("q"), F.col("q"))))
    x = v.join(q).where("id <> query_id").select("query_id", "id", F.round(cosine(F.col("v"), F.col("q"), F.col("lv"), F.col("lq")), 6).alias("cosine"))
    part = F.row_number().over(Window.partitionBy("query_id", "_p").orderBy(F.col("cosine").desc(), "id"))
    best = x.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", part).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "cosine", "rank")


def keyword_retrieval(docs: DataFrame, words: list[str], key: str, text: str = "text", limit: int = 10) -> DataFrame:
    """The first `limit` documents, by key, that hold one of the words of three letters or more."""
    use = [w.lower() for w in words if len(w) > 2]
    hit = F.lit(False)
    for w in use:
        hit = hit | F.contains(F.lower(text), F.lit(w))
    return docs.where(hit).select(key).orderBy(key).limit(limit)


def retrieve(docs: DataFrame, words: list[str], key: str, vectors: DataFrame | None = None, query: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(key, rank, how): the nearest documents by vector (id, vec) to the one query (query_id, query_vec), or, where there are no vectors or no query, the first that hold a word.

    `how` is `semantic` or `keyword`, so that a reader knows which search answered.
    """
    if vectors is not None and query is not None and not vectors.isEmpty() and not query.isEmpty():
        return nearest(vectors, query, limit).select(F.col("id").alias(key), "rank", F.lit("semantic").alias("how"))
    hits = keyword_retrieval(docs, words, key, limit=limit)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(key))).withColumn("how", F.lit("keyword"))  # `limit` rows
