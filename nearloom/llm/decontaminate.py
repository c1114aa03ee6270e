"""Finding benchmark passages in documents, by a prefix-filtered set join.

An item's windows of ``window`` words (a shorter item is one window) are the sets, runs of
``shingle`` words their tokens.  Tokens are ordered by how often the corpus holds them.  As a hit
needs all of a window's tokens, a prefix of one token, the rarest, is enough to find it.  Each
document position is looked up by its token, bounds on length and position follow from the token's
place in the window, and the window's words are compared one for one.

Only DataFrame functions, no Python on the executors.  The documents are scanned twice and never
shuffled: what is exchanged is one count per benchmark token and task, and the hits.  The windows
are broadcast in blocks of at most ``block``, whose number is counted first; each further block is
another scan, so no size of benchmark breaks the bound.

Defined results: null and empty texts have no words and no hits; null or empty items have no
window; item ids that repeat count once; every row of documents gives one row, also where ids
repeat or are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import checkpointed

WINDOW = 10
SHINGLE = 4
#: Windows in one broadcast: at ten words some 30 MB.
BLOCK = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased runs of digits, letters a-z and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # lower() then does the same, and faster
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _token(of: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(of, at + i) for i in range(k)])


def windows(items: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Distinct windows: their words, the items that hold them, and the token length."""
    split = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    at = split.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at"))
    each = at.select("item", F.slice("words", F.col("at") + 1, F.least(F.lit(window), F.size("words"))).alias("window"))
    held = each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return held.withColumn("k", F.least(F.lit(shingle), F.size("window")))


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each position and token length; ``at = n`` is one row more, without a token."""
    split = docs.withColumn("words", words(F.col("text"))).drop("text").withColumn("n", F.size("words"))
    at = split.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n"))))
    tokens = [F.when(F.col("at") + k <= F.col("n"), _token(F.col("words"), F.col("at"), k)) for k in lengths]
    return at.withColumn("token", tokens[0] if len(tokens) == 1 else F.explode(F.array(*tokens)) if tokens else F.lit(None).cast("long"))


def _tokens_of(found: DataFrame, lengths: list[int]) -> DataFrame:
    """Each window's tokens and where they start."""
    parts = [found.where(F.col("k") == k).withColumn("off", F.explode(F.sequence(F.lit(0), F.size("window") - k))).withColumn("token", _token(F.col("window"), F.col("off"), k)) for k in lengths]
    return reduce(DataFrame.unionByName, parts)


def _prefixes(docs: DataFrame, found: DataFrame, lengths: list[int]) -> DataFrame:
    """Each window with its token that is rarest in the corpus."""
    tokens = _tokens_of(found, lengths)
    seen = _positions(docs.select("text"), lengths).where("token is not null")
    counts = seen.join(F.broadcast(tokens.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    ranked = tokens.join(counts, "token", "left").withColumn("rank", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "off"))
    least = ranked.groupBy("window").agg(F.min("rank").alias("rank"), F.first("items").alias("items"))
    return least.select("window", "items", F.size("window").alias("len"), F.col("rank.token").alias("token"), F.col("rank.off").alias("off"))


def hits(docs: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``docs`` has ``doc_id`` and ``text``; returns a row for each of its rows and each hit.

    ``start`` and ``end`` (words, end exclusive) and ``items`` are null in the row that each
    document has anyway, which carries ``n_words``.
    """
    docs = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = checkpointed(windows(items, item_col, item_text_col, window, shingle))
    total = found.count()
    lengths = sorted(r.k for r in found.select("k").distinct().collect())  # at most ``shingle`` values
    if not total:
        return _positions(docs, []).where(F.col("at") == F.col("n")).select("doc_id", "row", F.col("n").cast("long").alias("n_words"), *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("items", "array<string>"))])
    n_blocks = -(-total // block)
    parts = []
    for b in range(n_blocks):
        own = found if n_blocks == 1 else found.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b)
        prefixes = checkpointed(_prefixes(docs, own, lengths)).withColumnRenamed("token", "sought")
        at = _positions(docs, lengths)
        joined = at.join(F.broadcast(prefixes), F.col("token") == F.col("sought"), "left")
        start = F.col("at") - F.col("off")
        fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
        same = fits & (F.slice("words", start + 1, F.col("len")) == F.col("window"))
        is_hit = F.col("sought").isNotNull() & same
        last = (F.col("at") == F.col("n")) & (F.lit(b) == 0)
        parts.append(joined.where(last | is_hit).select("doc_id", "row", F.when(last, F.col("n").cast("long")).alias("n_words"), F.when(is_hit, start).alias("start"), F.when(is_hit, start + F.col("len")).alias("end"), F.when(is_hit, F.col("items")).alias("items")))
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: words, words inside hits, and the items hit."""
    spot = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    per_row = hits(docs, items, **options).groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(spot)).alias("spots"), F.collect_set("items").alias("held"))
    none = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("upto"))
    grown = F.aggregate("spots", none, lambda a, s: F.struct((a.covered + F.greatest(s.end - F.greatest(s.start, a.upto), F.lit(0))).cast("long").alias("covered"), F.greatest(a.upto, s.end).alias("upto")))
    ids = F.sort_array(F.array_distinct(F.flatten("held")))
    return per_row.select("doc_id", "n_words", grown["covered"].alias("n_hit"), ids.alias("items"), (F.size("spots") > 0).alias("contaminated"), "spots")
