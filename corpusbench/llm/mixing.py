"""Mixing sources to target weights: blocks of equal tokens dealt by highest quotients, then chosen by seed."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusbench.llm.common import gapless_rank, stage_table
from corpusbench.operators.spread import spread_join

WEIGHTS = (5, 2, 1)
BLOCK = 32  # words
SHARD_WORDS = 1 << 20
SEED = 42
_COPIES = 1024  # equal rows that travel as one
_GRID = 32
_PRIME = 1_000_000_007  # more than any shard has blocks, so that multiplying by it permutes them
_WORD = r"[^\x20\x09-\x0D]+"


def mix_sources(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, *, share_percent: int = 150, repeats: int = 2,
    block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """What a mix takes of each document, so that sources come near their target weights.

    Columns: doc_id, source, size (words), source_size, target, taken, passes, spans, text_sum, copy.  The
    mix takes a document's words ``passes`` times whole and once more the ``spans`` (first word, words).

    Sources in the order of their names, null last, weigh ``weights`` over and over and share
    ``share_percent`` of all words; targets end at ``repeats`` times the source, what is above is shared
    anew by weight until none is.

    1. A source is cut into shards of about ``shard_words`` by hash; in a shard documents lie end to end
       in the order of a seeded hash, cut into blocks of ``block`` words.
    2. All blocks of the mix go to the shards by highest quotients: a shard that claims c words and has k
       blocks bids c / (2k + 1).  The last bid that wins is found by counting bids above ever closer
       levels; only the bids near it are listed and ranked.  So every shard has a whole number of blocks.
    3. A shard takes its blocks over and over until less than all are left to take, and of those as many
       as are left by a seeded permutation; the last may be taken in part.

    A null text has size 0, an empty source nothing to take, and a null id is an id; equal rows (id, source
    and text) are counted before they are dealt, so that they spread over shards, and numbered by ``copy``.
    A text of any length may lie over many blocks.  An empty table gives an empty one; other columns are not
    looked at, whatever their names.  The same rows and seed give the same mix wherever they come from.
    """
    named = _named(documents, id_col, text_col, source_col).select(
        "id", "source", "origin", "sum", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("size")
    )
    rows = stage_table(named.groupBy("id", "source", "origin", "sum", "size").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    sources = _targets(rows, weights, share_percent, repeats, shard_words)

    per = F.greatest(F.lit(1), F.least(F.lit(_COPIES), F.floor(F.lit(shard_words) / F.greatest("size", F.lit(1)))))
    bundles = rows.withColumn("per", per).withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("per")) - 1)))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), "sum", "bundle")
    sized = bundles.select(
        "id", "origin", "sum", "size", (F.col("bundle") * F.col("per")).alias("first"),
        F.least("per", F.col("n") - F.col("bundle") * F.col("per")).alias("copies"), F.md5(key).alias("deal"),
    )
    dealt = spread_join(sized, sources, ["origin"], "deal").withColumn("shard", _number("deal") % F.col("shards"))
    pieces = stage_table(dealt.drop("shards", "origin"), "mix-pieces")
    words = F.sum(F.col("size") * F.col("copies"))
    cells = stage_table(
        pieces.groupBy("rank", "shard").agg(
            words.alias("words"), (F.max("target") * words / F.nullif(F.max("source_size"), F.lit(0))).alias("claim")
        ).fillna(0.0, ["claim"]),
        "mix-shards",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    quotas = apportion(cells, (share_percent * total + 50 * block) // (100 * block))
    return _taken(pieces, quotas, block, repeats, seed)


def _named(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``origin`` names a source by a string that is never null; ``sum`` stands for the text."""
    source = F.col(source_col).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(
        F.col(id_col).cast("long").alias("id"), source.alias("source"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("origin"), text.alias("text"), F.md5(text).alias("sum"),
    )


def _number(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


# ---------------------------------------------------------------- targets


def _targets(rows: DataFrame, weights: Sequence[int], share_percent: int, repeats: int, shard_words: int) -> DataFrame:
    """Per source its rank by name, words, target and number of shards."""
    sums = rows.groupBy("source", "origin").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")
    )
    ranked = _ranked(sums, [F.asc_nulls_last("source")], "rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage_table(ranked.withColumn("weight", weight), "mix-sources")

    wide = lambda c: F.col(c).cast("decimal(38,0)")
    top = wide("source_size") * repeats * 100
    below = sources.agg(F.sum(wide("source_size")), F.sum(wide("weight"))).first()
    share, level = share_percent * int(below[0] or 0), None
    rest, open_weight = share, int(below[1] or 0)
    # Only two sums reach the driver; the level rises from round to round, so no source opens again.
    while open_weight and (rest, open_weight) != level:
        level = (rest, open_weight)
        above = top * F.lit(Decimal(open_weight)) < wide("weight") * F.lit(Decimal(rest))
        sums = sources.agg(F.sum(F.when(above, top)), F.sum(F.when(~above, wide("weight")))).first()
        rest, open_weight = share - int(sums[0] or 0), int(sums[1] or 0)
    limit = F.col("source_size").cast("double") * repeats
    if level is None or not open_weight:
        target = limit
    else:
        fair = (wide("weight") * F.lit(Decimal(rest))).cast("double") / F.lit(float(100 * open_weight))
        target = F.when(top * F.lit(Decimal(open_weight)) < wide("weight") * F.lit(Decimal(rest)), limit).otherwise(fair)
    shards = F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("documents")) / shard_words))
    return sources.select("source", "origin", "rank", "source_size", target.alias("target"), shards.alias("shards"))


def _ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows from 0 in an order, by ranges: only the sizes of the ranges meet in one place."""
    at = f"{name}_at"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    written = stage_table(placed, f"{name}-order")
    run = F.shiftright(at, 33)
    sizes = written.groupBy(run.alias(f"{name}_run")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(f"{name}_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(f"{name}_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = written.withColumn(f"{name}_run", run).join(F.broadcast(offsets), f"{name}_run")  # a row per range
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_before") + inside).drop(at, f"{name}_run", "_before")


# ---------------------------------------------------------------- quotas


def apportion(cells: DataFrame, seats: int) -> DataFrame:
    """``cells`` (rank, shard, claim, ...) with their ``quota`` of ``seats`` by the quotients claim / (2k + 1), highest first.

    Equal quotients go by rank and shard.  Only sums over all cells reach the driver.
    """
    if seats <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))

    def above(level: float) -> Column:
        """How many quotients of a cell are at or above a level."""
        return F.floor((F.col("claim") / level + 1) / 2)

    def counts(levels: list[float]) -> list[int]:
        return [int(x or 0) for x in cells.agg(*(F.sum(above(x)) for x in levels)).first()]

    size = cells.agg(F.sum("claim"), F.count(F.lit(1))).first()
    if not size[0]:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    low = high = size[0] / (2 * seats)
    enough = few = 0
    while enough < seats:
        low /= 2
        (enough,) = counts([low])
    few = seats + 1
    while few > seats:
        high *= 2
        (few,) = counts([high])
    while enough - few > 4 * size[1] + 1000 and high > low * (1 + 1e-14):
        levels = [low * (high / low) ** (k / _GRID) for k in range(1, _GRID)]
        found = counts(levels)
        low, enough = max([(x, n) for x, n in zip(levels, found, strict=True) if n >= seats], default=(low, enough))
        high, few = min([(x, n) for x, n in zip(levels, found, strict=True) if n <= seats and x > low], default=(high, few))
    # One quotient more on either side covers what rounding does to the counts.
    sure = F.greatest(F.lit(0).cast("long"), above(high) - 1)
    bids = cells.select("rank", "shard", "claim", F.explode(F.sequence(sure, above(low))).alias("k"))
    given = int(cells.agg(F.sum(sure)).first()[0])
    quotient = F.col("claim") / (2 * F.col("k") + 1)
    ranked = _ranked(bids.withColumn("bid", quotient), [F.desc("bid"), F.asc("rank"), F.asc("shard")], "place")
    won = ranked.where(F.col("place") < seats - given).groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("won"))
    return cells.join(won, ["rank", "shard"], "left").withColumn("quota", sure + F.coalesce("won", F.lit(0))).drop("won")


# ---------------------------------------------------------------- blocks


def _taken(pieces: DataFrame, quotas: DataFrame, block: int, repeats: int, seed: int) -> DataFrame:
    before = W.partitionBy("rank", "shard").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    laid = pieces.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
    wanted = F.least(F.col("quota") * block, F.col("words") * repeats)
    shift = F.concat_ws("|", F.lit(str(seed)), "rank", "shard")
    known = quotas.withColumn("wanted", wanted).select(
        "rank", "shard", "words", F.coalesce(F.expr("wanted div nullif(words, 0)"), F.lit(0)).alias("passes"),
        F.coalesce(F.expr("wanted % nullif(words, 0)"), F.lit(0)).alias("rest"),
        F.floor(F.col("words") / block).alias("full"), F.md5(shift).alias("turn"),
    )
    placed = laid.join(known, ["rank", "shard"]).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("number")
    ).withColumn("low", F.col("start") + F.col("number") * F.col("size")).withColumn("high", F.col("low") + F.col("size"))

    def span(j: Column) -> Column:
        """The taken part of block j inside the document."""
        order = F.when(j < F.col("full"), (j * _PRIME + _number("turn") % F.col("full")) % F.col("full")).otherwise(F.col("full"))
        length = F.greatest(F.lit(0), F.least(F.lit(block), F.col("rest") - order * block))
        first = F.greatest(F.col("low"), j * block)
        last = F.least(F.col("high"), j * block + length)
        return F.struct((first - F.col("low")).alias("start"), (last - first).alias("words"))

    blocks = F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))
    spans = F.filter(F.transform(blocks, span), lambda x: x["words"] > 0)
    none = F.array().cast("array<struct<start:bigint,words:bigint>>")
    told = placed.withColumn("spans", F.when((F.col("size") > 0) & (F.col("rest") > 0), spans).otherwise(none))
    more = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return told.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + more).alias("taken"), "passes", "spans", F.col("sum").alias("text_sum"),
        (F.col("first") + F.col("number")).alias("copy"),
    )


def mixed_texts(
    documents: DataFrame, mix: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: doc_id, source, piece, text; whole texts as they are, spans as words joined by one space.

    Documents are those ``mix`` was made of.  Equal rows are numbered so that each meets its own share.
    """
    key = ["dkey", "origin", "sum"]
    dkey = F.coalesce(F.col("id").cast("string"), F.lit(""))
    named = stage_table(
        _named(documents, id_col, text_col, source_col).withColumns({"dkey": dkey, "row": F.monotonically_increasing_id()}), "mix-texts"
    )
    numbered = gapless_rank(named.select(*key, "row"), key, ["row"], "copy")
    origin = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    shares = mix.where("taken > 0").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("dkey"), origin.alias("origin"), F.col("text_sum").alias("sum"),
        "copy", "passes", "spans",
    )
    met = numbered.join(shares, [*key, "copy"]).select("row", "passes", "spans").join(named, "row")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    part = F.transform("spans", lambda x: F.array_join(F.slice("words", (x["start"] + 1).cast("int"), x["words"].cast("int")), " "))
    whole = F.array_repeat("text", F.col("passes").cast("int"))
    return met.withColumn("words", words).select(
        F.col("id").alias("doc_id"), "source", F.posexplode(F.concat(whole, part)).alias("piece", "text")
    )
