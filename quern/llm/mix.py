"""Mixing sources to target shares of tokens, with a cap on repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tokens import token_count
from quern.session import cut, spread

BINS = 4096  # bins of the sampling order of a source; only the bin in which the budget ends is sorted


LEAST_WEIGHT = 0.05
FULL_WORDS = 100  # words from which a text isn't short


def quality(text: Column) -> Column:
    """Weight of a text in sampling, in [0.05, 1]: the geometric mean of what speaks for running prose.

    Share of letters and blanks among its characters; distinct words against the number that a text of its length has by Heaps' law (at the
    square root, times 3); distinct lines among all; words of 15 characters or less among all; and its length, up to 100 words. All in expressions that
    are compiled, without functions over elements.
    """
    words, lines = F.split(text, r"\s+"), F.split(text, r"[\r\n]+")
    n = F.size(words).cast("double")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.nullif(F.length(text), F.lit(0))
    varied = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.least(n, 3 * F.sqrt(n)))
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    usual = F.greatest(F.lit(0.0), 1 - F.regexp_count(text, F.lit(r"\S{16,}")) / n)
    whole = F.pow(letters * varied * fresh * usual * F.least(F.lit(1.0), n / FULL_WORDS), F.lit(0.2))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(whole, F.lit(LEAST_WEIGHT)))


def sized_texts(docs: DataFrame, tokenizer: str | None = None, weight: str | None = None, size: Column | None = None) -> DataFrame:
    """(source, key, doc_id, copies, tokens, weight): each different text of a source once, with its size in tokens.

    Rows of one text and source are copies, told apart by a 128-bit hash; the lowest doc_id stands for them. Null texts have no
    size and are left out, empty texts have 0 tokens; a null source is a source of its own. Null, NaN and non-positive weights
    count as 0.05. ``size`` is another measure than tokens. Texts don't move: only hashes and sizes are shuffled.
    """
    t = F.col("text")
    w = quality(t) if weight is None else F.when(F.col(weight) > 0, F.when(F.isnan(F.col(weight).cast("double")), F.lit(0.05)).otherwise(F.col(weight).cast("double"))).otherwise(F.lit(0.05))
    rows = spread(docs.where(t.isNotNull()), "doc_id").select("source", F.md5(t.cast("binary")).alias("key"), "doc_id", w.alias("weight"), (token_count("text", tokenizer) if size is None else size).cast("long").alias("tokens"))
    return rows.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("tokens").alias("tokens"), F.max("weight").alias("weight"))


def budgets(texts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source of ``targets``: size, total, wanted tokens, complete epochs, tokens of the fractional epoch, whether it reaches its share.

    ``total`` is the size of the mix in tokens, by default that of all rows together, copies included. A source that is missing
    in the texts has size 0; one missing in the targets contributes nothing. Of several target rows of a source the largest
    share and use hold. Null shares and uses count 0. One row per source: small, its aggregate is computed map-side first.
    """
    per = texts.groupBy("source").agg(F.sum("tokens").alias("size"), F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"), F.avg("weight").alias("mean_weight"), F.count(F.lit(1)).alias("n_texts"))
    if total is None:
        total = per.agg(F.coalesce(F.sum("all_tokens"), F.lit(0))).first()[0]
    goal = targets.groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_uses", F.lit(0))).alias("max_uses"))
    rows = goal.join(per.select(F.col("source").alias("_s"), "size", "mean_weight", "n_texts"), goal["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    size = F.coalesce("size", F.lit(0))
    wanted = F.round(F.col("target_share") * F.lit(total)).cast("long")
    rows = rows.select("source", "target_share", "max_uses", size.alias("size"), F.coalesce("mean_weight", F.lit(1.0)).alias("mean_weight"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.lit(total).cast("long").alias("total"), wanted.alias("wanted"))
    full = F.least(F.col("max_uses").cast("long"), F.when(F.col("size") > 0, F.expr("wanted div size")).otherwise(F.lit(0)))
    reach = F.col("size") * F.col("max_uses") >= F.col("wanted")
    rest = F.when(full < F.col("max_uses"), F.least(F.col("size"), F.col("wanted") - full * F.col("size"))).otherwise(F.lit(0))
    return rows.select("*", full.alias("epochs"), rest.alias("rest"), reach.alias("reached"))


def draw(texts: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """(source, key, doc_id, tokens, uses): the mix, each text as often as it is used; texts that aren't used have no row.

    Complete epochs use every text; the fractional epoch takes texts in the order of Efraimidis and Spirakis: exponential keys
    with the text's weight as rate, drawn by a hash of seed and text, ascending, up to the last text that still fits the rest of
    the budget. The prefix sums are exact and don't gather a source: keys fall into ``BINS`` bins of about equal size, the
    bins' sums are added up per source, and only within the bin where the budget ends are texts sorted. Plan rows are joined
    by broadcast only if Spark finds them small.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("key")), 11).cast("double") + 0.5) / float(1 << 53)
    p = plan.select(F.col("source").alias("_s"), "epochs", "rest", "mean_weight")
    rows = texts.join(p, texts["source"].eqNullSafe(F.col("_s"))).drop("_s")
    e = -F.log(u) / F.col("weight")
    rows = rows.select("source", "key", "doc_id", "tokens", "epochs", "rest", e.alias("_e"), F.floor(F.lit(BINS) * (1 - F.exp(-e * F.col("mean_weight")))).cast("int").alias("_bin"))
    bins = rows.groupBy("source", "_bin").agg(F.sum("tokens").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), before.alias("_before"), "_t")
    rows = rows.join(bins, rows["source"].eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    whole, none = F.col("_before") + F.col("_t") <= F.col("rest"), F.col("_before") >= F.col("rest")
    base = ["source", "key", "doc_id", "tokens"]
    easy = rows.where(whole | none).select(*base, (F.col("epochs") + whole.cast("long")).alias("uses"))
    upto = F.sum("tokens").over(Window.partitionBy("source", "_bin").orderBy("_e", "key"))
    last = rows.where(~whole & ~none).withColumn("_upto", upto).select(*base, (F.col("epochs") + (F.col("_before") + F.col("_upto") <= F.col("rest")).cast("long")).alias("uses"))
    return easy.unionByName(last).where(F.col("uses") > 0)


def mix_sources(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str | None = None, weight: str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The drawn mix (see ``draw``) and its report per source: target and actual share, tokens, uses, whether the share can be reached.

    ``used_up`` says that the mix holds every text of the source as often as it may be used; with less ``drawn`` than ``wanted`` the source falls short.

    ``actual_share`` is of the tokens drawn in all, ``drawn_share`` of the mix that was asked for. Empty tables give an empty
    mix; the report then has all targets with nothing drawn. Sources that can't reach their share give all they may.
    """
    texts = cut(sized_texts(docs, tokenizer, weight))
    plan = cut(budgets(texts, targets, total))
    mix = draw(texts, plan, seed)
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("drawn"), F.max("uses").alias("most_uses"), F.min("uses").alias("least_uses"), F.count(F.lit(1)).alias("texts"))
    rows = plan.join(got.withColumnRenamed("source", "_s"), plan["source"].eqNullSafe(F.col("_s")), "left").drop("_s").na.fill(0, ["drawn", "most_uses", "least_uses", "texts"])
    whole = got.agg(F.sum("drawn").alias("_all")).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1)).join(whole, "_one")
    used_up = (F.col("max_uses") <= 0) | (F.col("n_texts") == 0) | ((F.col("texts") == F.col("n_texts")) & (F.col("least_uses") >= F.col("max_uses")))
    report = rows.select("source", "target_share", "max_uses", "size", "wanted", "drawn", "texts", "most_uses", "reached", used_up.alias("used_up"), (F.col("drawn") / F.nullif(F.col("_all"), F.lit(0))).alias("actual_share"), (F.col("drawn") / F.nullif(F.col("total"), F.lit(0))).alias("drawn_share"))
    return mix, report
