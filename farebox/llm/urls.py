"""URL filter: rules first, then the log-likelihood ratio of two character language models.

Urls that a rule allows or blocks train one variable-order Markov model each; urls without a rule are judged by the
difference of their log-likelihoods per character, at a threshold calibrated on a fold of ruled urls that was kept out
of training. Everything is built-in functions: no Python runs in tasks.

A position of a url is its character and the `CONTEXT` characters before it. Contexts are interpolated from short to
long (Witten-Bell); those a class has seen fewer than `least_seen` times are passed over, so each position uses the
longest context that is known well enough. Every url of the table counts, equal urls once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.session import cut

CONTEXT = 4  # characters before the one that is predicted
START, END = "\x02", "\x03"
UNIFORM = 1 / 256  # probability of a character without any context
KEPT_OUT = ("0", "1", "2")  # ruled urls whose md5 begins so calibrate, the others train
STEPS = 100  # bins of a score to one nat per character
REACH = 10  # scores are binned between -REACH and REACH
HOT_SHARE = 1000  # a gram with 1/HOT_SHARE of all positions is hot; so there are at most HOT_SHARE


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (  # the rules of the registered query
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
)


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the text the models read: host and all behind it, or the whole url if it has no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(
        F.regexp_extract(tail, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(tail, "(?s)^[^/?#]*(.*)$", 1)
    return host, path, F.when(at > 0, F.concat(host, rest)).otherwise(url)


def _first_rule(rules: tuple[Rule, ...], host: Column, path: Column, value: str) -> Column:
    """The longest rule that fits; among equally long ones a blocking one, then the first by name."""
    chosen: Column | None = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.action != "block", r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        made = F.lit(getattr(rule, value))
        chosen = F.when(fits, made) if chosen is None else chosen.when(fits, made)
    return chosen if chosen is not None else F.lit(None).cast("string")


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`page_id, host, path, rule, action, text`: rule and action are null where no rule fits."""
    host, path, text = _parts(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    return named.select(
        "page_id", "host", "path",
        _first_rule(rules, F.col("host"), F.col("path"), "name").alias("rule"),
        _first_rule(rules, F.col("host"), F.col("path"), "action").alias("action"),
        "text",
    )


def _positions(texts: DataFrame, *columns: str) -> DataFrame:
    """One row per character of each text and its end mark, as the gram of that character and its context."""
    marked = texts.select(*columns, F.split(F.concat(F.lit(START * CONTEXT), "text", F.lit(END)), "").alias("chars"))
    chars = F.col("chars")
    grams = F.transform(
        F.sequence(F.lit(0), F.size(chars) - CONTEXT - 1),
        lambda i: F.concat(*[F.get(chars, i + k) for k in range(CONTEXT + 1)]),
    )
    return marked.select(*columns, F.explode(grams).alias("gram"))


def _probabilities(grams: DataFrame, least_seen: int) -> DataFrame:
    """`gram, allow, block`: the probability of each gram's last character under both models.

    Level k has the last k characters of each gram. A level has at most an alphabet of rows for one context and for one
    shorter gram, so neither the windows nor the joins here have a hot key.
    """
    known: DataFrame | None = None
    for k in range(1, CONTEXT + 2):
        context = Window.partitionBy(F.expr(f"left(gram, {k - 1})"))  # at level 1 one empty context, an alphabet of rows
        level = (
            grams.groupBy(F.expr(f"right(gram, {k})").alias("gram"))
            .agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        )
        level = level.select(
            "gram",
            *[c for side in ("allow", "block") for c in (
                F.col(side).alias(f"{side}_n"),
                F.sum(side).over(context).alias(f"{side}_all"),
                F.sum(F.when(F.col(side) > 0, 1).otherwise(0)).over(context).alias(f"{side}_kinds"),
            )],
        )
        if known is not None:
            level = level.withColumn("shorter", F.expr(f"right(gram, {k - 1})")).join(known, "shorter")
        found = []
        for side in ("allow", "block"):
            n, all_, kinds = F.col(f"{side}_n"), F.col(f"{side}_all"), F.col(f"{side}_kinds")
            below = F.lit(UNIFORM) if known is None else F.col(f"{side}_below")
            found.append(F.when(all_ >= least_seen, (n + kinds * below) / (all_ + kinds)).otherwise(below).alias(side))
        level = level.select("gram", *found)
        known = level.select(F.col("gram").alias("shorter"), F.col("allow").alias("allow_below"), F.col("block").alias("block_below"))
    return level


def _threshold(scored: DataFrame) -> int:
    """The bin from which held-out ruled urls are best called accepted: least mean of both error rates.

    All bins up to one with urls, from the one with urls before it, are as good as that; the nearest to 0 stands for
    them. Ties go to the bin nearest 0, then to the lower one. Without held-out urls of both classes it is 0. At most
    2 * REACH * STEPS + 1 bins are looked at, whatever the size of the input.
    """
    bins = scored.groupBy("bin").agg(
        F.sum((F.col("action") == "allow").cast("long")).alias("allow"),
        F.sum((F.col("action") == "block").cast("long")).alias("block"),
    )
    everything = Window.partitionBy(F.lit(0))
    below = everything.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    lowest = F.coalesce(F.lag("bin").over(everything.orderBy("bin")) + 1, F.least(F.lit(0), "bin"))
    best = (
        bins.select(
            F.greatest(lowest, F.least(F.lit(0), "bin")).alias("bin"),
            F.sum("allow").over(everything).alias("n_allow"), F.sum("block").over(everything).alias("n_block"),
            F.coalesce(F.sum("allow").over(below), F.lit(0)).alias("lost"),
            (F.sum("block").over(everything) - F.coalesce(F.sum("block").over(below), F.lit(0))).alias("passed"),
        )
        .where("n_allow > 0 AND n_block > 0")
        .orderBy((F.col("lost") * F.col("n_block") + F.col("passed") * F.col("n_allow")), F.abs("bin"), "bin")
        .select("bin").first()
    )
    return best.bin if best else 0


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, least_seen: int = 2) -> DataFrame:
    """`page_id, host, path, rule, verdict, score` of every page, by rules and by the models where no rule fits.

    A null url is an empty one; a url without `://` has an empty host and path and is read whole by the models. score
    is the log-likelihood difference per character (positive: like accepted urls), null for ruled urls outside the
    calibration fold. Without training urls of both classes every score is 0 and every url without a rule is allowed.
    Repeated rows and null page_ids are judged each; other columns are left behind. Nothing is capped: grams that make
    up a thousandth of all positions or more (at most a thousand) are joined by broadcast, all others by a shuffle.
    """
    judged = ruled(pages, rules)
    key = F.coalesce("action", F.lit("")).alias("side")
    texts = cut(
        judged.groupBy("text", key).agg(F.count(F.lit(1)).alias("n_pages"))
        .select("text", "side", F.monotonically_increasing_id().alias("id"), F.left(F.md5(F.encode("text", "UTF-8")), F.lit(1)).isin(*KEPT_OUT).alias("kept_out")),
        "urls",
    )
    train = ~F.col("kept_out")
    grams = cut(
        _positions(texts, "side", "kept_out").groupBy("gram").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((train & (F.col("side") == "allow")).cast("long")).alias("allow"),
            F.sum((train & (F.col("side") == "block")).cast("long")).alias("block"),
        ),
        "url-grams",
    )
    total = grams.agg(F.sum("n").alias("n"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    trained = bool(total.allow and total.block)
    least_hot = -(-(total.n or 1) // HOT_SHARE)
    ratio = (F.ln("allow") - F.ln("block")) if trained else F.lit(0.0)
    ratios = cut(
        _probabilities(grams, least_seen).select("gram", ratio.alias("ratio"))
        .join(grams.select("gram", (F.col("n") >= least_hot).alias("hot")), "gram"),
        "url-ratios",
    )
    hot = F.broadcast(ratios.where("hot").select("gram", "ratio"))  # at most HOT_SHARE rows
    positions = _positions(texts.where("side = '' OR kept_out"), "id")
    parts = [
        positions.join(hot, "gram"),
        positions.join(hot, "gram", "left_anti").join(ratios.where("NOT hot").select("gram", "ratio"), "gram"),
    ]
    sums = [p.groupBy("id").agg(F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("n")) for p in parts]
    score = (F.sum("ratio") / F.sum("n")).alias("score")
    means = sums[0].union(sums[1]).groupBy("id").agg(score)
    bound = REACH * STEPS
    binned = F.floor(F.round("score", 6) * STEPS)
    scored = cut(
        texts.join(means, "id").select(
            "text", "side", "score", F.greatest(F.lit(-bound), F.least(F.lit(bound), binned)).cast("int").alias("bin")
        ),
        "url-scores",
    )
    threshold = _threshold(scored.where("side != ''").withColumnRenamed("side", "action"))
    method = F.when(F.col("bin") >= threshold, "allow").otherwise("block")
    found = scored.select("text", "side", "score", method.alias("method"))
    return (
        judged.withColumn("side", key).join(found, ["text", "side"], "left")
        .select("page_id", "host", "path", "rule", F.coalesce("action", "method").alias("verdict"), "score")
    )
