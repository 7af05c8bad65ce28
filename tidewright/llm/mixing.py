"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells of (source, language, topic). Raking scales the cells' token weights until their
sums meet the targets of each margin, no cell ever exceeding the tokens it has. A document is then sampled
with its cell's weight over its cell's tokens: expected tokens meet the margins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Share of all tokens to be sampled, and the power by which each margin's shares are evened out.
BUDGET, POWERS = 0.7, {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: Sweeps over all margins, and sweeps between two writes of the cells.
SWEEPS, STEP = 12, 3

#: Topics by form, the first that holds; the rest is prose.
SYMBOLS, LETTERS = "[#*$%&|<>{}=]", "[A-Z]"


def topic_of(text: Column) -> Column:
    """markup, loud, brief or prose: shares of symbols and of capitals among characters, then length."""
    n = F.length(text)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(F.regexp_count(text, F.lit(SYMBOLS)) * 12 > n, "markup")
        .when(F.regexp_count(text, F.lit(LETTERS)) * 3 > n, "loud")
        .when(n < 500, "brief")
        .when(n < 4000, "prose")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """Words, white space being ASCII's; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang (null: ''), topic and n_tokens of each document."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select("doc_id", empty("source"), empty("lang"), topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"))


def aimed(cells: DataFrame, powers: dict[str, float], budget: float) -> DataFrame:
    """Cells (margins, tokens) with a column target_<margin> for each margin: the tokens aimed at for the cell's value,
    the budget being shared out in proportion to the values' tokens ** power."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value"), F.lit(float(p)).alias("power")) for m, p in powers.items()]))
    sums = cells.select("tokens", one.alias("o")).groupBy("o.margin", "o.value", "o.power").agg(F.sum("tokens").alias("t"))
    own = Window.partitionBy("margin")
    aims = sums.select("margin", "value", (F.sum("t").over(own) * budget * F.pow("t", "power") / F.sum(F.pow("t", "power")).over(own)).alias("target"))
    for m in powers:
        cells = cells.join(aims.where(F.col("margin") == m).select(F.col("value").alias(m), F.col("target").alias(f"target_{m}")), m)
    return cells


def rake(cells: DataFrame, margins: list[str], sweeps: int = SWEEPS) -> DataFrame:
    """Cells (margins, targets, tokens > 0) with weight, its sums meeting the targets as nearly as tokens allow, and
    margin_error, the largest relative distance from its targets that the sums of the cell's margins are left with.

    Each scaling keeps weight <= tokens. The cells are few against the documents, and stay a table.
    """
    held = lambda m: F.sum("weight").over(Window.partitionBy(m))
    now = cells.withColumn("weight", F.col("tokens"))
    for k in range(1, sweeps + 1):
        for m in margins:
            now = now.withColumn("weight", F.least(F.col("weight") * (F.col(f"target_{m}") / held(m)), F.col("tokens")))
        if k % STEP == 0 or k == sweeps:
            now = settle(now, "mix-cells")
    return now.withColumn("margin_error", F.greatest(*[F.abs(held(m) / F.col(f"target_{m}") - 1) for m in margins]))


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that doc_id and seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mixed(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS, seed: str = "mix-") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (6 digits), margin_error and sampled for documents (doc_id, text, lang, source).

    margin_error is the largest relative distance between expected tokens and target of the document's source,
    language and topic; it is large only where the targets ask for more tokens than there are.

    Null sources and languages count as ''. A document without words has weight 0 in every margin, costs no
    budget and is always sampled. Repeated doc_ids share one draw. No documents give no rows.
    """
    own = settle(labelled(docs), "mix-docs")
    margins = list(powers)
    cells = settle(own.groupBy(*margins).agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0"), "mix-sums")
    raked = rake(settle(aimed(cells, powers, budget), "mix-aims"), margins)
    rates = raked.select(*margins, F.round(F.col("weight") / F.col("tokens"), 6).alias("probability"), F.round("margin_error", 4).alias("margin_error"))
    return own.join(settle(rates, "mix-rates"), margins, "left").select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.coalesce("probability", F.lit(1.0)).alias("probability"), F.coalesce("margin_error", F.lit(0.0)).alias("margin_error"),
    ).withColumn("sampled", chance(F.col("doc_id"), seed) < F.col("probability"))


def margin_report(mix: DataFrame, margins: tuple[str, ...] = ("source", "lang", "topic")) -> DataFrame:
    """Tokens before and expected tokens after mixing for each value of each margin."""
    each = [mix.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")) for m in margins]
    return reduce(DataFrame.unionByName, each)


def op9_iterative_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling of all documents to target weights; see mixed() for nulls and texts without words."""
    return mixed(table(spark, sf_dir, "documents"))


def oracle(budget: float = BUDGET, powers: dict[str, float] = POWERS, sweeps: int = SWEEPS, seed: str = "mix-") -> str:
    """DuckDB SQL for mixed(): the sweeps written out."""
    margins = ", ".join(powers)
    share = lambda pattern, k: f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))) * {k} > length(text)"
    steps = [
        f"""own AS (SELECT doc_id, coalesce(source, '') source, coalesce(lang, '') lang,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN {share(SYMBOLS, 12)} THEN 'markup' WHEN {share(LETTERS, 3)} THEN 'loud'
    WHEN length(text) < 500 THEN 'brief' WHEN length(text) < 4000 THEN 'prose' ELSE 'long' END topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT n_tokens FROM documents)""",
        f"cells AS (SELECT {margins}, sum(n_tokens)::DOUBLE tokens FROM own GROUP BY ALL HAVING sum(n_tokens) > 0)",
        *(f"aim_{m} AS (SELECT {m}, sum(t) OVER () * {budget} * pow(t, {p}) / sum(pow(t, {p})) OVER () target FROM (SELECT {m}, sum(tokens) t FROM cells GROUP BY ALL))" for m, p in powers.items()),
        "w0 AS (SELECT *, tokens weight FROM cells)",
    ]
    for n, m in enumerate(list(powers) * sweeps):
        steps.append(f"w{n + 1} AS (SELECT w.* EXCLUDE (weight), least(weight * (target / sum(weight) OVER (PARTITION BY w.{m})), tokens) weight FROM w{n} w JOIN aim_{m} USING ({m}))")
    last = f"w{len(powers) * sweeps}"
    error = ", ".join(f"abs(sum(weight) OVER (PARTITION BY w.{m}) / target_{m} - 1)" for m in powers)
    joins = " ".join(f"JOIN (SELECT {m}, target target_{m} FROM aim_{m}) USING ({m})" for m in powers)
    steps.append(f"ends AS (SELECT w.*, greatest({error}) error FROM {last} w {joins})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, n_tokens, probability, margin_error,
  ('0x' || substr(md5(concat('{seed}', coalesce(doc_id::VARCHAR, ''))), 1, 8))::UBIGINT / 4294967296.0 < probability sampled
FROM (SELECT own.*, coalesce(round(weight / tokens, 6), 1.0) probability, coalesce(round(error, 4), 0.0) margin_error FROM own LEFT JOIN ends USING ({margins}))"""
