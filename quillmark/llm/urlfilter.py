"""URL filters: host and path rules, and for all other URLs two character language models.

1. A URL's host and path are taken by position. A rule fits its host and all subdomains of it if the
   path starts with the rule's; the longest fitting rule (characters of host and path, ties by text)
   gives the verdict.
2. The rules label the corpus: each URL that they allow or block is read by a model of its class, but for
   those that a hash of the text leaves for calibration (CALIBRATED). A model is a variable-order Markov chain over characters of
   host and path, between a start and an end mark: contexts of up to ORDER characters, as long as a
   context and its follower make up at least LEAST_SHARE of the positions of a class (so there are at
   most 2 / LEAST_SHARE of an order, whatever the corpus; all counts are over the whole corpus).
   Probabilities are interpolated by Witten and Bell: a context with n followers of which t differ
   takes t / (n + t) of its weight from the next shorter one, the empty one from equal characters.
3. A gram's ratio is log P(allowed) - log P(blocked) of its last character after the others. Kept grams
   are closed under dropping the first character, so each keeps only the difference to its suffix: the
   sum of these over all known grams of a URL is the sum of each position's longest known context.
   Divided by the positions, this is the URL's score.
4. The least score that is allowed is calibrated on the labelled URLs that the models have not read: of
   all thresholds in steps of 1 / STEPS the one that tells most of them right, both classes weighing the
   same, the one nearest 0 where several do.

Only DataFrame functions are used. Equal URLs are scored once, grams are counted with partial sums, and
the only broadcast is the table of grams, whose size LEAST_SHARE bounds.

Defined results: a null URL and one without ``://`` have an empty host and path, which no rule fits and
no model reads: they are allowed, as is every URL that no rule fits if one class has no URL to learn
from. Without labelled URLs that the models have not read the threshold is 0. Upper-case letters of ASCII
in hosts are lower-cased, nothing else is decoded. Repeated rows are judged alike and stay; other columns
of pages are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

ORDER = 5
#: A gram stays if it is at least this share of a class's positions.
LEAST_SHARE = 2.0**-14
#: URLs whose text's hash starts with a digit below this are left for calibration.
CALIBRATED = "3"
#: Steps of the calibrated threshold in a unit of score, and how far from 0 it may lie.
STEPS, FARTHEST = 512, 4
#: Characters of a text that are cut at once.
PIECE = 256
#: Marks of a URL's start and end; a URL that holds them itself is read all the same.
START, END = "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host (ASCII) and path of a URL; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    host = F.translate(part(r"(?s)^([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, part(r"(?s)^[^/?#]*([^?#]*)")


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, allow = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.allow).otherwise(allow)
    return text, allow


def texts_of(urls: DataFrame) -> DataFrame:
    """(key, text, n, allow) of the distinct non-empty texts of rows (text, allow)."""
    found = urls.filter("text != ''").groupBy("text", "allow").agg(F.count(F.lit(1)).alias("n"))
    return materialize(found.select(F.md5("text").alias("key"), "text", "n", "allow"), "url-texts")


def grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """texts with ``gram`` and ``size`` in place of text: each character with 0 to ``order`` ones before it."""
    marked = F.concat(F.lit(START), F.col("text"), F.lit(END))

    def piece(start: Column) -> Column:
        """Pieces keep a very long text from being walked for each of its grams."""
        before = F.least(F.lit(order), start - 1)
        return F.struct(F.substring(marked, start - before, before + PIECE).alias("part"), F.greatest(before + 1, 3 - start).alias("first"))

    cut = texts.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length(marked), F.lit(PIECE)), piece)).alias("p")).drop("text")
    ends = cut.filter(F.length("p.part") >= F.col("p.first")).withColumn("end", F.explode(F.sequence(F.col("p.first"), F.length("p.part"))))
    sizes = F.sequence(F.lit(1), F.least(F.lit(order + 1), F.col("end")))
    return ends.withColumn("size", F.explode(sizes)).withColumn("gram", F.substring(F.col("p.part"), F.col("end") - F.col("size") + 1, F.col("size"))).drop("p", "end")


def trained(labelled: DataFrame, order: int = ORDER, least: float = LEAST_SHARE) -> DataFrame:
    """(gram, delta) of both models, from rows (text, n, allow) of distinct texts; empty if a class is."""
    amount = lambda yes: F.sum(F.when(F.col("allow") == yes, F.col("n")).otherwise(0))
    counted = grams(labelled.select("text", "n", "allow"), order).groupBy("gram", "size").agg(amount(True).alias("yes"), amount(False).alias("no"))
    counted = materialize(counted, "url-grams")
    # The empty context's followers are the grams of one character: their sums are all positions.
    total = counted.filter("size = 1").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"), F.count(F.lit(1)).alias("characters"))
    front = F.substring("gram", F.lit(1), F.col("size") - 1)
    seen = lambda c: F.count(F.when(F.col(c) > 0, 1))
    contexts = counted.groupBy(front.alias("context")).agg(F.sum("yes").alias("n_yes"), F.sum("no").alias("n_no"), seen("yes").alias("t_yes"), seen("no").alias("t_no"))
    kept = counted.crossJoin(F.broadcast(total)).filter((F.col("all_yes") > 0) & (F.col("all_no") > 0))
    kept = kept.filter((F.col("yes") >= F.col("all_yes") * least) | (F.col("no") >= F.col("all_no") * least))
    kept = materialize(kept.withColumn("context", front).join(contexts, "context"), "url-grams-kept")

    def chance(kind: str, shorter: Column) -> Column:
        n, t = F.col(f"n_{kind}"), F.col(f"t_{kind}")
        return F.when(n + t == 0, shorter).otherwise((F.col(kind) + t * shorter) / (n + t))

    def told(level: DataFrame) -> DataFrame:
        ratio = F.log("p_yes") - F.log("p_no")
        return materialize(level.withColumn("ratio", ratio).withColumn("delta", ratio - F.col("below")).drop("below"), "url-order")

    even = 1.0 / F.col("characters")
    levels = [told(kept.filter("size = 1").select("gram", F.lit(0.0).alias("below"), chance("yes", even).alias("p_yes"), chance("no", even).alias("p_no")))]
    for size in range(2, order + 2):
        shorter = levels[-1].select(F.col("gram").alias("suffix"), F.col("p_yes").alias("s_yes"), F.col("p_no").alias("s_no"), F.col("ratio").alias("below"))
        longer = kept.filter(F.col("size") == size).withColumn("suffix", F.substring("gram", 2, size)).join(shorter, "suffix")
        levels.append(told(longer.select("gram", "below", chance("yes", F.col("s_yes")).alias("p_yes"), chance("no", F.col("s_no")).alias("p_no"))))
    return materialize(reduce(DataFrame.unionByName, levels).select("gram", "delta"), "url-model")


def scored(texts: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, step) of distinct texts: the mean of log ratios over positions, in whole steps; 0 without a model.

    A text's grams are made in one task: partial sums leave about a row for each text before the shuffle.
    """
    given = texts.select("key", "text").withColumn("positions", F.length("text") + 1)
    met = grams(given, order).join(F.broadcast(model), "gram", "left")
    mean = F.round(F.coalesce(F.sum("delta"), F.lit(0.0)) / F.col("positions"), 9)
    limit = F.lit(STEPS * FARTHEST)
    return met.groupBy("key", "positions").agg(mean.alias("mean")).select("key", F.greatest(-limit, F.least(limit, F.floor(F.col("mean") * STEPS))).cast("long").alias("step"))


def threshold(labelled: DataFrame) -> DataFrame:
    """One row: the least step that is allowed, from rows (step, n, allow); 0 where a class is missing.

    Every step is a candidate, a fixed number of rows.
    """
    limit = STEPS * FARTHEST
    amount = lambda yes: F.sum(F.when(F.col("allow") == yes, F.col("n")).otherwise(0))
    bins = labelled.groupBy("step").agg(amount(True).alias("yes"), amount(False).alias("no"))
    steps = labelled.sparkSession.range(-limit, limit + 2, 1, 1).withColumnRenamed("id", "step").join(bins, "step", "left").fillna(0, ["yes", "no"])
    below, whole = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    lost, kept_out = F.coalesce(F.sum("yes").over(below), F.lit(0)), F.coalesce(F.sum("no").over(below), F.lit(0))
    all_yes, all_no = F.sum("yes").over(whole), F.sum("no").over(whole)
    right = (all_yes - lost).cast("double") * all_no + kept_out.cast("double") * all_yes
    return steps.select("step", right.alias("right")).orderBy(F.desc("right"), F.abs("step"), "step").limit(1).select(F.col("step").alias("least"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER, least: float = LEAST_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, allow = longest_rule(rules, F.col("host"), F.col("path"))
    urls = parsed.select("page_id", "host", "path", rule.alias("rule"), allow.alias("allow"), F.concat("host", "path").alias("text"))
    texts = texts_of(urls)
    spare = F.substring("key", 1, 1) < CALIBRATED
    model = trained(texts.filter(F.col("allow").isNotNull() & ~spare), order, least)
    scores = materialize(scored(texts.filter(F.col("allow").isNull() | spare), model, order), "url-scores")
    known = texts.filter(F.col("allow").isNotNull() & spare).select("key", "n", "allow").join(scores, "key")
    cut = F.broadcast(materialize(threshold(known), "url-threshold"))
    verdict = lambda yes: F.when(yes, "allow").otherwise("block").alias("verdict")
    told = urls.filter(F.col("allow").isNotNull() | (F.col("text") == "")).select("page_id", "host", "path", "rule", verdict(F.coalesce("allow", F.lit(True))))
    asked = urls.filter(F.col("allow").isNull() & (F.col("text") != "")).withColumn("key", F.md5("text"))
    found = asked.join(scores, "key", "left").crossJoin(cut)
    return told.unionByName(found.select("page_id", "host", "path", "rule", verdict(F.col("step") >= F.col("least"))))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir, "pages"))


def _rules_sql(value) -> str:
    parts = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {value(r)}" for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))]
    return "CASE " + " ".join(parts) + " END"


def _levels_sql() -> str:
    """One table for each size of gram: chances by both models, interpolated with the next shorter one."""
    share = "CASE WHEN n_{0} + t_{0} = 0 THEN {1} ELSE ({0}s + t_{0} * {1}) / (n_{0} + t_{0}) END"
    out = [f"l1 AS (SELECT gram, 0.0 AS below, {share.format('yes', '1.0 / characters')} AS p_yes, {share.format('no', '1.0 / characters')} AS p_no FROM kept WHERE size = 1)"]
    for k in range(2, ORDER + 2):
        out.append(f"l{k} AS (SELECT k.gram, ln(s.p_yes) - ln(s.p_no) AS below, {share.format('yes', 's.p_yes')} AS p_yes, {share.format('no', 's.p_no')} AS p_no FROM kept k JOIN l{k - 1} s ON s.gram = substr(k.gram, 2) WHERE k.size = {k})")
    return ",\n".join(out)


_LIMIT = STEPS * FARTHEST
OP13_SQL = rf"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (SELECT *, {_rules_sql(lambda r: f"'{r.text}'")} AS rule, {_rules_sql(lambda r: str(r.allow).upper())} AS allow, host || path AS text FROM parsed),
texts AS (
  SELECT text, allow, count(*) AS n, substr(md5(text), 1, 1) < '{CALIBRATED}' AS spare, chr(2) || text || chr(3) AS marked
  FROM urls WHERE text <> '' GROUP BY text, allow),
ends AS (SELECT *, unnest(range(2, length(marked) + 1)) AS fin FROM texts),
sizes AS (SELECT *, unnest(range(1, least({ORDER + 1}, fin) + 1)) AS size FROM ends),
grams AS (SELECT text, allow, n, spare, size, substr(marked, fin - size + 1, size) AS gram FROM sizes),
counted AS (
  SELECT gram, size, sum(CASE WHEN allow THEN n ELSE 0 END)::DOUBLE AS yess, sum(CASE WHEN allow THEN 0 ELSE n END)::DOUBLE AS nos
  FROM grams WHERE allow IS NOT NULL AND NOT spare GROUP BY gram, size),
total AS (SELECT sum(yess) AS all_yes, sum(nos) AS all_no, count(*) AS characters FROM counted WHERE size = 1),
contexts AS (
  SELECT substr(gram, 1, size - 1) AS context, sum(yess) AS n_yes, sum(nos) AS n_no, count(*) FILTER (yess > 0) AS t_yes, count(*) FILTER (nos > 0) AS t_no
  FROM counted GROUP BY 1),
kept AS (
  SELECT c.*, x.* EXCLUDE (context), characters FROM counted c JOIN contexts x ON x.context = substr(c.gram, 1, c.size - 1) CROSS JOIN total
  WHERE all_yes > 0 AND all_no > 0 AND (yess >= all_yes * {LEAST_SHARE!r} OR nos >= all_no * {LEAST_SHARE!r})),
{_levels_sql()},
model AS ({" UNION ALL ".join(f"SELECT gram, ln(p_yes) - ln(p_no) - below AS delta FROM l{k}" for k in range(1, ORDER + 2))}),
scores AS (
  SELECT text, greatest(-{_LIMIT}, least({_LIMIT}, floor(round(coalesce(sum(delta), 0) / (length(text) + 1), 9) * {STEPS}))) AS step
  FROM grams LEFT JOIN model USING (gram) WHERE allow IS NULL OR spare GROUP BY text),
bins AS (
  SELECT step, sum(CASE WHEN allow THEN n ELSE 0 END) AS yes, sum(CASE WHEN allow THEN 0 ELSE n END) AS no
  FROM texts JOIN scores USING (text) WHERE allow IS NOT NULL GROUP BY step),
steps AS (SELECT s.step, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no FROM (SELECT unnest(range(-{_LIMIT}, {_LIMIT} + 2)) AS step) s LEFT JOIN bins ON bins.step = s.step),
told AS (
  SELECT step, (sum(yes) OVER () - coalesce(sum(yes) OVER below, 0)) * sum(no) OVER () + coalesce(sum(no) OVER below, 0) * sum(yes) OVER () AS correct
  FROM steps WINDOW below AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT step AS least_step FROM told ORDER BY correct DESC, abs(step), step LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, step >= least_step, TRUE) THEN 'allow' ELSE 'block' END AS verdict
FROM urls LEFT JOIN scores USING (text) CROSS JOIN cut
"""

QUERIES = {"op13_url_filter": op13_url_filter}
ORACLES = {"op13_url_filter": OP13_SQL}
