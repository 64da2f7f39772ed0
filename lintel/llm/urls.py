"""Operator 3, URL filters: pattern rules indexed by their rarest literal token, DataFrame operations only.

A rule is a regular expression over host and path, with the literal tokens every matching URL must hold. The tokens'
document counts over all URLs choose each rule's rarest token; the rules are listed under it. A URL's tokens fetch
the rules listed under them, and only those run their expression; of the rules that match, the highest rank wins (listed rules
before pattern rules, then the longer one, then the smaller rule_id). A rule without a literal token is listed
under the empty token, which every URL fetches.

Rules come as a table (``rules_of``); ``rule_table`` makes the one in force, some thousands. Rule tables of up to ``max_broadcast`` rows (counted) are broadcast; larger ones are joined by a shuffle on the token, where adaptive
execution splits tokens that many URLs hold.

Defined cases: host is what follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path what follows up to ``? #`` or the end;
both are empty for a null URL or one without ``://``. URLs that no rule matches are allowed. Repeated rows are judged each for
themselves; page_id may be of any type. Other columns of the input are not returned. Of rules with one rule_id any may win. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    action: str  # allow or block
    listed: bool  # listed rules outrank pattern rules and are named in the result
    pattern: str  # over host + path; a host holds no "/"
    tokens: tuple[str, ...]


def _tokens(text: str) -> list[str]:
    return [x for x in re.split("[^A-Za-z0-9]+", text) if x]


def host_rule(name: str, action: str) -> Rule:
    """``example.org/es/``: that host and its subdomains, paths that start so. A token that the path may go on from isn't literal."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    whole = _tokens(path) if not re.search("[A-Za-z0-9]$", path) else _tokens(path)[:-1]
    return Rule(name, action, True, r"^([^/]*\.)?" + re.escape(host).replace(r"\-", "-") + re.escape(path).replace(r"\-", "-"), (*_tokens(host), *whole))


def word_rule(word: str, action: str = "block") -> Rule:
    """Hosts of which a label holds ``word`` between dots and hyphens."""
    return Rule(f"*{word}*", action, False, rf"^([^/]*[.-])?{word}([.-][^/]*)?(/|$)", (word,))


#: The rules in force. Listed rules come first, then patterns of hosts that sell, track or bet: each word alone, and each subject with each form,
#: with a hyphen in either order or written together.
LISTED = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
WORDS = ("casino", "pills", "bets", "ads", "track", "viagra", "poker", "porn", "xxx", "loans", "betting", "slots")
SUBJECTS = (
    "ad", "ads", "banner", "beacon", "bet", "bets", "betting", "bingo", "bonus", "casino", "cams", "cialis", "credit", "crypto", "dating", "debt", "diet", "escort",
    "forex", "gamble", "jackpot", "loan", "loans", "lottery", "meds", "payday", "pharma", "pills", "poker", "porn", "prizes", "replica", "roulette", "slots", "tabs", "viagra",
)
FORMS = ("24", "best", "bonus", "buy", "cash", "cheap", "click", "club", "deal", "direct", "fast", "free", "girls", "hot", "live", "mega", "net", "now", "online", "play", "pro", "sale", "shop", "spin", "store", "top", "track", "vip", "win", "world")
RULES = (*(host_rule(*x) for x in LISTED), *map(word_rule, WORDS))
_MADE = 1000  # the first rule_id of the made rules
RULE_COLUMNS = {"rule_id": "long", "rule": "string", "action": "string", "listed": "boolean", "pattern": "string", "tokens": "array<string>"}


def rules_of(table: DataFrame) -> DataFrame:
    """A rule table of any source in the form ``judge`` takes: rule_id, rule, action, listed, pattern, tokens (null: none known)."""
    return table.select(*(F.col(c).cast(kind).alias(c) for c, kind in RULE_COLUMNS.items())).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES, subjects: tuple[str, ...] = SUBJECTS, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """``rules`` and the rules made of each subject with each form."""
    rows = [F.struct(F.lit(i).cast("long").alias("rule_id"), F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.listed).alias("listed"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens")) for i, r in enumerate(rules)]
    one = spark.range(1, numPartitions=1)
    out = one.select(F.inline(F.array(*rows)))
    if subjects and forms:
        pairs = one.select(F.posexplode(F.array(*map(F.lit, subjects))).alias("i", "a")).select("i", "a", F.posexplode(F.array(*map(F.lit, forms))).alias("j", "b"))
        made = pairs.select("i", "j", F.posexplode(F.array(F.array("a", "b"), F.array("b", "a"), F.array(F.concat("a", "b")))).alias("k", "tokens"))
        name = F.array_join("tokens", "-")
        number = F.lit(_MADE) + (F.col("i") * len(forms) + F.col("j")) * 3 + F.col("k")
        pattern = F.concat(F.lit("^([^/]*[.-])?"), name, F.lit("([.-][^/]*)?(/|$)"))
        out = out.unionByName(made.select(number.cast("long").alias("rule_id"), F.concat(F.lit("*"), name, F.lit("*")).alias("rule"), F.lit("block").alias("action"), F.lit(False).alias("listed"), pattern.alias("pattern"), "tokens"))
    return rules_of(out)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.split(target, "[^A-Za-z0-9]+"))


def index(rules: DataFrame, targets: DataFrame, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, bool]:
    """The rules with the token they are listed under (the one that fewest targets hold; ties: the smallest), and whether they may be broadcast."""
    small = rules.count() <= max_broadcast
    sent = F.broadcast if small else (lambda df: df)
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = targets.select(F.explode(tokens_of(F.col("target"))).alias("token")).join(sent(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    listed = rules.select("rule_id", F.explode("tokens").alias("token")).join(sent(counts), "token", "left")
    rarest = listed.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    out = rules.join(rarest, "rule_id", "left").select("rule_id", "rule", "action", "listed", "pattern", F.coalesce("least.token", F.lit("")).alias("token"))
    rank = F.col("listed").cast("long") * F.lit(1 << 56) + F.char_length("rule").cast("long") * F.lit(1 << 40) - F.col("rule_id")
    return out.withColumn("rank", rank), small


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row: page_id, host, path, rule (a listed rule's name, else null), verdict, matched (the name of whatever rule decided)."""
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("target", F.concat("host", "path"))
    listed, small = index(rules, parsed, max_broadcast)
    # a number of its own for each row, used within this one pass only
    rows = parsed.withColumn("row", F.monotonically_increasing_id())
    wanted = rows.withColumn("token", F.explode(F.array_union(tokens_of(F.col("target")), F.array(F.lit("")))))
    candidates = wanted.join(F.broadcast(listed) if small else listed, "token", "left")
    matches = F.col("pattern").isNotNull() & F.expr("rlike(target, pattern)")
    best = candidates.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(matches, F.struct("rank", "rule", "action", "listed"))).alias("best"))
    return best.select("page_id", "host", "path", F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"), F.col("best.rule").alias("matched"))


def _sql_match(target: str, rule: Rule) -> str:
    return f"regexp_matches({target}, '{rule.pattern}')"


def oracle() -> str:
    """The same judgement for DuckDB: listed rules one by one, the others tried on every target that holds their words."""
    names = sorted((r for r in RULES if r.listed), key=lambda r: -len(r.name))
    when = " ".join(f"WHEN {_sql_match('target', r)} THEN '{r.name}'" for r in names)
    action = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in names)
    single = ", ".join(f"('{w}', {i + len(LISTED)})" for i, w in enumerate(WORDS))
    subjects, forms = (", ".join(f"('{w}', {i})" for i, w in enumerate(words)) for words in (SUBJECTS, FORMS))
    number = f"{_MADE} + (i * {len(FORMS)} + j) * 3"
    return f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
t AS (SELECT *, host || path AS target FROM p),
words(w, id) AS (
  SELECT * FROM (VALUES {single})
  UNION ALL SELECT a || '-' || b, {number} FROM (VALUES {subjects}) s(a, i), (VALUES {forms}) f(b, j)
  UNION ALL SELECT b || '-' || a, {number} + 1 FROM (VALUES {subjects}) s(a, i), (VALUES {forms}) f(b, j)
  UNION ALL SELECT a || b, {number} + 2 FROM (VALUES {subjects}) s(a, i), (VALUES {forms}) f(b, j)),
d AS (SELECT DISTINCT target FROM t),
o AS (
  SELECT target, arg_max('*' || w || '*', length(w) * 1000000 - id) AS other FROM d JOIN words ON contains(target, w)
  WHERE regexp_matches(target, '^([^/]*[.-])?' || w || '([.-][^/]*)?(/|$)') GROUP BY target),
r AS (SELECT t.*, other, CASE {when} END AS rule FROM t LEFT JOIN o USING (target))
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN CASE rule {action} END WHEN other IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(rule, other) AS matched
FROM r"""
