"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, exact, language, lines, manifest, media, mixing, pieces, secrets, simhash, toxicity, urls
from .common import table


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Place of a public tokenizer file: under ``lintel.tokenizers`` if the session names a folder, else in the installed package."""
    folder = spark.conf.get("lintel.tokenizers", None)
    if folder:
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_count", "exact_dropped", "near_dropped", F.sha2("text", 256).alias("text_sha256"))


#: Beginnings or endings of 8 characters agree in any two lines of 20 or more that are one edit apart.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT line, min({'d': doc_id, 'p': pos}) AS at, length(line) AS n FROM l WHERE regexp_matches(line, '[^ 	

]') GROUP BY line),
c AS (
  SELECT a.line AS x, a.at AS xa, b.line AS y, b.at AS ya FROM f a JOIN f b ON left(a.line, 8) = left(b.line, 8) AND abs(a.n - b.n) <= 1 AND b.at < a.at WHERE a.n >= 20 AND b.n >= 20
  UNION SELECT a.line, a.at, b.line, b.at FROM f a JOIN f b ON right(a.line, 8) = right(b.line, 8) AND abs(a.n - b.n) <= 1 AND b.at < a.at WHERE a.n >= 20 AND b.n >= 20),
near AS (SELECT DISTINCT x FROM c WHERE levenshtein(x, y) <= 1),
s AS (SELECT l.*, NOT regexp_matches(l.line, '[^ 	

]') AS blank, f.at = {'d': l.doc_id, 'p': l.pos} AS first, near.x IS NOT NULL AS goes
      FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.x = l.line),
g AS (SELECT doc_id, count(*) AS line_count, count(*) FILTER (WHERE NOT blank AND NOT first) AS exact_dropped, count(*) FILTER (WHERE first AND goes) AS near_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE blank OR (first AND NOT goes)), '') AS t FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(line_count, 0) AS line_count, coalesce(exact_dropped, 0) AS exact_dropped, coalesce(near_dropped, 0) AS near_dropped,
  CASE WHEN text IS NOT NULL THEN sha256(t) END AS text_sha256 FROM documents LEFT JOIN g USING (doc_id)"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"), with_pieces=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = language.held_out(folds=4, fold=2)
    learn = docs.select("doc_id", "text").filter(~held).join(labels.filter("toxic is not null"), "doc_id")
    found = toxicity.scored(docs, toxicity.train(learn))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs.filter(~language.held_out())))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table."""
    return labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, domains, _ = mixing.rates(table(spark, sf_dir, "documents").select("doc_id", "text"), domains_of(table(spark, sf_dir, "labels")))
    return found.select("doc_id", "tokens", F.array(*map(F.lit, domains)).alias("domains"), F.transform("p", lambda x: F.round(x, 6)).alias("posteriors"), F.round("rate", 6).alias("rate"), "copies")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


#: A-Z and a-z, for lower-casing these letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    fields = [F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in manifest.FIELDS]
    found = manifest.manifest(table(spark, sf_dir, "documents"), changed=F.when(hit, manifest.leaf(*fields)))
    folded = manifest.folded(F.coalesce("changed", "leaf"), F.col("proof"), F.col("places"), F.col("widths"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_lines, op2_secrets, op3_urls, op4_media, op5_pieces, op6_toxicity, op7_language, op8_exact, op9_mixing, op10_simhash, op11_bytes, op12_divergence, op13_manifest)}

OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT t, count(*) AS group_size, max(points) AS most FROM n GROUP BY t),
m AS (SELECT n.t, min(doc_id) AS keep_id FROM n JOIN k ON n.t = k.t AND n.points = k.most GROUP BY n.t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN k USING (t) JOIN m USING (t)"""

OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
o AS (SELECT lang, source, row, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS v FROM p GROUP BY lang, term),
far AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM (SELECT p.*, 1 + 1000000000::HUGEINT * (l.n + 5) // (total + 5 * v) AS q FROM p JOIN l USING (lang, term) WHERE p.n > 0) WHERE p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""

_FIELDS = ("doc_id", "source", "lang", "n_chars")
_SAID = " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')" for x in _FIELDS)
#: CRC-32 bit by bit: a byte comes in before the first of its eight steps.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda crc, x: xor(xor(crc, x) >> 1, CASE WHEN xor(crc, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT)"""

OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS spot, sha256({_SAID} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_SAID} || coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) END AS changed FROM documents),
n AS (SELECT source, 0 AS level, spot, leaf AS node, count(*) OVER (PARTITION BY source) AS total FROM d
  UNION ALL SELECT source, level + 1, spot // 16, sha256(string_agg(node, '' ORDER BY spot)), any_value((total + 15) // 16) FROM n WHERE total > 1 GROUP BY source, level, spot // 16),
s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot FROM n WHERE total = 1),
t AS (SELECT 0 AS level, spot, subroot AS node, count(*) OVER () AS total FROM s
  UNION ALL SELECT level + 1, spot // 16, sha256(string_agg(node, '' ORDER BY spot)), any_value((total + 15) // 16) FROM t WHERE total > 1 GROUP BY level, spot // 16),
a AS (SELECT row, source, 0 AS level, spot, coalesce(changed, leaf) AS now, '' AS proof FROM d
  UNION ALL SELECT row, a.source, a.level + 1, a.spot // 16, sha256(string_agg(CASE WHEN n.spot = a.spot THEN now ELSE node END, '' ORDER BY n.spot)), proof || coalesce(string_agg(node, '' ORDER BY n.spot) FILTER (n.spot <> a.spot), '')
  FROM a JOIN n ON n.source IS NOT DISTINCT FROM a.source AND n.level = a.level AND n.spot // 16 = a.spot // 16 WHERE total > 1 GROUP BY row, a.source, a.level, a.spot, proof),
b AS (SELECT row, 0 AS level, s.spot, now, proof FROM (SELECT row, source, arg_max(now, level) AS now, arg_max(proof, level) AS proof FROM a GROUP BY row, source) x JOIN s ON s.source IS NOT DISTINCT FROM x.source
  UNION ALL SELECT row, b.level + 1, b.spot // 16, sha256(string_agg(CASE WHEN t.spot = b.spot THEN now ELSE node END, '' ORDER BY t.spot)), proof || coalesce(string_agg(node, '' ORDER BY t.spot) FILTER (t.spot <> b.spot), '')
  FROM b JOIN t ON t.level = b.level AND t.spot // 16 = b.spot // 16 WHERE total > 1 GROUP BY row, b.level, b.spot, proof)
SELECT d.doc_id, leaf, subroot, node AS root, sha256(arg_max(proof, b.level)) AS proof_sha256, arg_max(now, b.level) AS folded_root, arg_max(now, b.level) = node AS verified
FROM d JOIN b USING (row) JOIN s ON s.source IS NOT DISTINCT FROM d.source CROSS JOIN (SELECT node FROM t WHERE total = 1) GROUP BY d.row, d.doc_id, leaf, subroot, node"""

ORACLES: dict[str, str] = {"op1_lines": OP1_SQL, "op3_urls": urls.oracle(), "op8_exact": OP8_SQL, "op12_divergence": OP12_SQL, "op13_manifest": OP13_SQL}
