"""The operators over their whole tables: one query each, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, hard_negatives, langid, licenses, mixing, simhash, spelling, substrings, token_counts, topk, toxicity, url_filters
from .common import held_out, read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def token_digests(documents: DataFrame) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded text."""
    return bpe.encode_texts(documents, ids="ids", decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, read(spark, sf_dir, "labels"))
    return toxicity.score_texts(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0, 20)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn_from_documents(documents)
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read(spark, sf_dir, "documents"))


def list_history(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages: up to three entries a name, at dates that follow from its hash."""
    names = pages.select(F.explode(url_filters.names_of(url_filters.host_of("url"))).alias("name")).distinct()
    number = lambda n: F.conv(F.substring(F.md5("name"), n, 4), 16, 10).cast("int")
    turns = F.explode(F.sequence(F.lit(0), F.pmod(number(1), F.lit(4)))).alias("turn")
    dated = names.select("name", number(5).alias("first"), number(9).alias("step"), turns).where("turn > 0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("first") + F.col("turn") * (F.col("step") % 90 + 1)) % 365)
    return dated.select("name", day.alias("since"), (F.col("turn") % 2 == 1).alias("listed"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures, fetched one day of 2024 after another."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int"))
    return url_filters.judge(pages.withColumn("fetched_on", day), list_history(pages))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top(read(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0, 5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as anchor; every seventh carries the next label, so that labels and nearness differ."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, F.col("_id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of 31 occurrences of a word, by hash, is first damaged, so that there are variants to find."""
    return spelling.group_variants(read(spark, sf_dir, "documents"), one_in=spelling.DAMAGED)


TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES.items())

QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_toxicity, op4_ann, op5_langid, op6_token_counts, op7_licenses, op8_topk, op9_url_filters, op10_mixing, op11_substrings, op12_hard_negatives, op13_spelling)}

ORACLE = {
    "op12_hard_negatives": """
WITH usable AS (
  SELECT vec_id, min({'v': list_transform(embedding, lambda x: floor(256 * x::DOUBLE)), 'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END}) AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.r.label = c.r.label AS same, list_inner_product(q.r.v, c.r.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.r.v) = len(c.r.v) WHERE q.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank,
    n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
    "op11_substrings": r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM split),
windows AS (
  SELECT * FROM (
    SELECT doc_id, n, spot, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY spot ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS w FROM placed)
  WHERE spot <= n - 19),
again AS (SELECT doc_id, spot FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY w ORDER BY doc_id, spot) AS turn FROM windows) WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, spot + k AS spot FROM again, range(0, 20) steps(k)),
kept AS (
  SELECT doc_id, count(*) AS left_, string_agg(word, ' ' ORDER BY spot) AS words FROM placed p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.spot = p.spot) GROUP BY doc_id)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(k.left_, 0))::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
""",
    "op7_licenses": r"""
WITH passages AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[ \t\r]*\n'), [text])) AS p FROM documents WHERE text IS NOT NULL)),
both_sides AS (
  SELECT 'p' AS side, doc_id, p AS name, p FROM passages
  UNION ALL SELECT 't', NULL, name, p FROM (VALUES """
    + TEMPLATE_ROWS
    + r""") templates(name, p)),
worded AS (SELECT side, doc_id, name, list_filter(string_split_regex(lower(p), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM both_sides),
paired AS (
  SELECT side, doc_id, name, len(w) - 1 AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded WHERE len(w) BETWEEN 2 AND 400),
bags AS (SELECT side, doc_id, name, n, list_transform(g, lambda x, i: x || ' ' || len(list_filter(g[1:i], lambda y: y = x))) AS bag FROM paired),
scored AS (
  SELECT b.doc_id, t.name AS template, b.name AS p, 2.0::DOUBLE * len(list_intersect(b.bag, t.bag)) / (b.n + t.n) AS dice
  FROM bags b JOIN bags t ON b.side = 'p' AND t.side = 't' AND b.n BETWEEN t.n * 0.6 AND t.n * 1.6)
SELECT doc_id, template, max(dice) AS dice, count(DISTINCT p) AS passages FROM scored WHERE dice >= 0.8 GROUP BY doc_id, template
""",
    "op9_url_filters": r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7) % 366)::INT AS fetched_on,
    nullif(regexp_replace(lower(regexp_replace(regexp_replace(
      regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.+$', ''), '') AS host
  FROM pages),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM captures),
asked AS (
  SELECT page_id, url, fetched_on, host, unnest(list_transform(range(1, greatest(len(labels), 2)), lambda n: array_to_string(labels[n:], '.'))) AS name
  FROM labelled WHERE host IS NOT NULL),
names AS (SELECT DISTINCT name, ('0x' || substr(md5(name), 1, 4))::INT AS a, ('0x' || substr(md5(name), 5, 4))::INT AS b, ('0x' || substr(md5(name), 9, 4))::INT AS c FROM asked),
entries AS (
  SELECT name, DATE '2024-01-01' + ((b + turn * (c % 90 + 1)) % 365)::INT AS since, bool_or(turn % 2 = 1) AS listed
  FROM names, (VALUES (1), (2), (3)) turns(turn) WHERE turn <= a % 4 GROUP BY ALL),
valid AS (SELECT *, lead(since) OVER (PARTITION BY name ORDER BY since) AS until FROM entries),
met AS (
  SELECT a.page_id, max_by({'name': v.name, 'listed': v.listed, 'since': v.since}, length(v.name)) AS best
  FROM asked a JOIN valid v ON a.name = v.name AND v.since <= a.fetched_on AND (v.until IS NULL OR a.fetched_on < v.until) GROUP BY a.page_id)
SELECT c.page_id, c.url, c.fetched_on, c.host, coalesce(m.best.listed, false) AS blocked, m.best.name AS entry, m.best.since AS listed_since
FROM captures c LEFT JOIN met m USING (page_id)
""",
    "op8_topk": """
WITH usable AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op10_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sums AS (SELECT source, sum(size)::DOUBLE AS s FROM docs GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sums),
weighed AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS w, 3 * s AS cap, sum(s) OVER () AS budget FROM placed),
ranked AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sharing
  FROM weighed),
targets AS (
  SELECT *, CASE WHEN cap * sharing < w * remaining THEN cap ELSE
    w * max(CASE WHEN NOT cap * sharing < w * remaining THEN remaining END) OVER ()
      / max(CASE WHEN NOT cap * sharing < w * remaining THEN sharing END) OVER () END AS target
  FROM ranked),
queued AS (
  SELECT d.doc_id, d.size, t.s, t.target, t.place, t.budget,
    sum(d.size) OVER (PARTITION BY t.place ORDER BY md5('mix-1|' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) AS done
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT doc_id, size, budget, place, n * s + done AS done, (n * s + done) / target AS finish
  FROM queued, (VALUES (0), (1), (2)) passes(n) WHERE size > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, place, done ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
copies AS (SELECT doc_id, count(*) AS copies FROM run WHERE upto <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size::BIGINT AS size, q.s::BIGINT AS source_size, q.target, (q.size * coalesce(c.copies, 0))::BIGINT AS taken
FROM queued q LEFT JOIN copies c USING (doc_id)
""",
}
