"""The operators as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.llm.exact import exact_groups
from opsweave.llm.html import extract_text
from opsweave.llm.licenses import license_scan
from opsweave.llm.lines import dedup_lines
from opsweave.llm.mixing import mix_sources, rates_by_temperature
from opsweave.llm.order_minhash import as_string, edited_fingerprints
from opsweave.llm.packing import pack
from opsweave.llm.quality import score_quality, train_quality
from opsweave.llm.search import search
from opsweave.llm.simhash import near_groups
from opsweave.llm.tokens import token_counts
from opsweave.llm.toxicity import score_toxicity, train_toxicity
from opsweave.llm.vector_codes import compress, digest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(sql=r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
common AS (SELECT key, max(doc_id) AS first_doc FROM keyed WHERE length(key) >= 40
           GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, coalesce(k.doc_id <> c.first_doc, false) AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return (dedup_lines(documents(spark, folder))
            .select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


@query(sql="""
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM sizes),
terms AS (SELECT source, k, sum(exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - lgamma(k + 1)))
          OVER (PARTITION BY source ORDER BY k) AS c FROM rates, range(0, 96) t(k)),
drawn AS (SELECT d.doc_id, d.source, ('0x' || substr(md5('1:' || d.doc_id || ':1'), 1, 13))::BIGINT / pow(2, 52) AS u
          FROM documents d),
counted AS (SELECT doc_id, count(*) FILTER (t.c <= u) AS n FROM drawn JOIN terms t USING (source) GROUP BY doc_id)
SELECT d.*, i AS mix_copy, round(r.rate, 9) AS mix_rate,
  ('0x' || substr(md5('1:order:' || d.doc_id || ':' || i), 1, 13))::BIGINT / pow(2, 52) AS mix_order
FROM documents d JOIN counted USING (doc_id) JOIN rates r ON r.source = d.source, range(1, 96) t(i) WHERE i <= n""")
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return (mix_sources(docs, rates_by_temperature(docs, power=0.5))
            .withColumn("mix_rate", F.round("mix_rate", 9)))


@query()
def op3_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = edited_fingerprints(documents(spark, folder))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                        as_string(F.col("fingerprint")).alias("fingerprint"),
                        as_string(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))


@query()
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return (extract_text(spark.read.parquet(f"{folder}/pages.parquet"))
            .withColumn("n_chars", F.length("text").cast("long")))


@query()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return (near_groups(documents(spark, folder), words=3, hashes=1, max_bits=2)
            .select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id"))


@query()
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score_quality(docs, train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")))


@query(sql=f"""
WITH rows AS (SELECT doc_id, {ASCII_LOWER} AS content FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY content)""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder))


@query()
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))


@query()
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(documents(spark, folder))


@query(sql=r"""
WITH words AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '),
    lambda w: w <> '') AS w FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)),
docs AS (SELECT doc_id, w, len(w) AS n FROM words WHERE doc_id >= 0 AND len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
asked AS (SELECT -1 - doc_id AS item_id, unnest(w) AS term FROM words WHERE doc_id < 0),
found AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM found, total GROUP BY term, docs),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS score
  FROM found JOIN weight USING (term), total),
scored AS (SELECT item_id, doc_id, sum(score)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20""")
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query()
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def _rounds_sql(rounds: int, entries: int) -> str:
    """Codebook rounds over parts(id, part, x double[]): book0 are the first entries, assignN the nearest entry."""
    near = """assign{n} AS MATERIALIZED (SELECT id, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.id, p.part, p.x, b.entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c)
    + list_inner_product(b.c, b.c) AS d FROM parts p JOIN book{n} b USING (part)) GROUP BY id, part, x)"""
    step = """book{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{o} b LEFT JOIN (
  SELECT part, entry, list(mean ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS mean
    FROM assign{o}, range(1, 17) t(i) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))"""
    first = f"""book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry, x AS c
  FROM parts QUALIFY entry < {entries})"""
    return ",\n".join([first, near.format(n=0)] + [s.format(n=n, o=n - 1) for n in range(1, rounds + 1) for s in (step, near)])


@query(sql=f"""
WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
parts AS MATERIALIZED (SELECT id, part, v[part * 16 + 1 : part * 16 + 16] AS x FROM kept, range(0, 4) t(part)),
{_rounds_sql(4, 256)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assign4 GROUP BY id),
book AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM book4, range(1, 17) t(i))
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (id), book""")
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return coded.withColumn("codebooks_sha256", F.lit(digest(books)))
