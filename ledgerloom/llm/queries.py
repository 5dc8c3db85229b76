"""Queries opN_<name> over the synthetic tables, and their SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in runs that get larger (of ids below 4, 16, 36, ...), even runs in a first commit and odd ones in a second, each
    of them compacted; every document is returned with its shard after that."""
    from ._cluster import Scratch
    from .sharding import ShardStore

    store, docs = ShardStore(spark, Scratch(spark, "shards").path), table(spark, sf_dir, "documents")
    run = F.floor(F.sqrt("doc_id") / 2)
    even = F.pmod(F.coalesce(run, F.lit(-1)), F.lit(2)) == 0
    for part in (even, ~even):
        store.append(docs.where(part), run)
        version = store.compact()
        store.vacuum()
    shards = store.manifest(version)
    rows = store.read(version).select("doc_id", "run", "shard", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return rows.join(shards.select("shard", F.col("tier"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes")), "shard")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduplicate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs, outputs=("n_lines", "n_removed", "kept_sha256"), drop_text=True)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import deduplicate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs, outputs=("n_words", "n_removed", "kept_sha256"), drop_text=True)


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._cluster import Scratch
    from .warc import read_archives, write_archives

    index, folder = write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score

    return score(table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mine

    return mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding,
    "op2_line_dedup": line_dedup,
    "op3_decontamination": decontamination,
    "op4_substring_dedup": substring_dedup,
    "op5_warc_archive": warc_archive,
    "op6_nearest_neighbours": nearest_neighbours,
    "op7_byte_bpe": byte_bpe,
    "op8_simhash": simhash,
    "op9_katz_backoff": language_model,
    "op10_toxicity": toxicity,
    "op11_source_divergence": source_divergence,
    "op12_minhash": minhash,
    "op13_collocations": collocations,
}

# one compaction in SQL: what a manifest's shards are merged into
_MERGED = """r{n} AS (SELECT shard, min(run) AS run, sum(b) AS bytes, CAST(floor(ln(greatest(sum(b) / 262144, 1.0)) / ln(4.0) + 1e-9) AS INTEGER) AS tier FROM ({made}) GROUP BY shard),
s{n} AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY tier ORDER BY run, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 67108864 AS bin FROM r{n} WHERE bytes < 67108864 OR bytes > 134217728),
g{n} AS (SELECT tier, bin, greatest(1, sum(bytes) // 67108864) AS pieces, count(*) AS n FROM s{n} GROUP BY ALL),
m{n} AS (SELECT shard, 'v{version}-t' || CAST(tier AS VARCHAR) || '-' || CAST(CAST(bin AS BIGINT) AS VARCHAR) AS name, pieces FROM s{n} JOIN g{n} USING (tier, bin) WHERE n > 1 OR pieces > 1)"""

SQL: dict[str, str] = {
    "op1_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(CAST(floor(sqrt(doc_id) / 2) AS BIGINT), -1) AS run, sha256(coalesce(text, '')) AS text_sha256, coalesce(strlen(text), 0) AS b FROM documents),
{_MERGED.format(n=1, made="SELECT 'v1-run-' || CAST(run AS VARCHAR) AS shard, run, b FROM d WHERE abs(run) % 2 = 0", version=2)},
d2 AS (SELECT doc_id, run, text_sha256, b, CASE WHEN abs(run) % 2 = 1 THEN 'v3-run-' || CAST(run AS VARCHAR) WHEN name IS NULL THEN 'v1-run-' || CAST(run AS VARCHAR) WHEN pieces > 1 THEN name || '.' || CAST(coalesce(doc_id % CAST(pieces AS BIGINT), 0) AS VARCHAR) ELSE name END AS shard FROM d LEFT JOIN m1 ON m1.shard = 'v1-run-' || CAST(run AS VARCHAR) AND abs(run) % 2 = 0),
{_MERGED.format(n=2, made="SELECT shard, run, b FROM d2", version=4)},
o AS (SELECT doc_id, run, text_sha256, b, CASE WHEN name IS NULL THEN d2.shard WHEN pieces > 1 THEN name || '.' || CAST(coalesce(doc_id % CAST(pieces AS BIGINT), 0) AS VARCHAR) ELSE name END AS shard FROM d2 LEFT JOIN m2 ON m2.shard = d2.shard),
z AS (SELECT shard, count(*) AS shard_rows, CAST(sum(b) AS BIGINT) AS shard_bytes, CAST(floor(ln(greatest(sum(b) / 262144, 1.0)) / ln(4.0) + 1e-9) AS INTEGER) AS tier FROM o GROUP BY shard)
SELECT doc_id, run, text_sha256, shard, shard_rows, shard_bytes, tier FROM o JOIN z USING (shard)""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i, w FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
ns AS (SELECT DISTINCT n FROM bs),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, ns WHERE len(w) >= n),
h AS (SELECT dw.r, dw.i, dw.n, bs.item_id FROM dw JOIN bs ON bs.n = dw.n AND bs.s = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM x),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM s),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM o WHERE k > 1 GROUP BY doc_id),
r AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, gone FROM r),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM p LEFT JOIN (SELECT doc_id, unnest(gone) AS i, true AS z FROM g) USING (doc_id, i) WHERE z IS NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r LEFT JOIN k USING (doc_id)""",
    "op5_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT page_id, n, sha1(h) AS d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM k""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT x.lang, source, term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(total) AS n, count(*) AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
      FROM g JOIN gn USING (lang, source) JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= 200""",
    "op12_minhash": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT t.a AS r, min(x.doc_id) AS component_id FROM t JOIN d x ON x.r = t.b GROUP BY t.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op13_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 30),
i AS (SELECT lang, g[s:s + m - 1] AS g, max(a) AS most FROM (SELECT c.*, m, unnest(range(1, k - m + 2)) AS s FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
l AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.g = c.g WHERE most IS NULL OR 100 * most < 80 * a),
u AS (SELECT l.lang, l.g, l.k, a, x.cut, b.f AS l, e.f AS r, (2000000::HUGEINT * a) // (b.f + e.f) AS score FROM l JOIN (SELECT unnest(range(1, 4)) AS cut) x ON cut < l.k JOIN f b ON b.lang = l.lang AND b.g = l.g[1:cut] JOIN f e ON e.lang = l.lang AND e.g = l.g[cut + 1:]),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000""",
}
