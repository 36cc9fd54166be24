"""The ``opN_*`` queries over the given tables, and their DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trafficlens.llm import (bpe, decontaminate, jaccard_join, language_id, lexical_search, merkle_manifest, mixing, quality_crf, substring_dedup, suffix_dedup,
                             token_output, topk_search, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register("op1_substring_dedup", rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS lo FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE lo < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.j) AS t, count(*) AS n
         FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.j = g.j GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


@register("op5_suffix_dedup", r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS g
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE lo < doc_id),
bytes AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS j, h FROM d),
kept AS (SELECT b.doc_id, string_agg(substring(h, 2 * b.j + 1, 2), '' ORDER BY b.j) AS t
         FROM bytes b ANTI JOIN gone g ON b.doc_id = g.doc_id AND b.j = g.j GROUP BY b.doc_id),
spans AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN prev IS NULL OR prev < j - 1 THEN 1 ELSE 0 END) AS k
          FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS prev FROM gone) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s.k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.t, ''))) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN spans s ON d.doc_id = s.doc_id
""")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


@register("op4_mix_sources")
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@register("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@register("op2_topk_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents"))


@register("op3_quality_crf")
def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_token_output")
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialize(table(spark, sf_dir, "documents"), token_output.shared_folder(spark, "op6"))


@register("op10_jaccard_join", rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
""")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@register("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: crc32 of the decimal doc_id: bytes folded into the register, eight shifts each
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda a, b: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""


@register("op11_merkle_manifest", rf"""
WITH RECURSIVE h AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS shown FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
tree AS (SELECT lang, 0 AS level, pos AS idx, leaf AS x, count(*) OVER (PARTITION BY lang) AS n FROM t
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(x, '' ORDER BY idx)), (min(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, idx // 2),
subs AS (SELECT lang, x AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos AS idx, subroot AS x, n FROM subs
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(x, '' ORDER BY idx)), (min(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2),
low AS (SELECT lang, pos, doc_id, leaf, 0 AS level, pos AS idx, shown AS f, '' AS met FROM t
  UNION ALL
  SELECT c.lang, c.pos, c.doc_id, c.leaf, c.level + 1, c.idx // 2,
         sha256(CASE WHEN c.idx % 2 = 1 THEN s.x || c.f ELSE c.f || coalesce(s.x, '') END), c.met || coalesce(s.x, '')
  FROM low c JOIN tree m ON m.lang IS NOT DISTINCT FROM c.lang AND m.level = c.level AND m.idx = c.idx AND m.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.idx = xor(c.idx, 1)),
half AS (SELECT c.*, b.subroot, b.pos AS rank FROM (SELECT *, max(level) OVER (PARTITION BY lang, pos) AS last FROM low) c
  JOIN subs b ON b.lang IS NOT DISTINCT FROM c.lang WHERE c.level = c.last),
high AS (SELECT lang, pos, doc_id, leaf, subroot, 0 AS level, rank AS idx, f, met FROM half
  UNION ALL
  SELECT c.lang, c.pos, c.doc_id, c.leaf, c.subroot, c.level + 1, c.idx // 2,
         sha256(CASE WHEN c.idx % 2 = 1 THEN s.x || c.f ELSE c.f || coalesce(s.x, '') END), c.met || coalesce(s.x, '')
  FROM high c JOIN top m ON m.level = c.level AND m.idx = c.idx AND m.n > 1
  LEFT JOIN top s ON s.level = c.level AND s.idx = xor(c.idx, 1))
SELECT c.doc_id, c.leaf, c.subroot, r.x AS root, sha256(c.met) AS proof_sha256, c.f AS folded_root, c.f = r.x AS verified
FROM high c JOIN top r ON r.n = 1 AND r.level = c.level
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.prove(table(spark, sf_dir, "documents")).drop("lang")


def _terms(table: str, key: str) -> str:
    return rf"""SELECT row_number() OVER () AS r, {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table}"""


@register("op12_lexical_search", rf"""
WITH d AS ({_terms('documents', 'doc_id')}),
i AS ({_terms('benchmark', 'item_id')}),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT r AS item, item_id, term, count(*) AS k FROM (SELECT r, item_id, unnest(w) AS term FROM i) GROUP BY r, item_id, term),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, doc_id, n, term),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * c.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, c GROUP BY term, c.n),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * f.n * c.n) // c.l)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN v USING (term) CROSS JOIN c GROUP BY item, item_id, r, doc_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_documents(table(spark, sf_dir, "documents"), decode=True))
