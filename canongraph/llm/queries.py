"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canongraph.llm import annsearch, chunkstore, decontam, embdedup, extract, langid, lexsearch, licenses, ngramjoin, packing, prefixtrie, suffixdedup, toxicity
from canongraph.llm.common import fresh_dir, remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is(fold, number: int):
    """Whether a row lies in a fold; one without an id lies in none."""
    return F.coalesce(fold == number, F.lit(False))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", _is(remainder("doc_id", 3), 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _is(remainder("doc_id", 4), 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = fresh_dir(spark, "token-store")
    chunkstore.write_store(_table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return chunkstore.read_digests(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(lexsearch.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


def queries():
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_html_extraction": op6_html_extraction,
        "op7_license_scan": op7_license_scan,
        "op8_decontamination": op8_decontamination,
        "op9_token_store": op9_token_store,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_lexical_search": op11_lexical_search,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_prefix_trie": op13_prefix_trie,
    }


_OP1 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n),
walk AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a)
SELECT w.a AS vec_id, (SELECT count(*) FROM links WHERE links.a = w.a) AS n_links, min(w.b) AS component_id, w.a = min(w.b) AS kept FROM walk w GROUP BY w.a"""

_OP3 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) AS shingle FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w JOIN (SELECT a, min(b) AS component_id FROM walk GROUP BY a) c ON c.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

_OP11 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY r, doc_id, n, term),
g AS (SELECT count(DISTINCT r) AS c, count(*) AS l FROM p),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * c + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c) // l)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN df USING (term), g GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

_OP12 = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

#: The hash of h is worked out bit by bit, as DuckDB has no crc32.
_OP13 = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT conv_id, list({'p': p, 'w': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))} ORDER BY turn NULLS FIRST, p) AS l FROM t GROUP BY conv_id),
h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten([[(ord(x) >> i) & 1 for i in range(8)] for x in string_split(CAST(conv_id AS VARCHAR), '')])),
  lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 4 AS h FROM w),
r AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h], h.l[h + 1:]) AS l FROM h LEFT JOIN w b ON b.conv_id = h.conv_id - h.conv_id % 20),
x AS (SELECT conv_id, unnest(range(0, len(l) + 1)) AS depth, l FROM r),
k AS (SELECT conv_id, depth, sha256(array_to_string([y.p for y in l[1:depth]], ',')) AS k, CASE WHEN depth > 0 THEN sha256(array_to_string([y.p for y in l[1:depth - 1]], ',')) END AS up, CASE WHEN depth > 0 THEN l[depth].w ELSE 0 END AS w, depth = len(l) AS done FROM x),
n AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CASE WHEN done THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends FROM k GROUP BY k, depth),
c AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up, depth),
f AS (SELECT n.*, coalesce(c.n, 0) AS kids FROM n LEFT JOIN c ON c.up = n.k AND c.depth = n.depth),
s AS (SELECT a.k, a.depth, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n_convs - 1) * f.w) AS saved FROM f JOIN k b ON b.k = f.k AND b.depth = f.depth AND b.conv_id = f.conv_id JOIN k a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY a.k, a.depth)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (k, depth) LEFT JOIN n p ON p.k = f.up AND p.depth = f.depth - 1"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables; the others are tested against plain versions."""
    return {"op1_embedding_dedup": _OP1, "op3_ngram_jaccard": _OP3, "op11_lexical_search": _OP11, "op12_nearest_neighbours": _OP12, "op13_prefix_trie": _OP13}
