"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm.byte_repeats import delete_repeated_bytes
from tabspark.llm.common import read_table
from tabspark.llm.kd_search import approximate_neighbours
from tabspark.llm.jaccard_join import similar_documents
from tabspark.llm.language import identify_languages, learn_languages
from tabspark.llm.licences import learn_licences, scan_licences
from tabspark.llm.line_runs import delete_repeated_lines
from tabspark.llm.merkle import lowered_leaf, merkle_manifest
from tabspark.llm.mixing import mix_sources
from tabspark.llm.mtree import exact_top_k
from tabspark.llm.packing import pack_documents
from tabspark.llm.prefix_trie import conversation_trie
from tabspark.llm.registry import query
from tabspark.llm.toxicity import labelled_sample, learn_toxicity, score_toxicity
from tabspark.llm.warc import archive_folder, read_warc, write_warc


def fold(n: int):
    """crc32 of the document id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (
  SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id <> h.holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id <> h.holder THEN h.holder END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest AND p.payload_bytes >= 1000
"""


@query("op1_warc", WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    folder = archive_folder(spark)
    manifest = write_warc(read_table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, manifest).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query("op4_neighbours")
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product of every 20th vector."""
    return approximate_neighbours(read_table(spark, sf_dir, "embeddings"))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned on two folds of three; a row without id is in no fold."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(fold(3) != 1))
    found = identify_languages(docs, model)
    return found.select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


MIXING_SQL = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0 / (SELECT count(*) FROM s) * (SELECT sum(n)::DOUBLE FROM s) / n AS rate FROM s),
c AS (
  SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS cdf
  FROM (SELECT source, j, exp(-rate + j * ln(rate) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END) AS p
        FROM r, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS j))),
u AS (
  SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
            / 4503599627370496.0 AS u FROM documents),
k AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*)::INT AS n_copies
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u
  GROUP BY ALL),
e AS (SELECT k.*, unnest(range(1, n_copies + 1))::INT AS copy FROM k)
SELECT *, md5('18:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key FROM e
"""


@query("op8_mixing", MIXING_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that every source weighs the same, shuffled."""
    return mix_sources(read_table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op10_top_k", TOP_K_SQL)
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 largest integer inner products of every 50th vector."""
    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


@query("op9_jaccard")
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component over shingles of five words."""
    return similar_documents(read_table(spark, sf_dir, "documents"))


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its copies of earlier line runs of 50 words or more."""
    return delete_repeated_lines(read_table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned on four folds of five; a row without id is in no fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    labelled = labelled_sample(docs, labels.where(fold(5) != 0))
    found = score_toxicity(docs, learn_toxicity(docs, labelled, label="label"))
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op2_licences")
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in the documents."""
    docs = read_table(spark, sf_dir, "documents")
    return scan_licences(docs, learn_licences(docs), false_alarms=0.002)


LEVELS = 8
#: crc32 of a text's bytes, eight shifts a byte
CRC_SQL = """
  (list_reduce(list_concat([4294967295::UBIGINT], list_transform(
     range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::UBIGINT)),
   lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
     lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""


def unsigned_crc32(text: str) -> str:
    return f"xor({CRC_SQL.format(text)}, 4294967295)"


def merkle_sql() -> str:
    """Trees of at most 16 ** LEVELS leaves, level by level."""

    def field(x: str, text: str) -> str:
        return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        cells = [field(c, f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars")]
        return f"sha256(concat({', '.join(cells)}, {field('text', text)}))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce('=' || source, '-') AS tree, {leaf("text")} AS leaf,
         CASE WHEN {unsigned_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS seen
  FROM documents)""",
        """a0 AS (
  SELECT uid, tree, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d)""",
    ]

    def climb(t: str) -> None:
        for k in range(LEVELS):
            parts.append(f"""{t}{k + 1} AS (
  SELECT tree, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place))
                    ELSE any_value(digest) END AS digest,
         (any_value(n) + 15) // 16 AS n, place // 16 AS place
  FROM {t}{k} GROUP BY tree, place // 16)""")

    climb("a")
    parts.append(f"""b0 AS (
  SELECT '' AS tree, tree AS name, digest, count(*) OVER () AS n,
         row_number() OVER (ORDER BY tree) - 1 AS place FROM a{LEVELS})""")
    climb("b")
    parts.append(f"""p0 AS (
  SELECT d.uid, d.doc_id, d.leaf, d.tree, a0.place, b0.place AS top, '' AS proof, d.seen AS fold
  FROM d JOIN a0 USING (uid) JOIN b0 ON b0.name = d.tree)""")

    def sides(table: str, tree: str, place: str) -> str:
        return f"""
  SELECT v.uid, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < v.{place}), '') AS l,
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > v.{place}), '') AS r,
         any_value(s.n) AS n
  FROM {{before}} v JOIN {table} s ON s.tree = {tree} AND s.place // 16 = v.{place} // 16 GROUP BY v.uid"""

    k = 0
    for t, tree, place in (("a", "v.tree", "place"), ("b", "''", "top")):
        for level in range(LEVELS):
            query_ = sides(f"{t}{level}", tree, place).format(before=f"p{k}")
            parts.append(f"""p{k + 1} AS (
  SELECT p.* REPLACE (p.{place} // 16 AS {place}, proof || l || r AS proof,
                      CASE WHEN x.n > 1 THEN sha256(l || fold || r) ELSE fold END AS fold)
  FROM p{k} p JOIN ({query_}) x USING (uid))""")
            k += 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT p.doc_id, p.leaf, a.digest AS subroot, b.digest AS root, sha256(p.proof) AS proof_sha256,
       p.fold AS folded_root, p.fold = b.digest AS verified
FROM p{k} p JOIN a{LEVELS} a USING (tree) CROSS JOIN b{LEVELS} b"""


@query("op13_merkle", merkle_sql())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and check, a fifth of them after tampering."""
    docs = read_table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    return merkle_manifest(docs, columns=columns, seen=lowered_leaf(docs, columns, "text", fold(5) == 0))


TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations
  WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST,
                       md5(octet_length(encode(x.r)) || ':' || x.r || x.t)) AS own
  FROM t GROUP BY conv_id),
h AS (SELECT *, ({unsigned_crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM o),
s AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM s),
n AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), ''))
           AS ends_sha256
  FROM m GROUP BY ALL),
c AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].t) ELSE 0 END AS saved
  FROM n LEFT JOIN c USING (path)),
a AS (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM f),
u AS (
  SELECT path[1:d] AS path, sum(saved)::BIGINT AS saved_tokens,
         count(*) FILTER (n_children = 0) AS n_leaves FROM a GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves,
       u.saved_tokens, f.ends_sha256
FROM f JOIN u USING (path) LEFT JOIN n p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return conversation_trie(read_table(spark, sf_dir, "conversations"), head)


@query("op11_byte_repeats")
def op11_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a repeated string of 200 bytes covers."""
    found = delete_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
