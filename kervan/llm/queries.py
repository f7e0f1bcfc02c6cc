"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..session import ship_package, table
from .conversation_repair import damaged, repair_report
from .exact_dedup import exact_groups
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import quality_scores
from .repeated_spans import repeated_spans
from .spelling_variants import corpus_words, variant_groups
from .token_counts import token_counts
from .token_output import token_id_roundtrip
from .topk_search import top_k
from .toxicity import toxicity_scores


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return repeated_spans(table(spark, sf_dir, "documents"), span=50)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return top_k(table(spark, sf_dir, "embeddings"), k=10)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_id_roundtrip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return variant_groups(corpus_words(table(spark, sf_dir, "documents"), typo_every=31), ratio=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = table(spark, sf_dir, "conversations")
    return repair_report(rows, damaged(rows))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    kept = dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_repeated_spans": op3_repeated_spans,
    "op4_quality": op4_quality,
    "op5_exact_topk": op5_exact_topk,
    "op6_token_ids": op6_token_ids,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_line_dedup": op13_line_dedup,
}

#: CRC-32 of an ASCII or UTF-8 text, with the table t of the polynomial made by rule.
_CRC_TABLE = """t AS (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n))"""
_CRC = "xor(list_reduce([4294967295] || list_transform(range(1, octet_length(encode({0})) + 1), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i - 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op5_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5('17:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
        w AS (SELECT *, CAST([3, 1, 2][r % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
        o AS (SELECT *, cap / weight AS ratio, sum(cap) OVER q - cap AS cap_before, sum(weight) OVER q - weight AS weight_before,
                     sum(weight) OVER () AS all_weight, CAST(sum(source_size) OVER () AS DOUBLE) AS total
              FROM w WINDOW q AS (ORDER BY cap / weight, r ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT (SELECT level FROM (SELECT (1.5::DOUBLE * total - cap_before) / (all_weight - weight_before) AS level, ratio, r FROM o) WHERE level < ratio ORDER BY ratio, r LIMIT 1) AS level),
        t AS (SELECT source, source_size, least(cap, coalesce(weight * level, cap)) AS target FROM w, l),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
        n AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, round(p.target - p.whole * p.source_size) AS need,
                     sum(d.size) OVER (PARTITION BY d.source, d.h) AS here, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               CAST(whole * size + CASE WHEN need <= 0 OR upto - here >= need THEN 0 WHEN upto <= need THEN size ELSE round(size * ((need - (upto - here)) / here)) END AS BIGINT) AS taken
        FROM n""",
    "op11_spelling_variants": f"""
        WITH {_CRC_TABLE}, r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) AS r FROM documents),
        h AS (SELECT r, n, {_CRC.format("doc_id || ':' || r")} AS h FROM (SELECT doc_id, r, count(*) AS n FROM r WHERE length(r) >= 7 GROUP BY ALL), t),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
        d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
        p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b USING (i, d) WHERE a.word <> b.word
              UNION SELECT d.word, w.word FROM d JOIN w ON d.d = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.d = w.word),
        f AS (SELECT w.word, any_value(w.n) AS n, count(p.b) AS n_near, min(struct_pack(m := -o.n, b := p.b)) FILTER (p.b IS NOT NULL) AS best FROM w LEFT JOIN p ON w.word = p.a LEFT JOIN w o ON o.word = p.b GROUP BY w.word),
        g AS (SELECT word, n, n_near, CASE WHEN -best.m >= 10 * n THEN best.b END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM f),
        c AS (WITH RECURSIVE c AS (SELECT word, word AS pos, 0 AS k FROM g UNION ALL SELECT c.word, g.form, k + 1 FROM c JOIN g ON c.pos = g.word WHERE g.form IS NOT NULL) SELECT word, arg_max(pos, k) AS root FROM c GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM g JOIN c USING (word)""",
    "op12_conversation_repair": f"""
        WITH RECURSIVE {_CRC_TABLE},
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, t),
        b AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS k FROM h WHERE h <> 0),
        o AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, rtrim(text, {_SPACES}) AS bare, substr(role, 1, 1) AS r, row_number() OVER w AS pos, lag(substr(role, 1, 1)) OVER w AS before
              FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
        x AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
        s AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                     count_if(before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM x GROUP BY c),
        n AS (SELECT * FROM (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) n(q, fill, q2)),
        i AS (SELECT q, q AS q2, 0 AS cost, '' AS moves FROM n UNION ALL SELECT q, q2, 5, upper(fill) FROM n
              UNION ALL SELECT a.q, b.q2, 10, upper(a.fill || b.fill) FROM n a JOIN n b ON a.q2 = b.q),
        k AS (SELECT q, q2, 0 AS cost, 'K' AS move, fill AS r, false AS dead FROM n UNION ALL SELECT 0, 1, 0, 'K', 's', false
              UNION ALL SELECT q, q2, 1, fill, NULL, false FROM n UNION ALL SELECT q, q, 2, 'D', NULL, true FROM n),
        e AS (SELECT i.q, k.q2, i.cost + k.cost AS cost, i.moves || k.move AS moves, k.r, k.dead FROM i JOIN k ON i.q2 = k.q),
        p AS (SELECT c, CAST(0 AS BIGINT) AS pos, 0 AS q, struct_pack(cost := CAST(0 AS BIGINT), audit := '', moves := '') AS v FROM s
              UNION ALL SELECT p.c, p.pos + 1, e.q2,
                  min(struct_pack(cost := p.v.cost + e.cost + CASE WHEN x.fault = 'truncated' AND NOT e.dead THEN 5 ELSE 0 END, audit := p.v.audit || translate(e.moves, 'UAua', 'IIRR'), moves := p.v.moves || e.moves))
              FROM p JOIN x ON x.c = p.c AND x.pos = p.pos + 1 JOIN e ON e.q = p.q AND (e.r IS NULL OR e.r = x.r) AND (e.dead OR x.fault IS NULL OR x.fault = 'truncated')
              GROUP BY p.c, p.pos, e.q2),
        l AS (SELECT p.c, min(struct_pack(cost := p.v.cost + i.cost, audit := p.v.audit || translate(i.moves, 'UA', 'II'), moves := p.v.moves || i.moves)) AS v
              FROM p JOIN s ON s.c = p.c AND s.n = p.pos JOIN i ON i.q = p.q AND i.q2 IN (0, 3) GROUP BY p.c),
        m AS (SELECT c, unnest(regexp_extract_all(v.moves || '!', '[UA]*[DKua!]')) AS move, generate_subscripts(regexp_extract_all(v.moves || '!', '[UA]*[DKua!]'), 1) AS pos FROM l),
        z AS (SELECT c, pos, k, CASE g WHEN 'U' THEN 'user:' WHEN 'A' THEN 'assistant:' WHEN 'K' THEN role || ':' || text WHEN 'u' THEN 'user:' || text WHEN 'a' THEN 'assistant:' || text END AS line
              FROM (SELECT m.c, m.pos, x.role, x.text, unnest(string_split(move, '')) AS g, generate_subscripts(string_split(move, ''), 1) AS k FROM m LEFT JOIN x ON x.c = m.c AND x.pos = m.pos) WHERE g NOT IN ('D', '!')),
        y AS (SELECT c, sha256(string_agg(line, chr(10) ORDER BY pos, k)) AS repaired_sha256 FROM z GROUP BY c)
        SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(l.v.cost, 0) AS cost, coalesce(l.v.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c FROM conversations) d LEFT JOIN s USING (c) LEFT JOIN l USING (c) LEFT JOIN y USING (c)""",
    "op13_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, string_split({_LOWERED}, chr(10)) AS lows FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, trim(unnest(lows), {_SPACES}) AS k, unnest(range(len(lines))) AS i FROM d),
        r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        g AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM l LEFT JOIN r ON l.k = r.k)
        SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
}
