"""Registered queries of the subpackage, one per operator, and their SQL where SQL can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.llm import (
    bpe, fingerprints, html_extraction, jaccard_join, langid, lexical_search, licenses, line_dedup, line_rules, mixing, packing, quality,
    spelling,
)
from gleanmark.llm.frames import documents, prepared

VOCABULARY = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, quality.trained(docs, labels))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = bpe.with_codes(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return docs.select(
        "doc_id",
        F.size(F.col(name).ids).cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col(name).ids).alias("ids_sha256"),
        F.sha2(F.col(name).decoded, 256).alias("decoded_sha256"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar(documents(spark, sf_dir), jaccard_join.Rule(words=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), spans AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS i FROM docs
), shingles AS (
  SELECT DISTINCT doc_id, words[i:i + 3] AS shingle FROM spans
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * same >= 85 * (x.n + y.n - same)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN edges l ON r.other = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN reached r USING (doc_id) GROUP BY d.doc_id, s.n
"""


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(documents(spark, sf_dir))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), line AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM docs
), filled AS (
  SELECT doc_id, source, text, raw,
         regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS line
  FROM line WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), own AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM filled GROUP BY doc_id
), hosts AS (
  SELECT source, count(DISTINCT text) AS n_texts FROM docs GROUP BY source
), frequent AS (
  SELECT f.source, f.line, count(DISTINCT f.text) AS n, any_value(h.n_texts) AS n_texts
  FROM filled f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  GROUP BY f.source, f.line HAVING count(DISTINCT f.text) > 20 AND count(DISTINCT f.text) > 0.1 * any_value(h.n_texts)
), removed AS (
  SELECT f.doc_id, sum(len(f.line)) AS n_boilerplate_words
  FROM filled f JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.line = q.line GROUP BY f.doc_id
), position AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8
), windows AS (
  SELECT doc_id, i, words[i:i + 7] AS span FROM position
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, span) AS n FROM windows
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM twice WHERE n > 1
), repeats AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, len(d.words) AS n_words,
         coalesce(list_sum(list_transform(d.words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(o.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
         coalesce(b.n_boilerplate_words, 0)::BIGINT AS n_boilerplate_words
  FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN removed b USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND NOT (n_words - n_boilerplate_words < 0.3 * n_words) AS kept
FROM counts
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), total AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 2 * source_size AS cap,
         [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM total
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
               ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (
               ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), goals AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM leveled
), placed AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, floor(g.target)::BIGINT AS quota,
         row_number() OVER () AS row,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), needs AS (
  SELECT source, ceil(floor(target) / 256)::BIGINT AS need,
         (sum(ceil(floor(target) / 256)) OVER (ORDER BY source NULLS LAST))::BIGINT AS hi
  FROM goals WHERE floor(target) > 0
), points AS (
  SELECT slot, ((slot % 2147483648) * 1327217885 + (slot // 2147483648) * 7) % 2147483648 / 2147483648::DOUBLE
               * (SELECT sum(need)::BIGINT FROM needs) AS place
  FROM (SELECT unnest(range(0, (SELECT sum(need)::BIGINT FROM needs))) AS slot)
), dealt AS (
  SELECT slot, source, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points JOIN needs ON place >= hi - need AND place < hi
), late AS (
  SELECT n.source, unnest(range(coalesce(d.got, 0), n.need)) AS rank, n.hi - n.need AS lo
  FROM needs n LEFT JOIN (SELECT source, count(*) AS got FROM dealt GROUP BY source) d ON n.source IS NOT DISTINCT FROM d.source
), slots AS (
  SELECT slot, source, rank FROM dealt WHERE rank < need
  UNION ALL
  SELECT (SELECT sum(need)::BIGINT FROM needs) + lo + rank, source, rank FROM late
), passes AS (
  SELECT row, source, quota, size, start + pass * source_size AS begin
  FROM (SELECT *, unnest(range(0, 2)) AS pass FROM placed WHERE size > 0)
), blocks AS (
  SELECT row, source, unnest(range(begin // 256, (least(begin + size, quota) - 1) // 256 + 1)) AS rank
  FROM passes WHERE begin < quota
), found AS (
  SELECT b.row, min(slot) AS first_slot, count(*) AS n_slots
  FROM blocks b JOIN slots s ON b.source IS NOT DISTINCT FROM s.source AND b.rank = s.rank GROUP BY b.row
)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, quota - start)) + least(size, greatest(0, quota - source_size - start)))::BIGINT AS taken,
       first_slot, coalesce(n_slots, 0) AS n_slots
FROM placed LEFT JOIN found USING (row)
"""


OP8_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM rows
), line AS (
  SELECT doc_id, no, lines[no] AS line, regexp_matches(lines[no], '[^\x20\x09-\x0D]') AS filled FROM numbered
), distinct_lines AS (
  SELECT line, row_number() OVER (ORDER BY line) AS node FROM (SELECT DISTINCT line FROM line WHERE filled)
), spans AS (
  SELECT node, line, unnest(range(1, greatest(1, length(line) - 7) + 1)) AS i FROM distinct_lines
), shingles AS (
  SELECT DISTINCT node, substr(line, i, 8) AS shingle FROM spans
), sizes AS (
  SELECT node, count(*) AS n FROM shingles GROUP BY node
), common AS (
  SELECT a.node AS a, b.node AS b, count(*) AS same
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b
  WHERE 100 * same >= 80 * (x.n + y.n - same)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node, node AS other FROM distinct_lines
  UNION
  SELECT r.node, e.b FROM reached r JOIN edges e ON r.other = e.a
), roots AS (
  SELECT node, min(other) AS root FROM reached GROUP BY node
), placed AS (
  SELECT l.doc_id, l.no, l.line, l.filled,
         row_number() OVER (PARTITION BY r.root ORDER BY l.doc_id, l.no) AS nth
  FROM line l LEFT JOIN distinct_lines d ON l.filled AND l.line = d.line LEFT JOIN roots r ON r.node = d.node
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM placed WHERE NOT filled OR nth = 1 GROUP BY doc_id
)
SELECT r.doc_id, coalesce(length(k.text), 0) AS n_chars, sha256(coalesce(k.text, '')) AS text_sha256
FROM rows r LEFT JOIN kept k USING (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identified(docs, langid.train(*langid.labelled_sample(docs)))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT row, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM sizes
), tfs AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, total GROUP BY term
), items AS (
  SELECT DISTINCT item_id, text FROM benchmark
), asked AS (
  SELECT item_id, text, term, count(*) AS r FROM (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items
  ) GROUP BY item_id, text, term
), gains AS (
  SELECT row, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l)) AS gain
  FROM tfs JOIN sizes USING (row), total
), scores AS (
  SELECT a.item_id, a.text, g.row, sum(a.r * w.w * g.gain)::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN gains g USING (term) GROUP BY a.item_id, a.text, g.row
), ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank
  FROM scores JOIN sizes USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "source")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def _crc_table() -> list[int]:
    """Table of the reflected CRC-32 polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run
), coded AS (
  SELECT *, hex(encode(id || ':' || run)) AS h FROM counted
), hashed AS (
  SELECT id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
           lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1]))) AS h
  FROM coded
), written AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, g.rest FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT g.rest, g.word FROM gaps g JOIN words w ON g.rest = w.word
), best AS (
  SELECT x.word, count(*) AS n_near, arg_min(x.near, (-w.n, x.near)) AS form, max(w.n) AS form_n
  FROM near x JOIN words w ON w.word = x.near GROUP BY x.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), path AS (
  SELECT word, form, word AS root FROM forms
  UNION ALL
  SELECT p.word, f.form, f.word FROM path p JOIN forms f ON p.form = f.word
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, p.root
FROM forms f JOIN path p ON p.word = f.word AND p.form IS NULL
"""


QUERIES: dict[str, tuple] = {
    "op1_quality_classifier": (op1_quality_classifier, None),
    "op2_html_extraction": (op2_html_extraction, None),
    "op3_bpe_coding": (op3_bpe_coding, None),
    "op4_jaccard_join": (op4_jaccard_join, OP4_SQL),
    "op5_line_rules": (op5_line_rules, OP5_SQL),
    "op6_license_scan": (op6_license_scan, licenses.scan_sql()),
    "op7_source_mix": (op7_source_mix, OP7_SQL),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_fingerprints": (op10_fingerprints, None),
    "op11_lexical_search": (op11_lexical_search, OP11_SQL),
    "op12_mixture_packing": (op12_mixture_packing, None),
    "op13_spelling_variants": (op13_spelling_variants, OP13_SQL),
}


def queries() -> dict:
    return {name: prepared(query) for name, (query, _sql) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_query, sql) in QUERIES.items() if sql is not None}
