"""The queries of the subpackage's operators over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lines, pieces, quality, repeats, similar, toxicity, urls, warc

#: The BPE model that op1 uses: HERONRY_PIECES, or the public model that is installed beside the tokenizers.
PIECES = "piece_bpe_32k.model"


def pieces_path() -> str:
    if "HERONRY_PIECES" in os.environ:
        return os.environ["HERONRY_PIECES"]
    found = importlib.util.find_spec("public_tokenizers")
    if found is None:
        raise FileNotFoundError("set HERONRY_PIECES to the file of a SentencePiece model")
    return os.path.join(os.path.dirname(found.origin), PIECES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coded(table(spark, sf_dir, "documents"), pieces_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.super_kmers(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.through(table(spark, sf_dir, "pages"))
    page = F.substring_index("record_id", ":", -1).cast("long").alias("page_id")
    return rows.select(page, "record_id", "url", "chunk_no", "begin", "n_bytes", F.translate(F.base64("chunk"), "\r\n", "").alias("chunk"), "digest", "is_last", "is_valid")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.links(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cleaned(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op8_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cleaned(table(spark, sf_dir, "documents"), passages=True).select("doc_id", "text", "lines_removed")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.suffixes(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.kept(table(spark, sf_dir, "pages"))


#: Words as flat.spans() and flat.LOWER make them.
WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\t\n\x0b\x0c\r ]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, i - 1 AS first_word, array_to_string(ws[i:i + {repeats.WINDOW} - 1], ' ') AS w
      FROM (SELECT *, unnest(range(1, len(ws) - {repeats.WINDOW} + 2)) AS i FROM d)),
r AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT doc_id, first_word, first_word > lag(first_word, 1, -1000000) OVER (PARTITION BY doc_id ORDER BY first_word) + {repeats.WINDOW} AS is_new
      FROM w SEMI JOIN r USING (w)),
s AS (SELECT doc_id, first_word, sum(is_new::INT) OVER (PARTITION BY doc_id ORDER BY first_word) AS k FROM f)
SELECT doc_id, min(first_word)::BIGINT AS first_word, (max(first_word) - min(first_word) + {repeats.WINDOW})::BIGINT AS n_words FROM s GROUP BY doc_id, k
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, ws, len(ws) AS n_words, least({decontaminate.N}, len(ws)) AS size
      FROM (SELECT DISTINCT item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item_id, n_words, size, array_to_string(ws[i:i + size - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, n_words - size + 2)) AS i FROM b)),
bn AS (SELECT item_id, n_words, size, count(*) AS total FROM bg GROUP BY ALL),
dg AS (SELECT doc_id, size, i - 1 AS pos, array_to_string(ws[i:i + size - 1], ' ') AS g
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b))),
hit AS (SELECT doc_id, item_id, n_words, dg.size, pos, g FROM dg JOIN bg USING (size, g)),
win AS (SELECT x.doc_id, x.item_id, x.n_words, x.size, x.pos, count(DISTINCT y.g) AS n
        FROM hit x JOIN hit y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.n_words = y.n_words
             AND y.pos BETWEEN x.pos AND x.pos + x.n_words - x.size GROUP BY ALL),
top AS (SELECT doc_id, item_id, n_words, size, max(n) AS n, arg_min(pos, struct_pack(a := -n, b := pos)) AS first_word FROM win GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS n_shared, total::INTEGER AS n_shingles, round(n / total, 6) AS containment, first_word::BIGINT AS first_word
FROM top JOIN bn USING (item_id, n_words, size) WHERE n >= greatest(1, ceil({decontaminate.THRESHOLD} * total - 1e-9))
"""

OP4 = f"""
WITH p AS (SELECT page_id, url, html, unnest(range(0, greatest(1, (strlen(html) + {warc.CHUNK} - 1) // {warc.CHUNK}))) AS k FROM pages WHERE html IS NOT NULL),
x AS (SELECT page_id, url, k, strlen(html) AS size, hex(encode(html)) AS h FROM p)
SELECT page_id, 'urn:page:' || page_id AS record_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, k::INTEGER AS chunk_no, (k * {warc.CHUNK})::BIGINT AS "begin",
       least({warc.CHUNK}, size - k * {warc.CHUNK})::INTEGER AS n_bytes, base64(unhex(substr(h, k * {2 * warc.CHUNK} + 1, {2 * warc.CHUNK}))) AS chunk,
       sha256(unhex(substr(h, 1, (k + 1) * {2 * warc.CHUNK}))) AS digest, (k + 1) * {warc.CHUNK} >= size AS is_last,
       CASE WHEN (k + 1) * {warc.CHUNK} >= size THEN true END AS is_valid
FROM x
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, ws, least({similar.N}, len(ws)) AS size
           FROM (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, size, array_to_string(ws[i:i + size - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM d)),
n AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY size, gs) AS copy_of
      FROM (SELECT doc_id, size, count(*) AS n, list_sort(list(g)) AS gs FROM g GROUP BY doc_id, size)),
r AS (SELECT doc_id, n FROM n WHERE doc_id = copy_of),
rg AS (SELECT g.* FROM g SEMI JOIN r USING (doc_id)),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM rg x JOIN rg y ON x.g = y.g AND x.size = y.size AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE o >= ceil({similar.THRESHOLD} * (x.n + y.n - o) - 1e-9)),
t AS (SELECT doc_id AS x, doc_id AS root FROM r UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.x),
c AS (SELECT x AS copy_of, min(root) AS class_id FROM t GROUP BY x),
l AS (SELECT a AS copy_of, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, copy_of, coalesce(n_links, 0)::BIGINT AS n_links
FROM (SELECT *, count(*) OVER (PARTITION BY class_id) AS k FROM n JOIN c USING (copy_of) LEFT JOIN l USING (copy_of)) WHERE k > 1
"""

OP8 = f"""
WITH line AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM line),
e AS (SELECT *, (h + {lines.FACTOR} * lag(h, 1, 0) OVER w + {lines.FACTOR**2} * lag(h, 2, 0) OVER w) % {lines.DIVISOR} = 0 AS is_last
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(is_last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
chunk AS (SELECT doc_id, c, min(i) AS b, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, c),
gone AS (SELECT doc_id, c FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, b) AS k FROM chunk WHERE n > 1) WHERE k > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM c ANTI JOIN gone USING (doc_id, c) GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(string_split(d.text, chr(10))) - coalesce(k.n, 0), 0)::INTEGER AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

OP8_PASSAGES = """
WITH line AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM line),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM w WHERE body IS NOT NULL) WHERE k > 1),
gone AS (SELECT doc_id, i FROM again UNION SELECT doc_id, i + 1 FROM again),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(string_split(d.text, chr(10))) - coalesce(k.n, 0), 0)::INTEGER AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_quality_forest": op6_quality_forest,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_line_dedup": op8_line_dedup,
    "op8_line_passages": op8_line_passages,
    "op9_suffix_array": op9_suffix_array,
    "op10_url_filter": op10_url_filter,
}
SQL: dict[str, str] = {"op2_substring_dedup": OP2, "op3_decontaminate": OP3, "op4_warc": OP4, "op7_ngram_jaccard": OP7, "op8_line_dedup": OP8, "op8_line_passages": OP8_PASSAGES, "op9_suffix_array": OP2}
