"""Queries op1 .. op13 over the whole tables, and their SQL where SQL can say the same."""
from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_code
from . import exact, language, lines, mixing, near, packing, phrases, quality, rules, secrets, spelling, substrings, toxicity
from .text import held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        share_code(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


@_query
def op1_secret_scan(spark, sf_dir):
    return secrets.secrets(_table(spark, sf_dir, "documents"))


@_query
def op2_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@_query
def op3_substring_dedup(spark, sf_dir):
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"), keep_text=False)


@_query
def op4_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs), spans=False)


@_query
def op5_minhash_near_dedup(spark, sf_dir):
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return toxicity.score(rows, toxicity.train(docs, _table(spark, sf_dir, "labels"))).drop("text") \
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@_query
def op7_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", F.size("shards").alias("copies"))


@_query
def op8_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t"""


@_query
def op9_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op10_quality_rules(spark, sf_dir):
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS lines FROM d),
pos AS (SELECT doc_id, unnest(range(1, length(w) - 6)) AS i, w FROM w WHERE length(w) >= 8),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(length(w.w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(lines) - length(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, CAST(length(lines) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_upper FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_upper > 30 * word_chars THEN 32 ELSE 0 END AS BIGINT) AS failures FROM m)
SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f"""


@_query
def op11_line_dedup(spark, sf_dir):
    return lines.deduplicate_lines(_table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT row, doc_id, ls[i] AS line, i FROM (SELECT row, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY row, doc_id"""


@_query
def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


@_query
def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op13_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, len(w) AS words, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT lang, size, w[i:i + size - 1] AS g FROM (SELECT lang, words, w, i, unnest([1, 2, 3, 4]) AS size FROM g) WHERE i + size - 1 <= words),
c AS (SELECT lang, size, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM s GROUP BY lang, size, g HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(words) AS BIGINT) AS n FROM (SELECT lang, len(w) AS words FROM w) GROUP BY lang),
parts AS (SELECT lang, f, g, k, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c WHERE size > 2)),
longer AS (SELECT lang, array_to_string(g[i:i + k - 1], ' ') AS phrase, max(f) AS f FROM parts GROUP BY ALL),
absorbed AS (SELECT c.lang, c.phrase FROM c JOIN longer ON c.lang = longer.lang AND c.phrase = longer.phrase WHERE 100 * longer.f >= 80 * c.f),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(g[1:k], ' ') AS head, array_to_string(g[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c WHERE size > 1)
         WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM absorbed)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (h.f + t.f) AS BIGINT) AS score
           FROM cuts JOIN c h ON h.lang = cuts.lang AND h.phrase = head JOIN c t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT lang, phrase, a, min(score) AS score, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r FROM scored GROUP BY lang, phrase, a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
