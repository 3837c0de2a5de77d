"""The queries of this package: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import collocations, decontaminate, language, language_model, licenses, maxscore, mixing, simhash, token_counts, token_files, topk, toxicity, warc
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


TOP_K_SQL = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5"""


@query("op1_top_k", TOP_K_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


#: The mixture: domains (here the source's number modulo 3), languages in them, sources in those.
WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def tree() -> dict[str, Column]:
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    domain = F.concat(F.lit("domain"), F.coalesce(number % 3, F.lit(0)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def _case(level: str) -> str:
    whens = "".join(f" WHEN {level} = '{name}' THEN {w}" for name, w in WEIGHTS.get(level, {}).items())
    return f"CAST(CASE{whens} ELSE 1 END AS HUGEINT)" if whens else "CAST(1 AS HUGEINT)"


def _mix_sql(percent: int, epochs: int, seed: int) -> str:
    levels = list(mixing.LEVELS)
    steps = []
    for depth, level in enumerate(levels):
        path, above = ", ".join(levels[: depth + 1]), ", ".join(levels[:depth])
        by = f"PARTITION BY {above}" if above else ""
        parent = f"JOIN b{depth} USING ({above})" if above else "CROSS JOIN b0"
        steps.append(f"""n{depth + 1} AS (
    SELECT {path}, w, supply, b, supply / w AS ratio FROM (
        SELECT {path}, {_case(level)} AS w, sum(supply) AS supply FROM leaves GROUP BY {path}
    ) {parent}
),
q{depth + 1} AS (
    SELECT *, supply * (sum(w) OVER ({by}) - coalesce(sum(w) OVER earlier, 0))
              <= (b - coalesce(sum(supply) OVER earlier, 0)) * w AS is_full
    FROM n{depth + 1}
    WINDOW earlier AS ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
r{depth + 1} AS (
    SELECT *, b - coalesce(sum(supply) FILTER (is_full) OVER ({by}), 0) AS left_b,
           sum(w) FILTER (NOT is_full) OVER ({by}) AS left_w,
           coalesce(sum(w) FILTER (NOT is_full) OVER ({by} ORDER BY ratio, {level} ROWS UNBOUNDED PRECEDING), 0) AS upto
    FROM q{depth + 1}
),
b{depth + 1} AS (
    SELECT {path}, CASE WHEN is_full THEN supply
        ELSE (left_b * upto) // left_w - (left_b * (upto - w)) // left_w END AS b
    FROM r{depth + 1}
)""")
    names = ", ".join(levels)
    return f"""WITH texts AS (
    SELECT doc_id, 'domain' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3, 0) AS domain,
           coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens,
           md5(coalesce(text, '')) AS tie
    FROM documents
),
leaves AS (
    SELECT {names}, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) AS HUGEINT) * {epochs} AS supply
    FROM texts GROUP BY {names}
),
b0 AS (SELECT (CAST(sum(supply) AS HUGEINT) // {epochs}) * {percent} // 100 AS b FROM leaves),
{", ".join(steps)},
plan AS (
    SELECT {names}, b // tokens AS whole, b % tokens AS rest FROM b{len(levels)} JOIN leaves USING ({names}) WHERE tokens > 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY {names}, key) AS copy FROM (
        SELECT texts.*, whole, rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) || tie AS key
        FROM texts JOIN plan USING ({names})
    )
),
sums AS (SELECT {names}, key, sum(n_tokens) AS n FROM placed GROUP BY {names}, key),
queue AS (
    SELECT {names}, key, coalesce(sum(n) OVER (PARTITION BY {names} ORDER BY key
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, n FROM sums
)
SELECT doc_id, {names}, CAST(epoch AS INTEGER) AS epoch, n_tokens, n_tokens AS taken
FROM placed, generate_series(0, {epochs} - 1) AS e(epoch) WHERE epoch < whole
UNION ALL
SELECT doc_id, {names}, CAST(whole AS INTEGER), n_tokens, CAST(least(n_tokens, rest - before - (copy - 1) * n_tokens) AS BIGINT)
FROM placed JOIN queue USING ({names}, key) WHERE before + (copy - 1) * n_tokens < rest"""


@query("op2_mix", _mix_sql(60, 3, 1))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), tree(), WEIGHTS)


@query("op3_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_lines(table(spark, sf_dir, "documents"), licenses.train(spark))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = language.train(docs.where(~held_out))
    return language.identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op6_language_model")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    return toxicity.toxicity(docs, toxicity.build(docs, labels.where(~held_out)), held_out)


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = token_files.write_token_files(docs, tokenizer("byte_bpe_50k.json"), fresh_path(spark, "tokens"))
    return token_files.read_token_files(files)


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, tokenizer("word_bpe_49k.json"), fresh_path(spark, "counts"))


COLLOCATIONS_SQL = r"""WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counted AS (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS a
    FROM places, range(1, 6) AS s(size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING a >= 100
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cuts AS (
    SELECT lang, size, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
    FROM counted, range(1, 5) AS c(k) WHERE k < size
),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n,
           (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head
    JOIN counted y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + part - 1], ' ') AS phrase, max(a) AS most
    FROM counted, range(2, 5) AS p(part), range(1, 5) AS o(i) WHERE part < size AND i + part - 1 <= size GROUP BY ALL
),
longer AS (
    SELECT lang, phrase, max(a) FILTER (own = 'left') AS lefts, max(a) FILTER (own = 'right') AS rights FROM (
        SELECT lang, a, 'left' AS own, array_to_string(string_split(phrase, ' ')[2:], ' ') AS phrase FROM counted WHERE size > 2
        UNION ALL
        SELECT lang, a, 'right', array_to_string(string_split(phrase, ' ')[:size - 1], ' ') FROM counted WHERE size > 2
    ) GROUP BY ALL
)
SELECT k.lang, row_number() OVER w AS rank, k.phrase, a, l, r, n, CAST(score AS BIGINT) AS score, lefts, rights
FROM weakest k LEFT JOIN within i ON i.lang = k.lang AND i.phrase = k.phrase LEFT JOIN longer g ON g.lang = k.lang AND g.phrase = k.phrase
WHERE most IS NULL OR 100 * most < 100 * a
WINDOW w AS (PARTITION BY k.lang ORDER BY score DESC, a DESC, k.phrase)
QUALIFY row_number() OVER w <= 2000"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


WARC_SQL = """WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
           min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first FROM pages
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p"""


@query("op12_warc", WARC_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_bundles(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.read_bundles(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


MAXSCORE_SQL = r"""WITH terms AS (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
),
size AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM terms),
tf AS (SELECT d, doc_id, len(t) AS n, unnest(t) AS term FROM terms),
postings AS (SELECT d, doc_id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, size GROUP BY term, docs
),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
scores AS (
    SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term), size GROUP BY item_id, d, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 50"""


@query("op13_ranked_search", MAXSCORE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.ranked(maxscore.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
