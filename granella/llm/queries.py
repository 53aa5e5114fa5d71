"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granella.llm import decontamination, fingerprint, lang_id, license_scan, lm_scoring, ngram_join, pii, sentencepiece, token_counts, toxicity
from granella.llm.common import held_out


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(_documents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", held_out().alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.train(docs, labels.filter(~held_out()))
    found = toxicity.score(docs, model, keep=("doc_id", "held_out"))
    worst = F.array_max(F.transform("sentences", lambda x: F.struct(x["score"], -x["start"], x["start"].alias("start"), x["end"].alias("end"))))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_sentences"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "licence", "rule", F.array_join("sentences", ",").alias("sentences"), "start", "end")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.with_spans(_documents(spark, sf_dir).select("doc_id", "text"))
    base = pii.of_kinds(F.col("pii"), pii.BASE)
    count = lambda kind: F.size(pii.of_kinds(F.col("pii"), (kind,))).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *(count(k) for k in pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", held_out())
    model = lang_id.train(docs.filter(~F.col("held_out")))
    return lang_id.identify(docs, model, keep=("doc_id", "held_out"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(_documents(spark, sf_dir))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_toxicity, op3_sentencepiece, op4_license_scan, op5_pii, op6_language_id, op7_token_counts, op8_decontamination, op9_fingerprint, op10_ngram_jaccard_join)}


#: Words as the n-gram operators take them: runs of other characters than ASCII white space, A-Z lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: All rows train, so every n-gram of a text has been seen and nothing backs off.
_OP1 = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
place AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM doc),
tok AS (SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM place),
one AS (SELECT a, count(*) AS n FROM tok GROUP BY a),
two AS (SELECT b, a, count(*) AS n FROM tok WHERE i > 1 GROUP BY b, a),
three AS (SELECT c, b, a, count(*) AS n FROM tok WHERE i > 2 GROUP BY c, b, a),
scored AS (
  SELECT r, ln(CASE WHEN i = 1 THEN one.n / (SELECT sum(n) FROM one) WHEN i = 2 THEN two.n / before.n ELSE three.n / pair.n END) AS s
  FROM tok
  LEFT JOIN one ON one.a = tok.a
  LEFT JOIN one AS before ON before.a = tok.b
  LEFT JOIN two ON two.b = tok.b AND two.a = tok.a
  LEFT JOIN two AS pair ON pair.b = tok.c AND pair.a = tok.b
  LEFT JOIN three ON three.c = tok.c AND three.b = tok.b AND three.a = tok.a
),
total AS (SELECT r, count(*) AS n, sum(s) AS s FROM scored GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(s, 0.0), 6) AS log_score, round(s / n, 6) AS mean_log_score, CAST(0 AS BIGINT) AS n_backoff
FROM doc LEFT JOIN total USING (r)
"""


#: Greedy lengths of a blank and a word's bytes, as hexadecimal digits, step by step; a word that can't be covered has one token.
_OP7 = rf"""
WITH RECURSIVE piece AS (SELECT DISTINCT hex(from_base64(split_part(line, ' ', 1))) AS h FROM read_csv('{token_counts.DEFAULT_VOCABULARY}', columns = {{'line': 'VARCHAR'}}, delim = '\t', header = false, quote = '', escape = '') WHERE line <> ''),
size AS (SELECT DISTINCT len(h) AS n FROM piece),
doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+') AS w FROM documents),
token AS (SELECT r, unnest(w) AS w FROM doc),
rest AS (
  SELECT w, '20' || hex(encode(w)) AS h, 0 AS n FROM (SELECT DISTINCT w FROM token)
  UNION ALL
  SELECT w, substr(h, best + 1), n + 1 FROM (SELECT rest.w, rest.h, rest.n, max(size.n) AS best FROM rest JOIN size ON size.n <= len(rest.h) JOIN piece ON piece.h = substr(rest.h, 1, size.n) WHERE rest.h <> '' GROUP BY rest.w, rest.h, rest.n)
),
length AS (SELECT w, coalesce(max(n) FILTER (WHERE h = ''), 1) AS n FROM rest GROUP BY w),
total AS (SELECT r, count(*) AS words, sum(n) AS tokens FROM token JOIN length USING (w) GROUP BY r)
SELECT doc_id, coalesce(words, 0) AS n_words, CAST(coalesce(tokens, 0) AS BIGINT) AS n_tokens FROM doc LEFT JOIN total USING (r)
"""

#: Links by counting common shingles, classes by carrying the least id along links.
_OP10 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS g FROM doc),
size AS (SELECT doc_id, len(g) AS n FROM grams),
entry AS (SELECT doc_id, unnest(g) AS g FROM grams),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM entry x JOIN entry y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM common JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * common.n >= 75 * (sa.n + sb.n - common.n)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT size.doc_id, size.n AS n_shingles, coalesce(least(least.b, size.doc_id), size.doc_id) AS component_id FROM size LEFT JOIN least ON least.a = size.doc_id
"""


def _op5() -> str:
    """Base kinds by their plain patterns; secrets as whole runs; accounts from each head by the ends that leave 1 modulo 97."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "secret": r"[A-Za-z0-9]+",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN i % 2 = 0 THEN CAST(reverse({digits})[i] AS INT) * 2 - CASE WHEN reverse({digits})[i] > '4' THEN 9 ELSE 0 END ELSE CAST(reverse({digits})[i] AS INT) END FOR i IN generate_series(1, len({digits}))]) % 10 = 0"
    checks = {
        "email": "true",
        "ip": "len(list_filter(str_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS HUGEINT), 0) > 255)) = 0",
        "card": f"CASE WHEN len({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
        "secret": "regexp_full_match(m, 'AKIA[A-Z0-9]{16}|[0-9A-Fa-f]{40}')",
    }

    def scored(kind: str, before: str) -> str:
        return f"{pii.SCORES[kind]} + CASE WHEN regexp_matches({before}, '{pii.UP[kind]}') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches({before}, '{pii.DOWN[kind]}') THEN 0.3 ELSE 0 END >= 0.5"

    parts = []
    for rank, kind in enumerate(pii.KINDS):
        if kind == "iban":
            continue
        keep = checks[kind] + ("" if kind in pii.BASE else f" AND {scored(kind, 'context')}")
        parts.append(
            f"{kind}_m AS (SELECT r, unnest(regexp_extract_all(t, '{plain[kind]}')) AS m, unnest(list_slice(regexp_split_to_array(t, '{plain[kind]}'), 1, len(regexp_extract_all(t, '{plain[kind]}')))) AS g, unnest(generate_series(1, len(regexp_extract_all(t, '{plain[kind]}')))) AS i FROM doc),\n"
            f"{kind}_p AS (SELECT r, m, i, right(g, {pii.NEAR}) AS before, sum(len(g) + len(m)) OVER (PARTITION BY r ORDER BY i) AS z FROM {kind}_m),\n"
        )
        if kind == "secret":  # what stands before goes back to the last key, not to the last run
            parts.append(
                f"secret_k AS (SELECT p.r, m, z, coalesce(lag(z) OVER (PARTITION BY p.r ORDER BY i), 0) AS last FROM secret_p p WHERE {checks[kind]}),\n"
                f"secret_s AS (SELECT k.r, 'secret' AS kind, {rank} AS rank, z - len(m) AS a, z FROM secret_k k JOIN doc USING (r) WHERE {scored('secret', f'right(doc.t[CAST(last AS BIGINT) + 1:CAST(z - len(m) AS BIGINT)], {pii.NEAR})')}),\n"
            )
        else:
            parts.append(f"{kind}_s AS (SELECT r, '{kind}' AS kind, {rank} AS rank, z - len(m) AS a, z FROM {kind}_p WHERE {keep}),\n")
    lengths = " OR ".join(f"(n = {n} AND country IN ({', '.join(repr(c) for c in names.split())}))" for n, names in pii.IBAN_LENGTHS.items())
    return (
        "WITH RECURSIVE doc AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),\n"
        + "".join(parts)
        + f"""head AS (SELECT r, z - len(m) AS a, row_number() OVER (PARTITION BY r ORDER BY z) AS i FROM secret_p WHERE regexp_matches(m, '^[A-Z]{{2}}[0-9]{{2}}')),
candidate AS (SELECT r, a, regexp_extract(doc.t[CAST(a AS BIGINT) + 1:CAST(a AS BIGINT) + 80], '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}[A-Za-z0-9]?') AS run, head.i FROM head JOIN doc USING (r)),
proposed AS (SELECT r, a, run, row_number() OVER (PARTITION BY r ORDER BY a) AS i, coalesce(lag(a) OVER (PARTITION BY r ORDER BY a) + 4, 0) AS last FROM candidate WHERE run <> ''),
ends AS (SELECT r, a, i, last, unnest([array_to_string(str_split(run, ' ')[1:k], ' ') FOR k IN generate_series(1, len(str_split(run, ' ')))]) AS h FROM proposed),
bare AS (SELECT r, a, i, last, h, replace(h, ' ', '') AS s FROM ends),
possible AS (SELECT r, a, i, last, h, len(s) AS n, left(s, 2) AS country FROM bare WHERE len(s) BETWEEN 15 AND 34 AND NOT regexp_matches(s, '[a-z]') AND list_reduce(list_prepend(0, [CAST(CASE WHEN c >= 'A' THEN ord(c) + 45 ELSE ord(c) - 48 END AS BIGINT) FOR c IN str_split(s[5:] || s[1:4], '')]), lambda x, y: CASE WHEN y >= 100 THEN (x * 100 + y - 100) % 97 ELSE (x * 10 + y) % 97 END) = 1),
account AS (SELECT r, a, i, last, arg_max(h, (CASE WHEN {lengths} THEN 1 ELSE 0 END) * 1000 + len(h)) AS h FROM possible GROUP BY r, a, i, last),
numbered AS (SELECT r, a, a + len(h) AS z, last, row_number() OVER (PARTITION BY r ORDER BY a) AS i FROM account),
chosen AS (
  SELECT r, i, z AS free, a, z, last, true AS ok FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.r, n.i, CASE WHEN n.a >= c.free THEN n.z ELSE c.free END, n.a, n.z, n.last, n.a >= c.free FROM chosen c JOIN numbered n ON n.r = c.r AND n.i = c.i + 1
),
iban_s AS (SELECT r, 'iban' AS kind, 4 AS rank, a, z FROM chosen JOIN doc USING (r) WHERE ok AND {scored('iban', f'right(doc.t[CAST(last AS BIGINT) + 1:CAST(a AS BIGINT)], {pii.NEAR})')}),
span AS ({' UNION ALL '.join(f'SELECT * FROM {k}_s' for k in pii.KINDS)}),
joined AS (
  SELECT r, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)},
    string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(z AS BIGINT) AS VARCHAR), ',' ORDER BY a, rank) FILTER (WHERE rank < 4) AS base,
    string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(z AS BIGINT) AS VARCHAR), ',' ORDER BY a, rank) AS spans
  FROM span GROUP BY r
)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN joined USING (r)
"""
    )


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables."""
    return {"op1_lm_scoring": _OP1, "op5_pii": _op5(), "op7_token_counts": _OP7, "op10_ngram_jaccard_join": _OP10}
