"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, langid, minhash, mixing, ogg, packing, secrets, urls, warc
from .common import table

NEAR_DUPLICATE_WORDS, NEAR_DUPLICATE_PERCENT = 2, 80


#: Rows in an Arrow batch of these applications: Spark's default of 10000 lets a task hold some 100 MB of texts at a time.
BATCH_ROWS = 500


def configure(spark: SparkSession) -> None:
    """The setting that the queries and the pipeline, as applications, give their session. Operators set none and work
    under any; a smaller value that is set already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found, names = mixing.weighed(docs, mixing.probabilities(docs))
    of = lambda k: F.col(names[k])
    return found.select("doc_id", *(of(k).alias(k) for k in ("source", "lang", "topic", "tokens")), F.round(of("prob"), 6).alias("prob"), of("kept").alias("kept"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(says).alias("text"))
    made = chat.format_chat(turns.unionByName(own))
    read = made.select("conv_id", "segments", "formatted", chat.parse_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss"))
    told = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The table has no fetch times: they are derived from page_id, over three years."""
    fetched = F.lit(1640995200) + F.pmod(F.col("page_id") * 7919 * 3600, F.lit(1096 * 86400))
    return pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched"))


#: Dated entries on domains and paths: list, pattern, action, at (seconds).
FIXED_ENTRIES = (
    ("spam", "example.net", "block", 1650000000),
    ("spam", "example.net", "remove", 1680000000),
    ("adult", "example.org", "block", 1700000000),
    ("trusted", "www.example.com", "allow", 1641000000),
    ("spam", "com", "block", 1720000000),
)


def list_entries(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Fixed entries, and for a part of the hosts of ``pages`` a block that is lifted, or allowed, and set again."""
    hosts = pages.select(urls.host_of(F.coalesce("url", F.lit(""))).alias("host")).filter("host <> ''").distinct()
    h = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 7), 16, 10).cast("long")
    start = F.lit(1640995200) + h % 700 * 86400
    step = lambda k, action: F.struct(F.lit("hosts").alias("list"), F.col("host").alias("pattern"), F.lit(action).alias("action"), (start + k * 86400).alias("at"))
    dated = F.explode(F.when(h % 2 == 0, F.array(step(0, "block"), step(90, "remove"), step(300, "block"))).otherwise(F.array(step(0, "allow"), step(200, "block"))))
    own = hosts.filter(h % 3 < 2).select(dated.alias("e")).select("e.*")
    rows = ", ".join(f"('{a}', '{b}', '{c}', {d}L)" for a, b, c, d in FIXED_ENTRIES)
    return own.unionByName(spark.sql(f"SELECT * FROM VALUES {rows} AS t(list, pattern, action, at)"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(captures_of(pages), list_entries(spark, pages)).withColumnRenamed("capture_id", "page_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ogg.decode_media(ogg.encode_texts(table(spark, sf_dir, "documents")))
    size = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(secrets.spans_text(of(*base)).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs, langid.fold() != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), NEAR_DUPLICATE_WORDS, NEAR_DUPLICATE_PERCENT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_packing, op3_chat, op4_fingerprints, op5_urls, op6_warc, op7_ogg, op8_secrets, op9_language, op10_minhash)

    def configured(query: Callable) -> Callable:
        @wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return query(spark, sf_dir)

        return run

    return {f.__name__: configured(f) for f in named}


def _op1_sql(rounds: int = 60, steps: int = 12) -> str:
    """The fit unrolled: each round scales source, language and topic in turn; the budget is then filled in steps."""
    size = "length(coalesce(text, ''))"
    out = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT)) AS tokens,
    CASE WHEN {size} < 400 THEN 'note' WHEN {size} < 2000 THEN 'short' WHEN {size} < 10000 THEN 'article' ELSE 'long' END AS topic
  FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY 1, 2, 3),
w0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) AS w FROM c)"""
    for k, e in mixing.TEMPER.items():
        out += f""",
t_{k} AS MATERIALIZED (SELECT {k}, pow(sum(tokens), {e}) / (SELECT sum(x) FROM (SELECT pow(sum(tokens), {e}) AS x FROM c GROUP BY {k})) AS target FROM c GROUP BY {k})"""
    n = 0
    for _ in range(rounds):
        for k in mixing.TEMPER:
            out += f""",
w{n + 1} AS MATERIALIZED (SELECT a.* REPLACE (w * target / sum(w) OVER (PARTITION BY a.{k}) AS w) FROM w{n} a JOIN t_{k} t ON t.{k} = a.{k})"""
            n += 1
    out += f""",
f0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS f)"""
    for k in range(steps):
        out += f""",
f{k + 1} AS MATERIALIZED (
  SELECT CASE WHEN sum(CASE WHEN f * w < tokens THEN w ELSE 0 END) > 0 THEN
    ((SELECT sum(tokens) FROM c) * {mixing.BUDGET_SHARE} - sum(CASE WHEN f * w >= tokens THEN tokens ELSE 0 END)) / sum(CASE WHEN f * w < tokens THEN w ELSE 0 END)
    ELSE any_value(f) END AS f FROM w{n}, f{k})"""
    draw = f"('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0"
    return out + f"""
SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(least(1, f * w / a.tokens), 6) AS prob, {draw} < least(1, f * w / a.tokens) AS kept
FROM d JOIN w{n} a ON a.source = d.source AND a.lang = d.lang AND a.topic = d.topic, f{steps}
"""


def _op3_sql() -> str:
    marks = {"user": chat.USER, "assistant": chat.ASSISTANT, "system": chat.SYSTEM}
    width = " ".join(f"WHEN '{r}' THEN {sum(map(len, m))}" for r, m in marks.items())
    other = sum(map(len, chat.OTHER)) + len(chat.NAMED)
    escapes = lambda x: " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + {escapes('text')} + CASE WHEN before IS NOT DISTINCT FROM role AND before IS NOT NULL THEN {len(chat.NEXT)}
    ELSE CASE role {width} ELSE {other} + length(role) + {escapes('role')} END END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""


def _op5_sql() -> str:
    fixed = " UNION ALL ".join(f"SELECT '{a}', '{b}', '{c}', {d}" for a, b, c, d in FIXED_ENTRIES)
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    return f"""
WITH p AS (
  SELECT page_id, url, 1640995200 + (page_id * 7919 * 3600) % (1096 * 86400) AS fetched,
    lower(regexp_extract(coalesce(url, ''), '{scheme}(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, lower(regexp_extract(coalesce(url, ''), '{scheme}[^/?#]*(/[^?#]*)', 1)) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS h FROM p WHERE host <> ''),
e(list, k, action, since) AS (
  {fixed}
  UNION ALL SELECT 'hosts', host, CASE h % 2 WHEN 0 THEN 'block' ELSE 'allow' END, 1640995200 + h % 700 * 86400 FROM hosts WHERE h % 3 < 2
  UNION ALL SELECT 'hosts', host, 'remove', 1640995200 + (h % 700 + 90) * 86400 FROM hosts WHERE h % 3 < 2 AND h % 2 = 0
  UNION ALL SELECT 'hosts', host, 'block', 1640995200 + (h % 700 + CASE h % 2 WHEN 0 THEN 300 ELSE 200 END) * 86400 FROM hosts WHERE h % 3 < 2),
i AS (SELECT *, lead(since) OVER (PARTITION BY list, k ORDER BY since) AS until FROM e),
keys AS (
  SELECT DISTINCT page_id, url, fetched, host, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(string_split(host, '.')[n:], '.')),
    CASE WHEN path = '' THEN [] ELSE list_transform(range(1, len(string_split(substr(path, 2), '/')) + 1), lambda n: host || '/' || array_to_string(string_split(substr(path, 2), '/')[:n], '/')) END)) AS k
  FROM p WHERE url IS NOT NULL AND page_id IS NOT NULL),
hit AS (SELECT keys.*, list, action FROM keys JOIN i ON i.k = keys.k AND action <> 'remove' AND since <= fetched AND (until IS NULL OR fetched < until)),
v AS (
  SELECT page_id, list || ':' || k AS decided_by, action, count(*) OVER (PARTITION BY page_id) AS n FROM hit
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(k) DESC, action = 'block' DESC, list DESC, k DESC) = 1)
SELECT p.page_id, url, fetched, host, coalesce(n, 0) AS n_active, decided_by, coalesce(action = 'block', FALSE) AS blocked FROM p LEFT JOIN v ON v.page_id = p.page_id
"""


def oracle_sql() -> dict[str, str]:
    """The other operators need digests, positions or models that SQL lacks; tests hold them against brute force."""
    return {"op1_mixing": _op1_sql(), "op3_chat": _op3_sql(), "op5_urls": _op5_sql()}
