"""Queries of the page-text operators, and the same results in SQL.

Every query covers whole tables.  SQL texts share the common table expressions below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels
from .functions import text as T
from .operators import geometry, merge, policy, quality, resume
from .plans import pipeline, render
from .sinks import audit_name, output_name, unique_names
from .sources.files import flatten_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _wide(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores is dealt to all of them; one of more, as any large one, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


# ---------------------------------------------------------------- quality of page texts

_LAYERS = """layers AS (
  SELECT layer_id, 'native_text' AS field_name, native_text AS raw FROM choose_best_page_text
  UNION ALL SELECT layer_id, 'ocr_text', ocr_text FROM choose_best_page_text)"""


def _stats_sql(source: str, keys: str, text: str) -> str:
    n = lambda p, t: f"len(regexp_extract_all({t}, '{p}'))"
    return f"""stripped AS (
  SELECT {keys}, coalesce({text}, '') AS t, regexp_replace(coalesce({text}, ''), '^{T.WS}+|{T.WS}+$', '', 'g') AS s FROM {source}),
counted AS (
  SELECT {keys}, t, CAST(length(s) AS BIGINT) AS char_count, regexp_extract_all(s, '{T.NOT_WS}+') AS w,
    {n(T.WS, "t")} AS ws, {n(T.SUSPICIOUS, "t")} AS suspicious, {n(T.LETTER, "t")} AS letters, {n(T.DIGIT, "t")} AS digits FROM stripped),
stats AS (
  SELECT {keys}, char_count, CAST(len(w) AS BIGINT) AS word_count,
    CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest_token,
    CASE WHEN len(w) > 0 THEN CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w) ELSE 0.0 END AS avg_word_len,
    CASE WHEN length(t) > 0 THEN CAST(ws AS DOUBLE) / length(t) ELSE 0.0 END AS whitespace_ratio,
    CASE WHEN char_count > 0 THEN CAST(suspicious AS DOUBLE) / char_count ELSE 0.0 END AS suspicious_ratio,
    CAST(letters AS BIGINT) AS letters, CAST(digits AS BIGINT) AS digits FROM counted)"""


_SCORES = """scored AS (
  SELECT *, CAST(greatest(0, least(100, 100
    - CASE WHEN char_count = 0 THEN 100 WHEN char_count < 30 THEN 45 ELSE 0 END
    - CASE WHEN suspicious_ratio > 0.05 THEN 55 WHEN suspicious_ratio > 0.02 THEN 25 ELSE 0 END
    - CASE WHEN char_count >= 180 AND word_count <= 4 THEN 35 ELSE 0 END
    - CASE WHEN char_count >= 180 AND whitespace_ratio < 0.02 THEN 30 ELSE 0 END
    - CASE WHEN longest_token >= 45 AND word_count <= 8 THEN 25 ELSE 0 END
    - CASE WHEN avg_word_len >= 18 AND word_count >= 4 THEN 18 ELSE 0 END
    - CASE WHEN letters = 0 AND digits > 0 AND char_count > 50 THEN 12 ELSE 0 END)) AS BIGINT) AS quality_score,
    list_filter([
      CASE WHEN char_count = 0 THEN 'sem-texto' END,
      CASE WHEN char_count > 0 AND char_count < 30 THEN 'texto-curto' END,
      CASE WHEN suspicious_ratio > 0.02 THEN 'caracteres-suspeitos' END,
      CASE WHEN char_count >= 180 AND word_count <= 4 THEN 'poucas-palavras' END,
      CASE WHEN char_count >= 180 AND whitespace_ratio < 0.02 THEN 'baixa-separacao' END,
      CASE WHEN longest_token >= 45 AND word_count <= 8 THEN 'token-muito-longo' END,
      CASE WHEN avg_word_len >= 18 AND word_count >= 4 THEN 'palavras-coladas' END,
      CASE WHEN letters = 0 AND digits > 0 AND char_count > 50 THEN 'quase-so-numeros' END], lambda x: x IS NOT NULL) AS flags FROM stats),
judged AS (SELECT *, (char_count = 0 OR quality_score < 55) AS needs_ocr FROM scored)"""

_LAYER_STATS = f"WITH {_LAYERS}, {_stats_sql('layers', 'layer_id, field_name', 'raw')}"
_LAYER_SCORES = f"{_LAYER_STATS}, {_SCORES}"


def _layers(spark: SparkSession, d: str) -> DataFrame:
    pages = _wide(_t(spark, d, "choose_best_page_text").select("layer_id", "native_text", "ocr_text"))
    both = F.explode(F.array(F.struct(F.lit("native_text").alias("f"), F.col("native_text").alias("t")), F.struct(F.lit("ocr_text").alias("f"), F.col("ocr_text").alias("t"))))
    return pages.select("layer_id", both.alias("x")).select("layer_id", F.col("x.f").alias("field_name"), F.col("x.t").alias("text"))


@query(f"{_LAYER_STATS} SELECT layer_id, field_name, char_count, word_count, longest_token, avg_word_len, whitespace_ratio, suspicious_ratio, letters, digits FROM stats")
def page_text_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_statistics(_layers(spark, d), "text").drop("text")


@query(f"{_LAYER_SCORES} SELECT layer_id, field_name, quality_score, needs_ocr FROM judged")
def page_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_quality(_layers(spark, d), "text").select("layer_id", "field_name", "quality_score", "needs_ocr")


@query(f"{_LAYER_SCORES} SELECT layer_id, field_name, unnest(flags) AS flag FROM judged")
def page_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_quality(_layers(spark, d), "text").select("layer_id", "field_name", F.explode("flags").alias("flag"))


@query(f"WITH {_stats_sql('documents', 'doc_id, lang', 'text')}, {_SCORES} SELECT lang, quality_score, count(*) AS pages, CAST(sum(char_count) AS BIGINT) AS chars FROM judged GROUP BY ALL")
def quality_by_lang(spark: SparkSession, d: str) -> DataFrame:
    scored = quality.with_quality(_wide(_t(spark, d, "documents").select("doc_id", "lang", "text")), "text")
    return scored.groupBy("lang", "quality_score").agg(F.count("*").alias("pages"), F.sum("char_count").alias("chars"))


@query(f"{_LAYER_SCORES} SELECT layer_id, field_name, array_to_string(flags, ',') AS flags FROM judged WHERE needs_ocr")
def needs_ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_quality(_layers(spark, d), "text").where("needs_ocr").select("layer_id", "field_name", F.array_join("flags", ",").alias("flags"))


_HINTS = f"""lined AS (
  SELECT layer_id, field_name, list_filter(list_transform(regexp_split_to_array(coalesce(raw, ''), '{T.LINE_END}'),
    lambda x: regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda x: x <> '') AS ls FROM layers),
hinted AS (
  SELECT layer_id, field_name, list_filter([
    CASE WHEN len(list_filter(ls, lambda x: contains(x, chr(9)) OR len(regexp_extract_all(x, ' \\| ')) >= 2)) >= 2 THEN 'table-like' END,
    CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])\\p{{Nd}}{{1,2}}:\\p{{Nd}}{{2}}($|[^\\p{{L}}\\p{{N}}_])'))) >= 2 THEN 'chat-like' END,
    CASE WHEN len(list_filter(ls, lambda x: regexp_matches(lower(x), '(^|[^\\p{{L}}\\p{{N}}_])(anexo|anexa|foto|imagem|print|captura|evid[eê]ncia)($|[^\\p{{L}}\\p{{N}}_])'))) >= 1 THEN 'attachment-mention' END,
    CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^\\p{{Nd}}+[.)-]{T.WS}+{T.NOT_WS}'))) >= 3 THEN 'list-like' END], lambda x: x IS NOT NULL) AS hints FROM lined)"""


@query(f"WITH {_LAYERS}, {_HINTS} SELECT layer_id, field_name, array_to_string(hints, ',') AS hints FROM hinted WHERE len(hints) > 0")
def structure_hints_pages(spark: SparkSession, d: str) -> DataFrame:
    df = T.once(_layers(spark, d), hints=F.array_join(quality.structure_hints(F.col("text")), ","))
    return df.where("hints <> ''").select("layer_id", "field_name", "hints")


_CHAT = "chat AS (SELECT user_id AS layer_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS field_name, string_agg(strftime(ts, '%H:%M') || ' ' || event_type || CASE event_type WHEN 'error' THEN ' print' WHEN 'purchase' THEN ' anexo ' || event_id ELSE '' END, chr(10) ORDER BY ts, event_id) AS raw FROM events GROUP BY 1, 2), layers AS (SELECT * FROM chat)"


@query(f"WITH {_CHAT}, {_HINTS} SELECT layer_id AS user_id, field_name AS day, array_to_string(hints, ',') AS hints FROM hinted")
def structure_hints_chat(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("event_type") == "error", " print").when(F.col("event_type") == "purchase", F.concat(F.lit(" anexo "), F.col("event_id").cast("string"))).otherwise("")
    said = F.concat(F.date_format("ts", "HH:mm"), F.lit(" "), "event_type", tail)
    rows = _t(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.struct("ts", "event_id", said.alias("s")).alias("e"))
    pages = rows.groupBy("user_id", "day").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["s"]), "\n").alias("text"))
    return pages.select("user_id", "day", F.array_join(quality.structure_hints(F.col("text")), ",").alias("hints"))


_SUMMARY = f"coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(coalesce(raw, ''), '^{T.WS}+|{T.WS}+$', '', 'g'), '{T.LINE_END}', ' ', 'g'), 1, 240), '^{T.WS}+|{T.WS}+$', '', 'g'), ''), '<sem texto>')"


@query(f"WITH {_LAYERS} SELECT layer_id, field_name, {_SUMMARY} AS summary, CAST(length(coalesce(raw, '')) AS BIGINT) AS chars FROM layers")
def page_summary_index(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("layer_id", "field_name", quality.summary(F.col("text")).alias("summary"), F.length(T.raw(F.col("text"))).cast("bigint").alias("chars"))


# ---------------------------------------------------------------- labels and details


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


_LABEL = f"CASE WHEN coalesce(source, '') = '' THEN 'Desconhecido' ELSE {_case('source', labels.SOURCES)} END"
_FLAG_LABELS = f"list_transform(coalesce(quality_flags, []), lambda x: {_case('x', labels.FLAGS)})"
_HINT_LABELS = f"list_transform(coalesce(structure_hints, []), lambda x: {_case('x', labels.HINTS)})"
_PERCENT = lambda c: f"printf('%.1f', {c} * 100)"
_DETAIL = f"""concat_ws(' | ', 'Origem: ' || {_LABEL}, 'Qualidade: ' || coalesce(quality_score, 0) || '/100', 'Caracteres: ' || coalesce(char_count, 0),
  CASE WHEN len({_FLAG_LABELS}) > 0 THEN 'Alertas: ' || array_to_string({_FLAG_LABELS}, ', ') END,
  CASE WHEN coalesce(image_count, 0) > 0 THEN 'Imagens detectadas: ' || image_count END,
  CASE WHEN coalesce(image_count, 0) > 0 AND coalesce(image_coverage, 0) <> 0 THEN 'Maior imagem: ' || {_PERCENT("image_coverage")} || '% da página' END,
  CASE WHEN coalesce(ocr_reason, '') <> '' THEN 'Motivo do OCR: ' || ocr_reason END,
  CASE WHEN coalesce(extraction_issue, '') <> '' THEN 'Camada nativa sinalizada como incompleta' END,
  CASE WHEN len({_HINT_LABELS}) > 0 THEN 'Estrutura: ' || array_to_string({_HINT_LABELS}, ', ') END)"""


@query(f"SELECT audit_id, {_LABEL} AS source_label, array_to_string({_FLAG_LABELS}, ', ') AS flag_labels, array_to_string({_HINT_LABELS}, ', ') AS hint_labels, {_DETAIL} AS detail FROM page_audit")
def page_detail_lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    detail = quality.detail_line(c("source"), F.coalesce("quality_score", F.lit(0)), F.coalesce("char_count", F.lit(0)), c("quality_flags"), c("image_count"), c("image_coverage"), c("ocr_reason"), c("extraction_issue"), c("structure_hints"))
    return _t(spark, d, "page_audit").select("audit_id", labels.source_label(c("source")).alias("source_label"), F.array_join(labels.flag_labels(c("quality_flags")), ", ").alias("flag_labels"), F.array_join(labels.hint_labels(c("structure_hints")), ", ").alias("hint_labels"), detail.alias("detail"))


@query(f"SELECT input_file, {_LABEL} AS source_label, count(*) AS pages, count(*) FILTER (image_count > 0) AS with_images, count(*) FILTER (ocr_image_candidate) AS candidates, count(*) FILTER (coalesce(extraction_issue, '') <> '') AS issues FROM page_audit GROUP BY ALL")
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    some = F.coalesce("extraction_issue", F.lit("")) != ""
    return _t(spark, d, "page_audit").groupBy("input_file", labels.source_label(F.col("source")).alias("source_label")).agg(F.count("*").alias("pages"), F.count_if(F.col("image_count") > 0).alias("with_images"), F.count_if("ocr_image_candidate").alias("candidates"), F.count_if(some).alias("issues"))


@query("SELECT lang, count(*) AS documents, CASE WHEN coalesce(lang, '') = '' THEN 'en-US' WHEN regexp_matches(lang, '[-_]') THEN replace(lang, '_', '-') ELSE " + f"CASE lower(trim(split_part(lang, '+', 1))) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.LANGUAGES.items())} ELSE 'en-US' END END AS tag FROM documents GROUP BY ALL")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents")).withColumn("tag", labels.language_tag(F.col("lang")))


# ---------------------------------------------------------------- decisions

_POLICY = "CASE WHEN NOT coalesce(image_count > 0, false) THEN false WHEN image_coverage IS NULL THEN true WHEN image_coverage < 0.025 THEN false WHEN image_coverage >= 0.65 AND coalesce(char_count, 0) >= 900 AND coalesce(quality_score, 0) >= 70 AND NOT coalesce(needs_ocr, false) THEN false ELSE true END"


def _candidate() -> F.Column:
    c = F.col
    return policy.image_needs_ocr(c("image_count") > 0, c("image_coverage"), c("char_count"), c("quality_score"), c("needs_ocr"))


@query(f"SELECT audit_id, {_POLICY} AS candidate FROM page_audit")
def image_ocr_policy(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "page_audit").select("audit_id", _candidate().alias("candidate"))


_COVERAGES = "cov AS (SELECT l_orderkey AS page, list(CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 50 WHEN 1 THEN l_discount ELSE 0.02 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS coverages, CAST(trunc(sum(l_extendedprice) / 100) AS BIGINT) AS char_count, CAST(least(100, 40 + trunc(sum(l_quantity)) % 61) AS BIGINT) AS quality_score FROM lineitem GROUP BY 1), facts AS (SELECT page, list_max(coverages) AS image_coverage, char_count, quality_score, quality_score < 55 AS needs_ocr, CASE WHEN page % 10 = 9 THEN 0 ELSE 1 END AS image_count FROM cov)"


@query(f"WITH {_COVERAGES}, known AS (SELECT * REPLACE (CASE WHEN page % 10 = 8 THEN NULL ELSE image_coverage END AS image_coverage) FROM facts) SELECT page, image_coverage, {_POLICY} AS candidate FROM known")
def image_policy_by_largest(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    cov = F.when(n == 0, F.col("l_quantity") / 50).when(n == 1, F.col("l_discount")).otherwise(F.lit(0.02))
    pages = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(cov).alias("coverages"), F.expr("cast(sum(l_extendedprice) / 100 as bigint)").alias("char_count"), F.expr("cast(least(100, 40 + cast(sum(l_quantity) as bigint) % 61) as bigint)").alias("quality_score"))
    pages = pages.withColumn("needs_ocr", F.col("quality_score") < 55).withColumn("image_count", F.when(F.col("page") % 10 == 9, 0).otherwise(1))
    pages = pages.withColumn("image_coverage", F.when(F.col("page") % 10 == 8, F.lit(None)).otherwise(policy.largest(F.col("coverages"))))
    return pages.select("page", "image_coverage", _candidate().alias("candidate"))


_OVERRIDE = "SELECT audit_id, array_to_string(CASE WHEN coalesce(extraction_issue, '') <> '' THEN list_append(coalesce(quality_flags, []), 'camada-nativa-incompleta') ELSE coalesce(quality_flags, []) END, ',') AS flags, (coalesce(extraction_issue, '') <> '' OR coalesce(needs_ocr, false)) AS needs_ocr FROM page_audit"


@query(_OVERRIDE)
def extraction_issue_override(spark: SparkSession, d: str) -> DataFrame:
    df = policy.with_issue_override(_t(spark, d, "page_audit").select("audit_id", "extraction_issue", F.col("quality_flags").alias("flags"), "needs_ocr"), "extraction_issue")
    return df.select("audit_id", F.array_join("flags", ",").alias("flags"), "needs_ocr")


@query("WITH m AS (SELECT user_id, event_id // 150 AS page_index, 'aviso ' || CAST(floor(value) AS BIGINT) % 3 AS message, min(event_id) AS first_at FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT user_id, page_index, string_agg(message, '; ' ORDER BY first_at, message) AS issue FROM m GROUP BY ALL")
def joined_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").where("event_type = 'error'").select("user_id", F.floor(F.col("event_id") / 150).alias("page_index"), "event_id", F.concat(F.lit("aviso "), (F.floor("value") % 3).cast("string")).alias("message"))
    return policy.joined_issues(rows, ["user_id", "page_index"], "event_id", "message")


_REASON = f"""coalesce(nullif(concat_ws('; ', CASE WHEN force THEN 'OCR integral solicitado' END,
  CASE WHEN candidate THEN CASE WHEN coalesce(image_coverage, 0) <> 0 THEN 'imagem relevante detectada (' || {_PERCENT("image_coverage")} || '% da página)' ELSE 'imagem relevante detectada' END END,
  CASE WHEN coalesce(extraction_issue, '') <> '' THEN 'camada nativa incompleta' END,
  CASE WHEN needs_ocr AND coalesce(extraction_issue, '') = '' THEN 'texto nativo ausente ou de baixa qualidade' END), ''), 'verificação OCR')"""


@query(f"WITH p AS (SELECT a.*, NOT coalesce(f.reliable, true) AS force, {_POLICY} AS candidate FROM page_audit a LEFT JOIN files f ON a.input_file = f.input_path) SELECT audit_id, force, candidate, {_REASON} AS reason FROM p WHERE force OR needs_ocr OR candidate")
def ocr_page_selection(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "files").select(F.col("input_path").alias("input_file"), (~F.coalesce("reliable", F.lit(True))).alias("force"))
    df = _t(spark, d, "page_audit").join(files, "input_file", "left").withColumn("force", F.coalesce("force", F.lit(False))).withColumn("candidate", _candidate())
    why = policy.ocr_reason(F.col("force"), F.col("candidate"), F.col("image_coverage"), F.col("extraction_issue"), F.col("needs_ocr"))
    return df.where("force or needs_ocr or candidate").select("audit_id", "force", "candidate", why.alias("reason"))


_PROFILE = """SELECT file_id, p.name AS profile_name, p.batch AS render_batch_size, p.pages AS page_spill_threshold, p.chars AS char_spill_threshold, p.dpi AS ocr_dpi FROM (
  SELECT file_id, CASE WHEN n <= 250 THEN {'name': 'pequeno', 'batch': 50, 'pages': 250, 'chars': 2000000, 'dpi': dpi} WHEN n <= 2000 THEN {'name': 'grande', 'batch': 32, 'pages': 120, 'chars': 1000000, 'dpi': dpi}
    WHEN n <= 5000 THEN {'name': 'muito-grande', 'batch': 24, 'pages': 80, 'chars': 750000, 'dpi': dpi} ELSE {'name': 'gigante', 'batch': 16, 'pages': 50, 'chars': 500000, 'dpi': dpi} END AS p
  FROM (SELECT file_id, greatest(0, coalesce(page_count, 0)) AS n, greatest(300, least(450, coalesce(nullif(profile.ocr_dpi, 0), 300))) AS dpi FROM files))"""


@query(_PROFILE)
def processing_profile(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "files").select("file_id", policy.profile(F.col("page_count"), F.col("profile.ocr_dpi")).alias("p"))
    return df.select("file_id", F.col("p.name").alias("profile_name"), "p.render_batch_size", "p.page_spill_threshold", "p.char_spill_threshold", "p.ocr_dpi")


_BATCHES = """due AS (SELECT DISTINCT user_id AS file_id, event_id // 150 AS page_index FROM events WHERE event_type IN ('error', 'click', 'view')),
runs AS (SELECT *, page_index - row_number() OVER (PARTITION BY file_id ORDER BY page_index) AS run FROM due),
batches AS (SELECT *, CAST((row_number() OVER (PARTITION BY file_id, run ORDER BY page_index) - 1) // 4 AS BIGINT) AS batch FROM runs)"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    due = _t(spark, d, "events").where(F.col("event_type").isin("error", "click", "view")).select(F.col("user_id").alias("file_id"), F.floor(F.col("event_id") / 150).alias("page_index")).distinct()
    return policy.plan_batches(due, 4)


@query(f"WITH {_BATCHES} SELECT file_id, page_index, CAST(run AS BIGINT) AS run, batch FROM batches")
def contiguous_batches(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d).select("file_id", "page_index", "run", "batch")


@query("WITH due AS (SELECT DISTINCT file_id, page_index FROM choose_best_page_text WHERE ocr_text IS NOT NULL), runs AS (SELECT *, page_index - row_number() OVER (PARTITION BY file_id ORDER BY page_index) AS run FROM due) SELECT file_id, page_index, CAST(run AS BIGINT) AS run, CAST((row_number() OVER (PARTITION BY file_id, run ORDER BY page_index) - 1) // 16 AS BIGINT) AS batch FROM runs")
def ocr_batches(spark: SparkSession, d: str) -> DataFrame:
    due = _t(spark, d, "choose_best_page_text").where("ocr_text is not null").select("file_id", "page_index").distinct()
    return policy.plan_batches(due, 16).select("file_id", "page_index", "run", "batch")


@query(f"WITH {_BATCHES}, g AS (SELECT file_id, run, batch, list(page_index ORDER BY page_index) AS pages FROM batches GROUP BY ALL) SELECT file_id, page, 'imagem ' || i AS image FROM (SELECT file_id, unnest(pages[1:n]) AS page, unnest(range(n)) AS i FROM (SELECT *, len(pages) - CASE WHEN run % 3 = 0 AND len(pages) > 1 THEN 1 ELSE 0 END AS n FROM g))")
def batch_render_zip(spark: SparkSession, d: str) -> DataFrame:
    g = _batches(spark, d).groupBy("file_id", "run", "batch").agg(F.sort_array(F.collect_list("page_index")).alias("pages"))
    short = (F.size("pages") - F.when((F.col("run") % 3 == 0) & (F.size("pages") > 1), 1).otherwise(0)).cast("int")
    images = F.transform(F.sequence(F.lit(0), short - 1), lambda i: F.concat(F.lit("imagem "), i.cast("string")))
    return g.select("file_id", F.explode(policy.zip_rendered(F.col("pages"), images)).alias("z")).select("file_id", "z.page", "z.image")


# ---------------------------------------------------------------- positions

_SEQ = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
_BLOCKS = f"""blocks AS (SELECT l_orderkey AS page, CAST(595 AS DOUBLE) AS w, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 300 ELSE 50 END + l_partkey % 20 AS DOUBLE) AS x0,
  CAST(l_linenumber * 30 + l_suppkey % 10 AS DOUBLE) AS y0, {_SEQ} AS seq FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0, seq) AS r, coalesce(x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, seq), 0) AS gap FROM blocks),
gaps AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, max(gap) OVER (PARTITION BY page) AS most FROM ranked),
cuts AS (SELECT *, min(CASE WHEN gap = most AND most > 0 THEN r END) OVER (PARTITION BY page) AS cut FROM gaps),
cols AS (SELECT *, coalesce(cut IS NOT NULL AND w > 0 AND most >= w * CAST(0.18 AS DOUBLE) AND cut - 1 >= 2 AND n - cut + 1 >= 2, false) AS two FROM cuts),
placed AS (SELECT *, CASE WHEN two AND r >= cut THEN 1 ELSE 0 END AS column_no FROM cols)"""


def _seq(d: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    return d.withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("l_linenumber") % 2 == 0, 300).otherwise(50) + F.col("l_partkey") % 20
    return _seq(_t(spark, d, "lineitem")).select(F.col("l_orderkey").alias("page"), F.lit(595.0).alias("page_width"), x.cast("double").alias("x0"), (F.col("l_linenumber") * 30 + F.col("l_suppkey") % 10).cast("double").alias("y0"), "seq")


@query(f"WITH {_BLOCKS} SELECT page, bool_or(two) AS two_columns, count(*) FILTER (column_no = 1) AS right_blocks FROM placed GROUP BY 1")
def column_detection(spark: SparkSession, d: str) -> DataFrame:
    df = geometry.columns_of(_blocks(spark, d), ["page"])
    return df.groupBy("page").agg(F.bool_or("two_columns").alias("two_columns"), F.count_if(F.col("column_no") == 1).alias("right_blocks"))


@query(f"WITH {_BLOCKS} SELECT page, seq, CAST(row_number() OVER (PARTITION BY page ORDER BY column_no, round(y0, 1), round(x0, 1), CASE WHEN two THEN r ELSE seq END) AS INTEGER) AS reading_no FROM placed")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return geometry.order_blocks(_blocks(spark, d), ["page"]).select("page", F.col("seq").cast("bigint").alias("seq"), "reading_no")


_WORDS = f"""boxes AS (SELECT l_orderkey AS page, l_suppkey % 2 + 1 AS block, 1 AS par, l_linenumber % 3 + 1 AS line, l_linenumber * 70 + l_partkey % 37 AS "left",
  (l_linenumber % 3 + 1) * 40 + l_suppkey % 5 AS top, 8 * length(l_returnflag || l_linestatus) + CAST(l_quantity AS BIGINT) % 60 AS width,
  round(l_discount * 1000) AS conf, l_returnflag || l_linestatus AS txt, {_SEQ} AS seq FROM lineitem),
kept AS (SELECT * FROM boxes WHERE conf <> 0),
spaced AS (SELECT *, "left" - lag("left" + width) OVER l AS gap, greatest(CAST(8 AS DOUBLE), CAST(sum(width) OVER g AS DOUBLE) / greatest(1, sum(greatest(1, length(txt))) OVER g)) AS avg,
    row_number() OVER l AS place FROM kept WINDOW l AS (PARTITION BY page, block, par, line ORDER BY "left", top, seq), g AS (PARTITION BY page, block, par, line)),
words AS (SELECT *, CASE WHEN gap IS NULL THEN '' WHEN gap >= greatest(CAST(24 AS DOUBLE), avg * 7) THEN ' | ' WHEN gap >= greatest(CAST(10 AS DOUBLE), avg * 3) THEN '  ' ELSE ' ' END AS sep FROM spaced)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    df = _seq(_t(spark, d, "lineitem")).withColumn("txt", F.concat("l_returnflag", "l_linestatus")).withColumn("line", c("l_linenumber") % 3 + 1)
    return df.select(c("l_orderkey").alias("page"), (c("l_suppkey") % 2 + 1).alias("block"), F.lit(1).alias("par"), "line", (c("l_linenumber") * 70 + c("l_partkey") % 37).alias("left"), (c("line") * 40 + c("l_suppkey") % 5).alias("top"), (F.length("txt") * 8 + c("l_quantity").cast("bigint") % 60).alias("width"), F.round(c("l_discount") * 1000).cast("string").alias("conf"), "txt", "seq")


@query(f"WITH {_WORDS} SELECT page, seq, sep FROM words")
def ocr_word_separators(spark: SparkSession, d: str) -> DataFrame:
    return geometry.separators(_boxes(spark, d), ["page", "block", "par", "line"]).select("page", F.col("seq").cast("bigint").alias("seq"), "sep")


@query(f"WITH {_WORDS}, lines AS (SELECT page, block, par, line, min(top) AS top, min(\"left\") AS lft, min(seq) AS s, string_agg(sep || txt, '' ORDER BY place) AS line_text FROM words GROUP BY 1, 2, 3, 4) SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY top, lft, s) AS INTEGER) AS line_no, line_text FROM lines")
def ocr_line_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    return geometry.rebuild_lines(_boxes(spark, d), ["page"])


_OPS = f"""ops AS (SELECT l_orderkey AS page, {_SEQ} AS seq, ['q', 'cm', 'Do', 'Q'][l_suppkey % 4 + 1] AS op, abs(CAST(l_quantity * 10 AS DOUBLE) * (l_partkey % 40 + 1)) AS f FROM lineitem)"""


@query(
    f"WITH RECURSIVE {_OPS}, "
    """walk AS (
  SELECT page, CAST(0 AS BIGINT) AS seq, CAST(1 AS DOUBLE) AS scale, CAST([] AS DOUBLE[]) AS stack, CAST([] AS DOUBLE[]) AS outp FROM (SELECT DISTINCT page FROM ops)
  UNION ALL
  SELECT w.page, o.seq,
    CASE WHEN o.op = 'Q' AND len(w.stack) > 0 THEN w.stack[-1] WHEN o.op = 'cm' THEN w.scale * o.f ELSE w.scale END,
    CASE WHEN o.op = 'q' THEN list_append(w.stack, w.scale) WHEN o.op = 'Q' AND len(w.stack) > 0 THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END,
    CASE WHEN o.op = 'Do' THEN list_append(w.outp, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), w.scale / 500990))) ELSE w.outp END
  FROM walk w JOIN ops o ON o.page = w.page AND o.seq = w.seq + 1)
SELECT page, CAST(len(outp) AS BIGINT) AS images, coalesce(list_max(outp), CAST(0 AS DOUBLE)) AS largest, coalesce(list_sum(outp), CAST(0 AS DOUBLE)) AS total FROM (SELECT page, arg_max(outp, seq) AS outp FROM walk GROUP BY page)"""
)
def image_coverage_fold(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    op = F.element_at(F.array(*map(F.lit, ("q", "cm", "Do", "Q"))), (c("l_suppkey") % 4 + 1).cast("int"))
    scale = geometry.matrix_scale((c("l_quantity") * 10).cast("double"), F.lit(0.0), F.lit(0.0), (c("l_partkey") % 40 + 1).cast("double"))
    ops = _seq(_t(spark, d, "lineitem")).groupBy(c("l_orderkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct("seq", op.alias("op"), scale.alias("scale")))).alias("ops"))
    out = ops.select("page", geometry.coverage_fold(c("ops"), F.lit(500990.0)).alias("o"))
    return out.select("page", F.size("o").cast("bigint").alias("images"), F.coalesce(F.array_max("o"), F.lit(0.0)).alias("largest"), F.aggregate("o", F.lit(0.0), lambda a, x: a + x).alias("total"))


_CELLS = f"cells AS (SELECT l_orderkey AS t, {_SEQ} AS r, unnest([1, 2, 3]) AS c, unnest([' ' || l_linenumber || '  x ', CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || chr(10) || l_linestatus]) AS txt FROM lineitem)"


@query(f"WITH {_CELLS}, rows_ AS (SELECT t, r, regexp_replace(string_agg(trim(regexp_replace(txt, '\\s+', ' ', 'g')), chr(9) ORDER BY c), '^\\s+|\\s+$', '', 'g') AS row FROM cells GROUP BY 1, 2) SELECT t AS table_id, string_agg(row, chr(10) ORDER BY r) AS text FROM rows_ WHERE row <> '' GROUP BY 1")
def docx_table_flatten(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    parts = F.array(F.concat(F.lit(" "), c("l_linenumber").cast("string"), F.lit("  x ")), F.when(c("l_linenumber") % 2 == 0, "").otherwise(c("l_returnflag")), F.concat(c("l_quantity").cast("bigint").cast("string"), F.lit("\n"), c("l_linestatus")))
    cells = _seq(_t(spark, d, "lineitem")).select(c("l_orderkey").alias("table_id"), c("seq").alias("r"), F.posexplode(parts).alias("c", "txt"))
    return flatten_tables(cells, ["table_id"], "r", "c", "txt")


# ---------------------------------------------------------------- reconciling layers


def _simple(t: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"


_BOTH = f"""both_ AS (SELECT layer_id, native_text, ocr_text, {_simple("native_text")} AS flat FROM choose_best_page_text WHERE native_text IS NOT NULL AND ocr_text IS NOT NULL),
split AS (SELECT layer_id, flat, list_filter(list_transform(regexp_split_to_array(ocr_text, '{T.LINE_END}'), lambda x: regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda x: x <> '') AS ls FROM both_),
ocr_lines AS (SELECT layer_id, flat, line_no, norm FROM (SELECT layer_id, flat, unnest(range(len(ls))) AS line_no, {_simple("unnest(ls)")} AS norm FROM split) WHERE norm <> '')"""


def _both(spark: SparkSession, d: str) -> DataFrame:
    return _wide(_t(spark, d, "choose_best_page_text").where("native_text is not null and ocr_text is not null").select("layer_id", "native_text", "ocr_text"))


@query(f"WITH {_BOTH} SELECT layer_id, CAST(line_no AS INTEGER) AS line_no, norm, (norm = flat OR (length(norm) >= 8 AND contains(flat, norm)) OR (length(replace(norm, ' ', '')) >= 12 AND contains(replace(flat, ' ', ''), replace(norm, ' ', '')))) AS contained FROM ocr_lines")
def line_containment(spark: SparkSession, d: str) -> DataFrame:
    return merge.contained(_both(spark, d), ["layer_id"], "native_text", "ocr_text", T.simple_normal)  # the form its SQL fixes


@query(
    f"""WITH {_BOTH}, a AS (SELECT layer_id, line_no, len(string_split(norm, ' ')) AS tokens, unnest(range(len(string_split(norm, ' ')))) AS i, unnest(string_split(norm, ' ')) AS w FROM ocr_lines),
b AS (SELECT layer_id, unnest(range(len(string_split(flat, ' ')))) AS j, unnest(string_split(flat, ' ')) AS w FROM both_),
met AS (SELECT a.layer_id, line_no, i, j - i AS d FROM a JOIN b ON a.layer_id = b.layer_id AND a.w = b.w AND b.w <> ''),
g AS (SELECT *, i - row_number() OVER (PARTITION BY layer_id, line_no, d ORDER BY i) AS g FROM met),
runs AS (SELECT layer_id, line_no, max(n) AS run FROM (SELECT layer_id, line_no, d, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL)
SELECT l.layer_id, CAST(l.line_no AS INTEGER) AS line_no, CAST(l.tokens AS BIGINT) AS tokens, CAST(coalesce(run, 0) AS BIGINT) AS run FROM (SELECT DISTINCT layer_id, line_no, tokens FROM a) l LEFT JOIN runs r ON l.layer_id = r.layer_id AND l.line_no = r.line_no"""
)
def longest_token_run(spark: SparkSession, d: str) -> DataFrame:
    return merge.token_runs(_both(spark, d), ["layer_id"], "native_text", "ocr_text", T.simple_normal)  # the form its SQL fixes


@query(
    f"""WITH {_BOTH}, a AS (SELECT layer_id, w, count(*) AS n FROM (SELECT layer_id, unnest(string_split({_simple("ocr_text")}, ' ')) AS w FROM both_) WHERE w <> '' GROUP BY ALL),
b AS (SELECT layer_id, w, count(*) AS n FROM (SELECT layer_id, unnest(string_split(flat, ' ')) AS w FROM both_) WHERE w <> '' GROUP BY ALL)
SELECT a.layer_id, CAST(sum(a.n) AS BIGINT) AS tokens, CAST(sum(least(a.n, coalesce(b.n, 0))) AS BIGINT) AS shared FROM a LEFT JOIN b ON a.layer_id = b.layer_id AND a.w = b.w GROUP BY 1"""
)
def token_multiset_overlap(spark: SparkSession, d: str) -> DataFrame:
    return merge.bag_overlap(_both(spark, d), ["layer_id"], "native_text", "ocr_text", T.simple_normal)  # the form its SQL fixes


@query()
def line_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    return merge.similar_lines(_both(spark, d), ["layer_id"], "native_text", "ocr_text")


@query()
def merge_layers(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("layer_id", merge.merge_udf("native_text", "ocr_text").alias("merged"))


@query()
def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    df = _wide(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return df.select("doc_id", "line_no", merge.normal_udf("line").alias("norm")).where("norm <> ''")


@query()
def reconciled_pages(spark: SparkSession, d: str) -> DataFrame:
    out = merge.reconcile(_wide(_t(spark, d, "choose_best_page_text").select("layer_id", "native_text", "native_analysis", "ocr_text", "ocr_analysis", "force_ocr", "preserve_both")))
    return out.select("layer_id", "source", F.length("text").alias("chars"), F.col("analysis.quality_score").alias("quality_score"))


_STRIPPED = lambda c: f"(regexp_replace(coalesce({c}, ''), '^{T.WS}+|{T.WS}+$', '', 'g') <> '')"


@query(
    f"""WITH p AS (SELECT layer_id, {_STRIPPED("native_text")} AS hn, {_STRIPPED("ocr_text")} AS ho, coalesce(force_ocr, false) AS f, coalesce(preserve_both, false) AS k, coalesce(native_analysis.quality_score, 0) AS ns, coalesce(ocr_analysis.quality_score, 0) AS os,
  coalesce(native_analysis.char_count, 0) AS nc, coalesce(ocr_analysis.char_count, 0) AS oc, coalesce(native_analysis.needs_ocr, false) AS bad FROM choose_best_page_text)
SELECT layer_id, CASE WHEN (f OR k) AND hn AND ho THEN 'nativo+ocr' WHEN f THEN CASE WHEN ho THEN 'ocr' ELSE 'nativo' END WHEN NOT hn AND ho THEN 'ocr' WHEN hn AND NOT ho THEN 'nativo' WHEN NOT hn THEN 'sem-texto'
  WHEN bad THEN 'ocr' WHEN os >= ns + 10 AND oc >= greatest(20, CAST(trunc(nc * CAST(0.55 AS DOUBLE)) AS BIGINT)) THEN 'ocr' WHEN oc > CAST(trunc(nc * CAST(1.35 AS DOUBLE)) AS BIGINT) AND os + 3 >= ns THEN 'ocr' ELSE 'nativo' END AS source FROM p"""
)
def choose_best_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    pick = merge.chosen_source(c("native_text"), c("native_analysis"), c("ocr_text"), c("ocr_analysis"), c("force_ocr"), c("preserve_both"))
    return _t(spark, d, "choose_best_page_text").select("layer_id", pick.alias("source"))


# ---------------------------------------------------------------- state and outputs


@query("SELECT DISTINCT f.file_id, c.page_index FROM choose_best_page_text c JOIN files f ON c.file_id = f.file_id WHERE NOT EXISTS (SELECT 1 FROM page_audit a WHERE a.input_file = f.input_path AND a.page = c.page_index + 1)")
def checkpoint_pending(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "files").select("file_id", F.col("input_path").alias("input_file"))
    pages = _t(spark, d, "choose_best_page_text").select("file_id", "page_index").distinct().join(files, "file_id")
    done = _t(spark, d, "page_audit").select("input_file", (F.col("page") - 1).alias("page_index"))
    return resume.pending(pages, done, ["input_file", "page_index"]).select("file_id", "page_index")


@query("""SELECT file_id, substr(sha256(input_path), 1, 20) AS file_key, sha256(concat_ws(chr(10), input_path, CAST(byte_length AS VARCHAR), CAST(epoch_us(mtime) AS VARCHAR), '{"dpi": 300, "lang": "por"}', '3')) AS fingerprint FROM files""")
def checkpoint_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _t(spark, d, "files").select("file_id", resume.file_key(c("input_path")).alias("file_key"), resume.fingerprint(c("input_path"), c("byte_length"), F.unix_micros(c("mtime").cast("timestamp")), {"lang": "por", "dpi": 300}).alias("fingerprint"))


@query("WITH t AS (SELECT file_id, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.[^./]*$', '') AS stem, input_path FROM files), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY lower(input_path), file_id) AS k FROM t) SELECT file_id, CASE WHEN k = 1 THEN stem || '.md' ELSE stem || '_' || k || '.md' END AS name FROM n")
def unique_output_names(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "files").select("file_id", F.lower("input_path").alias("_o"), output_name(F.regexp_extract("rel_path", "([^/]*)$", 1), ".md").alias("target"))
    return unique_names(df, "target", ["_o", "file_id"]).select("file_id", "name")


def _final(spark: SparkSession, d: str) -> DataFrame:
    """The audit as final pages: one per file and page, the latest record of it, the summary as its text."""
    from pyspark.sql import Window as W

    latest = F.row_number().over(W.partitionBy("input_file", "page").orderBy(F.desc("audit_id")))
    df = _t(spark, d, "page_audit").where("input_file is not null").withColumn("_r", latest).where("_r = 1").drop("_r")
    return df.withColumn("file_id", F.col("input_file")).withColumn("file_name", F.regexp_extract("input_file", "([^/]*)$", 1)).withColumn("text", F.col("summary")).withColumn("raw_chars", F.col("char_count"))


_FINAL = "final AS (SELECT *, input_file AS file_id, regexp_extract(input_file, '([^/]*)$', 1) AS file_name FROM page_audit WHERE input_file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY input_file, page ORDER BY audit_id DESC) = 1)"


@query(f"WITH {_FINAL} SELECT input_file, page, coalesce(summary, '') AS summary, CAST(coalesce(char_count, 0) AS BIGINT) AS char_count, source, {_LABEL} AS source_label, CAST(coalesce(quality_score, 0) AS BIGINT) AS quality_score, array_to_string(coalesce(quality_flags, []), ',') AS quality_flags, array_to_string(coalesce(structure_hints, []), ',') AS structure_hints, coalesce(needs_ocr, false) AS needs_ocr, CAST(coalesce(image_count, 0) AS BIGINT) AS image_count, coalesce(image_coverage, 0.0) AS image_coverage, coalesce(ocr_image_candidate, false) AS ocr_image_candidate, extraction_issue, ocr_reason FROM final")
def page_audit_records(spark: SparkSession, d: str) -> DataFrame:
    out = render.audit_records(_final(spark, d))
    return out.withColumn("quality_flags", F.array_join("quality_flags", ",")).withColumn("structure_hints", F.array_join("structure_hints", ","))


def _index_sql(fmt: str) -> str:
    sep, lead = (", ", "- Página ") if fmt == "md" else (" | ", "Página ")
    return f"""'{lead}' || page || ' [' || {_LABEL} || '{sep}qualidade ' || coalesce(quality_score, 0) || '/100' || CASE WHEN len({_FLAG_LABELS}) > 0 THEN '{sep}alertas: ' || array_to_string({_FLAG_LABELS}, ', ') ELSE '' END
  || CASE WHEN len({_HINT_LABELS}) > 0 THEN '{sep}estrutura: ' || array_to_string({_HINT_LABELS}, ', ') ELSE '' END || ']: ' || coalesce(summary, '') || chr(10)"""


def _sections_sql(fmt: str, own_file: bool) -> str:
    nl = "chr(10)"
    head = f"SELECT file_id, 0 AS part, 0 AS page, '{'# ' if own_file else '# Arquivo: '}' || min(file_name) || {nl} AS body FROM final GROUP BY 1"
    if fmt == "md":
        counts = f"(SELECT file_id, string_agg('- ' || label || ': ' || n || {nl}, '' ORDER BY label) AS labels FROM (SELECT file_id, {_LABEL} AS label, count(*) AS n FROM final GROUP BY ALL) GROUP BY 1)"
        parts = [
            head,
            f"""SELECT t.file_id, 1, 0, {nl} || '## Resumo da extração' || {nl} || {nl} || '- Páginas processadas: ' || n || {nl} || '- Páginas com elementos gráficos detectados: ' || wi || {nl} || '- Páginas com imagens relevantes para OCR: ' || ca || {nl}
  || CASE WHEN iss > 0 THEN '- Páginas com camada nativa incompleta recuperadas por OCR: ' || iss || {nl} ELSE '' END || labels
  FROM (SELECT file_id, count(*) AS n, count(*) FILTER (image_count > 0) AS wi, count(*) FILTER (ocr_image_candidate) AS ca, count(*) FILTER (coalesce(extraction_issue, '') <> '') AS iss FROM final GROUP BY 1) t JOIN {counts} c ON t.file_id = c.file_id""",
            f"SELECT file_id, 2, 0, {nl} || '## Índice' || {nl} || {nl} FROM final GROUP BY 1",
        ]
        page = f"'## Página ' || page || {nl} || {nl} || '> ' || {_DETAIL} || {nl} || {nl} || coalesce(summary, '') || {nl} || {nl}"
    else:
        parts = [] if own_file else [f"SELECT file_id, 0 AS part, 0 AS page, '=== ARQUIVO: ' || min(file_name) || ' ===' || {nl} AS body FROM final GROUP BY 1"]
        parts.append(f"SELECT file_id, 2 AS part, 0 AS page, 'ÍNDICE (resumo por página)' || {nl} || '------------------------------' || {nl} AS body FROM final GROUP BY 1")
        page = f"'=== Página ' || page || ' ===' || {nl} || '[Meta] ' || {_DETAIL} || {nl} || coalesce(summary, '') || {nl} || {nl}"
    parts += [f"SELECT file_id, 3, page, {_index_sql(fmt)} FROM final", f"SELECT file_id, 4, 0, {nl} FROM final GROUP BY 1", f"SELECT file_id, 5, page, {page} FROM final"]
    return " UNION ALL ".join(parts)


@query(f"WITH {_FINAL} SELECT file_id, part, CAST(page AS BIGINT) AS page, body FROM ({_sections_sql('md', True)})")
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return render.render(_final(spark, d), "md")


@query(f"WITH {_FINAL} SELECT file_id, part, CAST(page AS BIGINT) AS page, body FROM ({_sections_sql('txt', True)})")
def render_txt(spark: SparkSession, d: str) -> DataFrame:
    return render.render(_final(spark, d), "txt")


@query(
    f"""WITH {_FINAL}, s AS ({_sections_sql("md", False)}) SELECT 1 AS ordinal, file_id, part, CAST(page AS BIGINT) AS page, body FROM s
UNION ALL SELECT 1, file_id, 9, 0, chr(10) || '---' || chr(10) || chr(10) FROM final GROUP BY file_id
UNION ALL SELECT 0, '', 0, 0, '# Relatório compilado' || chr(10) || chr(10) || '- Gerado em: 2024-01-01' || chr(10) || '- Total de arquivos: ' || count(DISTINCT file_id) || chr(10) || chr(10) FROM final"""
)
def compiled_report(spark: SparkSession, d: str) -> DataFrame:
    return render.compile_report(_final(spark, d), "2024-01-01", "md")


@query("WITH p AS (SELECT file_id, count(*) AS pages, bool_or(length(regexp_replace(coalesce(native_text, ''), '\\s', '', 'g')) > 0 OR length(regexp_replace(coalesce(ocr_text, ''), '\\s', '', 'g')) > 0) AS some FROM choose_best_page_text GROUP BY 1) SELECT f.file_id, CASE WHEN p.pages IS NULL THEN 'sem paginas' WHEN NOT p.some THEN 'sem texto' ELSE 'ok' END AS state FROM files f LEFT JOIN p ON f.file_id = p.file_id")
def file_any_text(spark: SparkSession, d: str) -> DataFrame:
    some = merge.has_text(F.col("native_text")) | merge.has_text(F.col("ocr_text"))
    pages = _t(spark, d, "choose_best_page_text").groupBy("file_id").agg(F.count("*").alias("pages"), F.bool_or(some).alias("some"))
    return _t(spark, d, "files").select("file_id").join(pages, "file_id", "left").select("file_id", F.when(F.col("pages").isNull(), "sem paginas").when(~F.col("some"), "sem texto").otherwise("ok").alias("state"))


@query("SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (coalesce(status, 'failed') <> 'ok') AS failed, CAST(CASE WHEN count(*) FILTER (coalesce(status, 'failed') <> 'ok') > 0 THEN 2 ELSE 0 END AS BIGINT) AS exit_code FROM results")
def batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    return render.outcome(_t(spark, d, "results"))


@query("SELECT f.file_id, f.ext, r.run_id, coalesce(r.status, 'failed') AS status, coalesce(r.failure, CASE WHEN r.run_id IS NULL THEN 'Nenhum resultado' END) AS failure, array_to_string(coalesce(r.warnings, []), '; ') AS warnings FROM files f LEFT JOIN results r ON f.input_path = r.input_path")
def results_by_file(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "results").select("input_path", "run_id", "status", "failure", "warnings")
    df = _t(spark, d, "files").select("file_id", "ext", "input_path").join(r, "input_path", "left")
    return df.select("file_id", "ext", "run_id", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("failure", F.when(F.col("run_id").isNull(), "Nenhum resultado")).alias("failure"), F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), "; ").alias("warnings"))


@query("WITH p AS (SELECT input_file, page, row_number() OVER (PARTITION BY input_file ORDER BY page) AS k, count(*) OVER (PARTITION BY input_file) AS n FROM (SELECT DISTINCT input_file, page FROM page_audit WHERE coalesce(extraction_issue, '') <> '')) SELECT input_file, string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) || CASE WHEN max(n) > 8 THEN '...' ELSE '' END AS preview FROM p WHERE k <= 8 GROUP BY 1")
def warning_preview(spark: SparkSession, d: str) -> DataFrame:
    due = _t(spark, d, "page_audit").where(F.coalesce("extraction_issue", F.lit("")) != "").select("input_file", "page")
    return pipeline.page_preview(due, "input_file", "page")


def _paths_sql(stem: str, suffix: str) -> str:
    return f"WITH t AS (SELECT file_id, regexp_replace(rel_path, '(.)\\.[^./]*$', '\\1') || '{stem}' AS stem, input_path FROM files), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY lower(input_path), file_id) AS k FROM t) SELECT file_id, CASE WHEN k = 1 THEN stem || '{suffix}' ELSE stem || '_' || k || '{suffix}' END AS name FROM n"


@query(_paths_sql("", ".md"))
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "files").select("file_id", F.lower("input_path").alias("_o"), output_name(F.col("rel_path"), ".md").alias("target"))
    return unique_names(df, "target", ["_o", "file_id"]).select("file_id", "name")


@query(_paths_sql("_paginas", ".jsonl"))
def audit_paths(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "files").select("file_id", F.lower("input_path").alias("_o"), audit_name(F.col("rel_path")).alias("target"))
    return unique_names(df, "target", ["_o", "file_id"]).select("file_id", "name")


@query(
    f"""WITH {_FINAL}, n AS (SELECT file_id, count(*) AS pages, bool_or(coalesce(char_count, 0) > 0) AS some, CAST(sum(coalesce(char_count, 0)) AS BIGINT) AS chars,
  coalesce(string_agg(CASE WHEN image_count > 0 THEN CAST(page AS VARCHAR) END, ',' ORDER BY page), '') AS ip, coalesce(string_agg(CASE WHEN ocr_image_candidate THEN CAST(page AS VARCHAR) END, ',' ORDER BY page), '') AS cp FROM final GROUP BY 1),
w AS (SELECT input_path, CASE WHEN inspect_warning IS NOT NULL THEN inspect_warning ELSE '' END AS warnings FROM files),
r AS (SELECT f.input_path, n.*, w.warnings, CASE WHEN f.page_count IS NULL THEN '{pipeline.BROKEN_PDF}' WHEN n.pages IS NULL THEN '{pipeline.NO_PAGES}' WHEN NOT n.some THEN '{pipeline.NO_TEXT}' END AS failure
  FROM files f LEFT JOIN n ON f.input_path = n.file_id LEFT JOIN w ON f.input_path = w.input_path)
SELECT input_path, CASE WHEN failure IS NULL THEN pages ELSE 0 END AS pages, CASE WHEN failure IS NULL THEN chars ELSE 0 END AS chars, CASE WHEN failure IS NULL THEN 'ok' ELSE 'failed' END AS status, failure, warnings,
  CASE WHEN failure IS NULL THEN CASE WHEN pages <= 250 THEN 'pequeno' WHEN pages <= 2000 THEN 'grande' WHEN pages <= 5000 THEN 'muito-grande' ELSE 'gigante' END END AS processing_profile,
  CASE WHEN failure IS NULL THEN ip ELSE '' END AS image_pages, CASE WHEN failure IS NULL THEN cp ELSE '' END AS ocr_image_pages FROM r"""
)
def result_records(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "files").select(F.col("input_path").alias("path"), F.lower("input_path").alias("ordinal_key"), "page_count", "inspect_warning")
    errors = files.where("page_count is null").select("path", F.lit(pipeline.BROKEN_PDF).alias("error"))
    warned = files.where("inspect_warning is not null").select("path", F.array("inspect_warning").alias("warnings"))
    pages = _final(spark, d).withColumn("char_count", F.coalesce("char_count", F.lit(0))).withColumn("raw_chars", F.col("char_count"))
    out = pipeline.results(files, pages, errors, pipeline.Options(), warned)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("input_path", "pages", "chars", "status", "failure", F.array_join("warnings", "; ").alias("warnings"), "processing_profile", joined("image_pages"), joined("ocr_image_pages"))


_ISSUE = "CASE WHEN layer_id % 7 = 0 THEN 'texto parcial' END"


def _judged_sql(name: str, column: str) -> str:
    inner = f"{_stats_sql('choose_best_page_text', 'layer_id', column)}, {_SCORES}".replace("char_count < 30", "char_count < 60")
    return f"{name} AS (WITH {inner} SELECT * FROM judged)"


@query(
    f"""WITH {_judged_sql("nj", "native_text")}, {_judged_sql("oj", "ocr_text")},
p AS (SELECT c.layer_id, c.ocr_text IS NOT NULL AS got, {_ISSUE.replace("layer_id", "c.layer_id")} AS issue, n.char_count AS nc, n.quality_score AS ns, n.flags AS nf, n.needs_ocr AS nn, o.char_count AS oc, o.quality_score AS os, o.flags AS fo, o.needs_ocr AS oo
  FROM choose_best_page_text c JOIN nj n USING (layer_id) JOIN oj o USING (layer_id)),
q AS (SELECT *, nn OR issue IS NOT NULL AS bad, CASE WHEN issue IS NOT NULL THEN list_append(nf, 'camada-nativa-incompleta') ELSE nf END AS flagged FROM p),
s AS (SELECT *, CASE WHEN NOT got THEN 'nativo' WHEN issue IS NOT NULL AND nc > 0 AND oc > 0 THEN 'nativo+ocr' WHEN nc = 0 AND oc > 0 THEN 'ocr' WHEN nc > 0 AND oc = 0 THEN 'nativo' WHEN nc = 0 THEN 'sem-texto' WHEN bad THEN 'ocr'
  WHEN os >= ns + 10 AND oc >= greatest(20, CAST(trunc(nc * CAST(0.55 AS DOUBLE)) AS BIGINT)) THEN 'ocr' WHEN oc > CAST(trunc(nc * CAST(1.35 AS DOUBLE)) AS BIGINT) AND os + 3 >= ns THEN 'ocr' ELSE 'nativo' END AS source FROM q)
SELECT layer_id, source, CASE WHEN source = 'nativo+ocr' THEN -1 WHEN source = 'ocr' THEN os WHEN source = 'sem-texto' THEN 0 ELSE ns END AS quality_score,
  CASE WHEN source = 'nativo+ocr' THEN false WHEN source = 'ocr' THEN oo WHEN source = 'sem-texto' THEN true ELSE bad END AS needs_ocr,
  CASE WHEN source = 'nativo+ocr' THEN '' WHEN source = 'ocr' THEN array_to_string(fo, ',') WHEN source = 'sem-texto' THEN 'sem-texto' WHEN got THEN '' ELSE array_to_string(flagged, ',') END AS flags, issue IS NOT NULL AS issue FROM s"""
)
def final_details(spark: SparkSession, d: str) -> DataFrame:
    """The details of what is kept of a page, by a threshold of 60; what merging gives (-1 and no flags here) is left to merge_layers."""
    layers = _wide(_t(spark, d, "choose_best_page_text").select(F.col("layer_id").cast("string").alias("path"), F.lit(0).alias("page_index"), F.col("native_text").alias("text"), "ocr_text", F.expr(_ISSUE).alias("extraction_issue")))
    pages = layers.drop("ocr_text").withColumn("source", F.lit("nativo")).withColumn("image_count", F.lit(0)).withColumn("image_coverages", F.lit(None).cast("array<double>"))
    options = pipeline.Options(ocr_threshold=60)
    scored = pipeline.score_pages(pages, options)
    ocr = layers.where("ocr_text is not null").select("path", "page_index", "ocr_text", F.lit(None).cast("string").alias("ocr_error"))
    out = pipeline.final_pages(scored, pipeline.select_ocr_pages(scored), ocr, options)
    plain = lambda c, left: F.when(F.col("source") != "nativo+ocr", c).otherwise(left)
    return out.select(F.col("file_id").cast("bigint").alias("layer_id"), "source", plain(F.col("quality_score"), F.lit(-1)).alias("quality_score"), plain(F.col("needs_ocr"), F.lit(False)).alias("needs_ocr"), plain(F.array_join("quality_flags", ","), F.lit("")).alias("flags"), F.col("extraction_issue").isNotNull().alias("issue"))


@query("WITH s AS (SELECT p_partkey, p_partkey % 3000 AS w, p_size * 60 AS h FROM part), f AS (SELECT *, CASE WHEN greatest(w, h) < 1400 THEN least(CAST(2 AS DOUBLE), CAST(1400 AS DOUBLE) / greatest(w, h)) ELSE CAST(1 AS DOUBLE) END AS k FROM s) SELECT p_partkey, CAST(greatest(1, floor(w * k)) AS INTEGER) AS width, CAST(greatest(1, floor(h * k)) AS INTEGER) AS height FROM f")
def prepared_sizes(spark: SparkSession, d: str) -> DataFrame:
    size = policy.prepared_size(F.col("p_partkey") % 3000, F.col("p_size") * 60)
    return _t(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 > 0 THEN CAST(0.35 AS DOUBLE) * (o_orderkey % 101) / 100 + CAST(0.64 AS DOUBLE) * (o_custkey % (o_orderkey % 5 + 1)) / (o_orderkey % 5) ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END, 9) AS done FROM orders")
def progress_shares(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    share = policy.progress(c("o_orderkey") % 101, F.lit(100), c("o_custkey") % (c("o_orderkey") % 5 + 1), c("o_orderkey") % 5)
    return _t(spark, d, "orders").select("o_orderkey", F.round(share, 9).alias("done"))


@query(f"WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 0 END AS kind, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{T.LINE_END}'), lambda x: regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM documents) SELECT doc_id, text FROM b WHERE coalesce(kind, 0) = 0 AND text <> ''")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 1, 1).when(F.col("doc_id") % 4 == 2, F.lit(None)).otherwise(0)
    return geometry.kept_blocks(_wide(_t(spark, d, "documents").select("doc_id", "text")).withColumn("kind", kind)).select("doc_id", "text")


@query("SELECT layer_id, printf('page_%06d', page_index) AS name, page_index + 1 AS page FROM choose_best_page_text")
def page_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "choose_best_page_text").select("layer_id", resume.page_name(F.col("page_index")).alias("name"), (F.col("page_index") + 1).alias("page"))


@query("SELECT file_id, count(*) AS pages, CAST(sum(length(coalesce(native_text, '')) + length(coalesce(ocr_text, ''))) AS BIGINT) AS chars FROM choose_best_page_text GROUP BY 1")
def character_totals(spark: SparkSession, d: str) -> DataFrame:
    chars = F.length(T.raw(F.col("native_text"))) + F.length(T.raw(F.col("ocr_text")))
    return _t(spark, d, "choose_best_page_text").groupBy("file_id").agg(F.count("*").alias("pages"), F.sum(chars).cast("bigint").alias("chars"))


@query(f"WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, {_simple('unnest(ls)')} AS norm FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{T.LINE_END}'), lambda x: regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL)) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, norm FROM l WHERE norm <> ''")
def simple_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all documents in the form that built-in functions give, beside normalize_lines."""
    return merge.line_rows(_wide(_t(spark, d, "documents").select("doc_id", "text")), ["doc_id"], "text", T.simple_normal).select("doc_id", "line_no", "norm")


@query(f"""WITH {_BOTH}, native_split AS (SELECT layer_id, list_filter(list_transform(regexp_split_to_array(native_text, '{T.LINE_END}'), lambda x: regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda x: x <> '') AS ls FROM both_),
native_lines AS (SELECT layer_id, unnest(range(len(ls))) AS line_no, {_simple("unnest(ls)")} AS norm FROM native_split)
SELECT o.layer_id, CAST(o.line_no AS INTEGER) AS ocr_line_no, CAST(n.line_no AS INTEGER) AS native_line_no FROM ocr_lines o JOIN native_lines n ON o.layer_id = n.layer_id AND o.norm = n.norm WHERE length(o.norm) >= 12""")
def equal_lines(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of line_similarity_join that are equal, in the form that SQL has."""
    return merge.equal_lines(_both(spark, d), ["layer_id"], "native_text", "ocr_text", T.simple_normal)


@query(f"SELECT layer_id, md5(CASE WHEN n = '' THEN o ELSE n END) AS beginning FROM (SELECT layer_id, regexp_replace(native_text, '^{T.WS}+|{T.WS}+$', '', 'g') AS n, regexp_replace(ocr_text, '^{T.WS}+|{T.WS}+$', '', 'g') AS o FROM choose_best_page_text WHERE native_text IS NOT NULL AND ocr_text IS NOT NULL)")
def merged_beginnings(spark: SparkSession, d: str) -> DataFrame:
    """What a merged text begins with: the native text, or the OCR text where there is none."""
    n = T.strip(F.col("native_text"))
    merged = _both(spark, d).select("layer_id", n.alias("n"), merge.merge_udf("native_text", "ocr_text").alias("m"))
    return merged.select("layer_id", F.md5(F.when(F.col("n") == "", F.col("m")).otherwise(F.substr("m", F.lit(1), F.length("n")))).alias("beginning"))


@query()
def exact_containment(spark: SparkSession, d: str) -> DataFrame:
    """line_containment in the whole form (compatibility forms, case, marks), which SQL lacks."""
    return merge.contained(_both(spark, d), ["layer_id"], "native_text", "ocr_text")


@query()
def exact_token_run(spark: SparkSession, d: str) -> DataFrame:
    """longest_token_run in the whole form."""
    return merge.token_runs(_both(spark, d), ["layer_id"], "native_text", "ocr_text")


@query()
def exact_overlap(spark: SparkSession, d: str) -> DataFrame:
    """token_multiset_overlap in the whole form."""
    return merge.bag_overlap(_both(spark, d), ["layer_id"], "native_text", "ocr_text")
