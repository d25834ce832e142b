"""Queries of settings, cascades, look-ups and small functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from dowser.functions import exprs as X
from dowser.operators import pipeline
from dowser.operators import relational as R
from dowser.plans.index import _LOW, _with, content, files, indexing_tasks
from dowser.tables import once, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_MODELS = [(1, "small-en", "embed,rerank", "local", True), (2, "vision", "vision,chat", "cloud", True), (3, "old-vision", "vision", "cloud", False), (4, "speech", "audio", "cloud", True)]
_CONFIG = [(1, "theme", "dark"), (2, "locale", "en"), (3, "proxy", "{}")]


def query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _values(rows, names: str) -> str:
    return f"(values {', '.join(str(r).replace('True', 'true').replace('False', 'false') for r in rows)}) as v({names})"


def _models(spark):
    return spark.createDataFrame(_MODELS, "id bigint, name string, model_types string, platform string, is_enable boolean")


def _config(spark):
    return spark.createDataFrame(_CONFIG, "id bigint, name string, value string")


@query("model_by_type", f"select * from {_values(_MODELS, 'id, name, model_types, platform, is_enable')} where contains(model_types, 'vision') and platform = 'cloud' and is_enable order by id limit 1")
def model_by_type(spark, d):
    return R.model_by_type(_models(spark), "vision", "cloud")


@query("config_lookup", f"select id, name, value from {_values(_CONFIG, 'id, name, value')} where name in ('theme', 'locale')")
def config_lookup(spark, d):
    return _config(spark).where(F.col("name").isin("theme", "locale"))


@query("config_insert_or_ignore", f"select name, value from {_values(_CONFIG, 'id, name, value')} union all select 'zoom', '2'")
def config_insert_or_ignore(spark, d):
    new = spark.createDataFrame([("theme", "light"), ("zoom", "2"), ("zoom", "2")], "name string, value string")
    return R.insert_or_ignore(_config(spark), new).select("name", "value")


@query("config_update", f"select id, name, case when name = 'locale' then 'zh' else value end as value from {_values(_CONFIG, 'id, name, value')}")
def config_update(spark, d):
    return R.overlay(_config(spark), spark.createDataFrame([("locale", "zh")], "name string, value string"), "name")


@query("english_roots", "select setting_id, coalesce(lower(trim(file_content_language)) = 'multilingual', false) as multilingual, len(ignore_dirs) as dirs, len(ignore_exts) as exts, len(ignore_files) as files from indexer_setting")
def english_roots(spark, d):
    s = table(spark, d, "indexer_setting")
    return s.select("setting_id", F.coalesce(F.lower(F.trim("file_content_language")) == "multilingual", F.lit(False)).alias("multilingual"),
                    *(F.when(F.col(c).isNotNull(), F.size(c)).alias(a) for c, a in (("ignore_dirs", "dirs"), ("ignore_exts", "exts"), ("ignore_files", "files"))))


@query("cascade_delete", _with("fem", """, x as (select file_id from e where file_id in (select id from f) group by 1 order by 1 limit 1)
  select 'file_info' as name, count(*) as n from f where id <> (select file_id from x) union all select 'file_content_embedding', count(*) from e where file_id is distinct from (select file_id from x)
  union all select 'file_metadata_embedding', count(*) from m where file_id is distinct from (select file_id from x)"""))
def cascade_delete(spark, d):
    """What is left of the three tables without the first file that has chunks."""
    f, e, m = files(spark, d, "path"), content(spark, d, "file_id"), once(table(spark, d, "file_metadata_embedding"), "id", "file_id")
    first = e.join(f.select(F.col("id").alias("file_id")), "file_id", "left_semi").agg(F.min("file_id").alias("x")).first().x
    names = ("file_info", "file_content_embedding", "file_metadata_embedding")
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in zip(names, R.delete_file(f, e, m, first or 0), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("remove_directory", _with("fem", f""", g as (select id from f where {_LOW} like '/srv/share/%')
  select 'file_info' as name, count(*) as n from f where not coalesce(path = '/srv/share' or {_LOW} like '/srv/share/%', false)
  union all select 'file_content_embedding', count(*) from e where file_id is null or file_id not in (select id from g)
  union all select 'file_metadata_embedding', count(*) from m where file_id is null or file_id not in (select id from g)"""))
def remove_directory(spark, d):
    three = R.remove_directory(files(spark, d, "path"), content(spark, d, "file_id"), once(table(spark, d, "file_metadata_embedding"), "id", "file_id"), "/srv/share")
    names = ("file_info", "file_content_embedding", "file_metadata_embedding")
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in zip(names, three, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("delete_embeddings_of_file", _with("e", " select id from e where file_id is distinct from 14"))
def delete_embeddings_of_file(spark, d):
    f = files(spark, d, "path")
    return R.delete_file(f, content(spark, d, "file_id"), content(spark, d, "file_id"), 14)[1].select("id")


@query("update_content_meta", _with("f", " select id, case when id % 10 = 0 then 'new text' else content end as content from f"))
def update_content_meta(spark, d):
    f = files(spark, d, "content")
    return R.overlay(f, f.where("id % 10 = 0").select("id", F.lit("new text").alias("content")))


@query("stale_files", _with("f", " select id from f where path is null or path not in (select path from f where id % 3 > 0 and path is not null)"))
def stale_files(spark, d):
    f = files(spark, d, "path")
    return R.stale(f, f.where("id % 3 > 0")).select("id")


@query("task_counters", _with("t", " select id, case when id % 2 = 0 then 'completed' else status end as status, case when id % 2 = 0 then total_cnt else content_processed_cnt end as content_processed_cnt from t"))
def task_counters(spark, d):
    t = indexing_tasks(spark, d, "status", "total_cnt", "content_processed_cnt")
    done = t.where("id % 2 = 0").select("id", F.lit("completed").alias("status"), F.col("total_cnt").alias("content_processed_cnt"))
    return R.overlay(t, done).select("id", "status", "content_processed_cnt")


@query("selected_columns", _with("f", " select id, name, file_size from f"))
def selected_columns(spark, d):
    return R.columns(files(spark, d, "name", "file_size", "path"), ["id", "name", "file_size"])


@query("lookup_by_path", _with("f", ", x as (select path from f where path is not null order by id limit 1) select min(id) as id from f where path = (select path from x)"))
def lookup_by_path(spark, d):
    f = files(spark, d, "path")
    first = f.where("path is not null").orderBy("id").select("path").take(1)
    return f.where(F.col("path") == (first[0].path if first else "")).agg(F.min("id").alias("id"))


@query("status_names", _with("f", " select id, case content_index_status when 1 then 'waiting' when 2 then 'indexing' when 3 then 'indexed' when 4 then 'failed' else 'waiting' end as content_status from f"))
def status_names(spark, d):
    return files(spark, d, "content_index_status").select("id", X.status_name("content_index_status").alias("content_status"))


@query("category_codes", _with("f", " select id, case when category between 1 and 5 then category else 5 end as category from f"))
def category_codes(spark, d):
    return files(spark, d, "category").select("id", X.category_code(X.category_name("category")).alias("category"))


@query("attribute_names", "with b as (select distinct id % 65536 as bits from file_info) select bits, list_filter([" + ", ".join(f"case when (bits & {b}) <> 0 then '{n}' end" for b, n in X.ATTRIBUTES.items()) + "], lambda x: x is not null) as names from b")
def attribute_names(spark, d):
    bits = table(spark, d, "file_info").select((F.col("id") % 65536).alias("bits")).distinct()
    return bits.select("bits", X.attribute_names("bits").alias("names"))


@query("data_uris", _with("f", " select id, 'data:image/png;base64,' || base64(encode(name)) as uri from f where name is not null"))
def data_uris(spark, d):
    return files(spark, d, "name").where("name is not null").select("id", X.data_uri(F.col("name").cast("binary"), F.lit("png")).alias("uri"))


@query("encrypted_names", _with("f", " select id, name from f where name is not null"))
def encrypted_names(spark, d):
    """Names encrypted and decrypted again."""
    key, iv = "0123456789abcdef", "fedcba9876543210"
    return files(spark, d, "name").where("name is not null").select("id", X.decrypt(X.encrypt("name", key, iv), key, iv).alias("name"))


@query("time_texts", _with("f", " select id, strftime(update_time, '%Y-%m-%d %H:%M:%S') as text, date_trunc('second', update_time)::timestamp as back from f where update_time is not null"))
def time_texts(spark, d):
    f = R.latest(table(spark, d, "file_info"), "update_time").where("update_time is not null").withColumn("text", X.format_time("update_time"))
    return f.select("id", "text", X.parse_time("text").alias("back"))


@query("page_counts", _with("f", " select category, ceil(count(*) / 20)::bigint as pages from f group by 1"))
def page_counts(spark, d):
    return files(spark, d, "category").groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", X.page_count("n", 20).cast("bigint").alias("pages"))


@query("separators", "select setting_id, case when ends_with(root_path, '/') then root_path else root_path || '/' end as path from indexer_setting")
def separators(spark, d):
    return table(spark, d, "indexer_setting").select("setting_id", X.ensure_separator("root_path").alias("path"))


@query("metadata_json_roundtrip", _with("f", " select id, coalesce(try_cast((case when json_valid(metadata) then metadata else '{}' end::json)->>'$.size' as bigint), 0) as size from f"))
def metadata_json_roundtrip(spark, d):
    once_more = X.parse_metadata(F.to_json(X.parse_metadata("metadata")))
    return files(spark, d, "metadata").select("id", once_more["size"].alias("size"))


@query("chunk_documents")
def chunk_documents(spark, d):
    """Every document in chunks of at most 1,024 words with 20 of overlap."""
    return pipeline.chunked(table(spark, d, "documents"), "doc_id", "text")


_TOKENS = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]|[^\\t-\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]+"


@query("chunk_totals", f"""select count(*) filter (where n > 0) as documents, count(*) filter (where n > 1024) as in_several, 0 as too_long
  from (select len(regexp_extract_all(text, '{_TOKENS}')) as n from documents where text is not null)""")
def chunk_totals(spark, d):
    """Of chunk_documents: documents with chunks, those with several, and chunks above the capacity."""
    size = F.regexp_count("chunk_text", F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]|[^\s\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+"))
    one = chunk_documents(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(size > pipeline.CAPACITY, 1).otherwise(0)).alias("long"))
    return one.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > 1).alias("in_several"), F.coalesce(F.sum("long"), F.lit(0)).alias("too_long"))


@query("embed_metadata")
def embed_metadata(spark, d):
    """The vector of every file's metadata sentence."""
    f = files(spark, d, "metadata").select(F.col("id").alias("file_id"), X.metadata_text(X.parse_metadata("metadata")).alias("text"))
    return pipeline.embedded(f, "text").select("file_id", "embedding")


