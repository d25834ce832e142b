"""Queries of the reference's own operators over the index tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dowser import schemas as S
from dowser.functions import exprs as X
from dowser.operators import relational as R
from dowser.operators import search, tasks
from dowser.streaming import events as EV
from dowser.tables import once, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- shared parts -------------------------------------------------------------------------------------------------

#: In SQL: the latest version of every file, and every other row once.
_CTE = {
    "f": "f as (select * from (select *, row_number() over (partition by id order by update_time desc) as rn from file_info) where rn = 1)",
    "e": "e as (select * from (select *, row_number() over (partition by id order by id) as rn from file_content_embedding) where rn = 1)",
    "m": "m as (select * from (select *, row_number() over (partition by id order by id) as rn from file_metadata_embedding) where rn = 1)",
    "t": "t as (select * from (select *, row_number() over (partition by id order by update_time desc) as rn from indexing_task) where rn = 1)",
    "v": "v as (select * from (select *, row_number() over (partition by event_id order by event_id) as rn from file_event) where rn = 1)",
}


def _with(names: str, sql: str) -> str:
    return "with " + ", ".join(_CTE[n] for n in names) + sql


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.latest(table(spark, d, "file_info"), *columns)


def content(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(spark, d, "file_content_embedding"), "id", *columns)


def indexing_tasks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.latest(table(spark, d, "indexing_task"), *columns)


def file_events(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "file_event"), "event_id", "ts", "kind", "path", "to_path", "is_file")


def query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- search -------------------------------------------------------------------------------------------------------

_DIM = 64
_USABLE = "len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0"
_QUERY = f"q as (select embedding::double[] as q from e where {_USABLE} order by id limit 1)"
_DOT = "list_sum(list_transform(list_zip(embedding::double[], q.q), lambda p: p[1] * p[2]))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::double * x::double)))"
_DISTANCE = f"round(1 - {_DOT} / ({_NORM.format('embedding')} * {_NORM.format('q.q')}), 6)"
_KNN = (f"kc as (select file_id, id, {_DISTANCE} as distance from e, q where {_USABLE} order by 3, 2 limit {{k}}), "
        f"km as (select file_id, id, {_DISTANCE} as distance from m, q where {_USABLE} order by 3, 2 limit {{k}})")
_MERGE = """merged as (select file_id, min(distance) as distance, coalesce(list(chunk order by distance, chunk) filter (where chunk is not null), []) as chunks
  from (select file_id, distance, id as chunk from kc where distance <= {cut} union all select file_id, distance, null from km where distance <= {cut}) group by file_id)"""
#: The test vectors are far apart, so the queries take more neighbours than a user's search does.
_K, _CUT = 40, 0.7


def query_vector(spark: SparkSession, d: str) -> list[float]:
    e = table(spark, d, "file_content_embedding")
    some = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull())
    row = e.where((F.size("embedding") == _DIM) & some).select("id", "embedding").orderBy("id").limit(1).collect()
    return list(row[0].embedding) if row else [1.0] * _DIM


def _vectors(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select("id", "file_id", "embedding")


@query("knn_content", _with("e", f", {_QUERY}, kc as (select file_id, id, {_DISTANCE} as distance from e, q where {_USABLE} order by 3, 2 limit 10) select * from kc where distance <= 0.7"))
def knn_content(spark, d):
    return search.knn(_vectors(spark, d, "file_content_embedding"), query_vector(spark, d))


@query("knn_meta", _with("em", f", {_QUERY}, {_KNN.format(k=10)} select * from km where distance <= 0.95"))
def knn_meta(spark, d):
    return search.knn(_vectors(spark, d, "file_metadata_embedding"), query_vector(spark, d), most=0.95)


@query("knn_no_threshold", _with("e", f", {_QUERY} select file_id, id, {_DISTANCE} as distance from e, q where {_USABLE} order by 3, 2 limit 10"))
def knn_no_threshold(spark, d):
    return search.knn(_vectors(spark, d, "file_content_embedding"), query_vector(spark, d), most=-1)


@query("knn_384", _with("e", f", {_QUERY} select file_id, id, {_DISTANCE} as distance from e, q where {_USABLE} order by 3, 2 limit 10"))
def knn_384(spark, d):
    """Vectors of 384 numbers: each vector six times over, which leaves its angles as they are."""
    wide = _vectors(spark, d, "file_content_embedding").where(F.size("embedding") == _DIM).withColumn("embedding", F.flatten(F.array_repeat("embedding", 6)))
    return search.knn(wide, query_vector(spark, d) * 6, most=-1)


@query("merge_content_meta", _with("em", f", {_QUERY}, {_KNN.format(k=_K)}, {_MERGE.format(cut=_CUT)} select file_id, distance, chunks as matched_chunk_ids from merged"))
def merge_content_meta(spark, d):
    q = query_vector(spark, d)
    return search.merge_hits(search.knn(_vectors(spark, d, "file_content_embedding"), q, _K, _CUT), search.knn(_vectors(spark, d, "file_metadata_embedding"), q, _K, _CUT))


_SEMANTIC = f", {_QUERY}, {_KNN.format(k=_K)}, {_MERGE.format(cut=_CUT)}, sem as (select distance as score, 'semantic' as source, file_id, f.path, chunks as matched_chunk_ids from merged join f on f.id = file_id)"


@query("semantic_search", _with("emf", f"{_SEMANTIC} select * from sem"))
def semantic_search(spark, d):
    return search.semantic_search(_vectors(spark, d, "file_content_embedding"), _vectors(spark, d, "file_metadata_embedding"), table(spark, d, "file_info"), query_vector(spark, d), _K, _CUT)


_LINES = "lines as (select row_number() over (order by id) - 1 as line_num, id as file_id, path from f where coalesce(path, '') <> '')"
_NAME = "regexp_extract(path, '([^/\\\\]*)[/\\\\]*$', 1)"
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _category(ext: str) -> str:
    return f"case when {ext} in {_in(X.DOCUMENT_EXTS)} then 1 when {ext} in {_in(X.IMAGE_EXTS)} then 2 when {ext} in {_in(X.AUDIO_EXTS)} then 3 when {ext} in {_in(X.VIDEO_EXTS)} then 4 else 5 end"


def _path_sql(words: list[str], pattern: str, limit: int = 20) -> str:
    hits = f"regexp_extract_all(path, '{pattern}')"
    matched = ", ".join(f"case when list_contains(list_transform({hits}, lambda h: lower(h)), '{w.lower()}') then '{w}' end" for w in words)
    return (f"found as (select len({hits})::double as score, 'path' as source, line_num, file_id, path, {_NAME} as name, {_EXT} as file_ext, {_category(_EXT)} as category, "
            f"list_filter([{matched}], lambda w: w is not null) as matched_keywords from lines where regexp_matches(path, '{pattern}') order by score desc, line_num limit {limit})")


def _path_query(name: str, words: list[str], pattern: str) -> None:
    @query(name, _with("f", f", {_LINES}, {_path_sql(words, pattern)} select * from found"))
    def run(spark, d):
        return search.path_search_files(files(spark, d, "path"), " ".join(words))


_path_query("path_search_single", ["report"], "(?i)report")
_path_query("path_search_multi", ["Meeting", "NOTE", "archive", "pdf"], "(?i)(?:meeting|archive|note|pdf)")
_path_query("path_search_shadowed", ["doc", "docx", "do", "documents"], "(?i)(?:documents|docx|doc|do)")

_HYBRID = ["documents", "Desktop", "the"]


def _fusion(mode: str):
    def run(spark, d):
        semantic = semantic_search(spark, d).select("score", "path", "matched_chunk_ids")
        # of several ids with one path the nearest counts
        semantic = semantic.groupBy("path").agg(F.min(F.struct("score", "matched_chunk_ids")).alias("s")).select("path", "s.*")
        paths = search.path_search_files(files(spark, d, "path"), " ".join(_HYBRID))
        paths = paths.groupBy("path").agg(F.max(F.struct("score", "matched_keywords")).alias("p")).select("path", "p.*")
        return search.fuse(paths, semantic, mode)

    score = "s.score" if mode == "faithful" else "1 - s.score"
    sql = f"""{_SEMANTIC}, {_LINES}, {_path_sql(_HYBRID, "(?i)(?:documents|desktop|the)")},
    s as (select path, min(score) as score, arg_min(matched_chunk_ids, (score, matched_chunk_ids)) as matched_chunk_ids from sem group by path),
    p as (select path, max(score) as score, arg_max(matched_keywords, score) as matched_keywords from found group by path)
    select round(case when p.path is null then 0.4 * ({score}) when s.path is null then p.score else 0.6 * p.score + 0.4 * ({score}) end, 6) as score,
      case when p.path is null then 'semantic' else 'path' end as source, coalesce(p.path, s.path) as path,
      coalesce(p.matched_keywords, []) as matched_keywords, case when p.path is null then s.matched_chunk_ids else [] end as matched_chunk_ids
    from p full join s on p.path = s.path"""
    query("hybrid_fusion" if mode == "faithful" else "hybrid_fusion_similarity", _with("emf", sql))(run)


_fusion("faithful")
_fusion("similarity")


@query("path_cache_build", _with("f", f", {_LINES} select * from lines"))
def path_cache_build(spark, d):
    return search.path_cache(files(spark, d, "path"))


@query("path_cache_remove_dir", _with("f", " select id, path from f where coalesce(path, '') <> '' and not starts_with(path, '/srv/share/')"))
def path_cache_remove_dir(spark, d):
    return search.remove_from_cache(files(spark, d, "path").where("coalesce(path, '') <> ''"), "/srv/share", False)


_SINCE = "2024-01-01 00:00:00"


@query("path_cache_refresh", _with("f", f", old as (select path from f where coalesce(path, '') <> '' and update_time <= timestamp '{_SINCE}') select path from old union all (select distinct path from f where update_time > timestamp '{_SINCE}' and coalesce(path, '') <> '' and path not in (select path from old))"))
def path_cache_refresh(spark, d):
    """The cache of what was there at a time, and what was updated since."""
    every, since = files(spark, d, "path", "update_time"), F.lit(_SINCE).cast("timestamp_ntz")
    return search.refresh_cache(search.path_cache(every.where(F.col("update_time") <= since)), every, since).select("path")


_BLANK = "[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query("detect_intent", f"""select doc_id, case when regexp_matches(q, '[\\\\/*.]') then 'path' when w <= 2 then 'path'
  when contains(q, 'about') or contains(q, 'related') or contains(q, 'that') or contains(q, 'which') or contains(q, 'where') or contains(q, 'notes') or contains(q, 'document') then 'hybrid'
  when strlen(q) > 20 then 'semantic' else 'hybrid' end as intent
  from (select doc_id, q, len(list_filter(regexp_split_to_array(q, '{_BLANK}'), lambda x: x <> '')) as w
    from (select doc_id, regexp_replace(text, '^{_BLANK}|{_BLANK}$', '', 'g') as q from documents where text is not null))""")
def detect_intent(spark, d):
    """The intent of every document's whole text, taken as a query."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.search_intent("text").alias("intent"))


@query("highlight_path", _with("f", " select id, regexp_replace(regexp_replace(path, '(?i)(doc)', '<b>\\1</b>', 'g'), '(?i)(\\Q.\\E)', '<b>\\1</b>', 'g') as path from f where path is not null"))
def highlight_path(spark, d):
    return files(spark, d, "path").where("path is not null").select("id", X.highlight("path", ["doc", "."]).alias("path"))


# --- expressions --------------------------------------------------------------------------------------------------


@query("collapse_newlines", _with("f", " select id, regexp_replace(content, '[\\r\\n]+', chr(10), 'g') as content from f"))
def collapse_newlines(spark, d):
    return files(spark, d, "content").select("id", X.collapse_newlines("content").alias("content"))


@query("name_ext", _with("f", f" select id, {_NAME} as name, {_EXT} as file_ext from f where path is not null"))
def name_ext(spark, d):
    return files(spark, d, "path").where("path is not null").select("id", X.file_name("path").alias("name"), X.file_ext("path").alias("file_ext"))


@query("file_category", _with("f", f" select id, {_category(_EXT)} as category, case {_category(_EXT)} when 1 then 'document' when 2 then 'image' when 3 then 'audio' when 4 then 'video' else 'other' end as category_name from f where path is not null"))
def file_category(spark, d):
    code = X.category(X.file_ext("path"))
    return files(spark, d, "path").where("path is not null").select("id", code.alias("category"), X.category_name(code).alias("category_name"))


@query("guess_path_kind", """select event_id, case when p = '' or ends_with(p, '/') then 'directory' when regexp_extract(n, '^.+\\.([^.]+)$', 1) <> '' then 'file'
  when starts_with(n, '.') and length(n) > 1 and n <> '..' then 'file' else 'directory' end as kind
  from (select event_id, p, regexp_extract(p, '([^/]*)$', 1) as n from (select distinct event_id, replace(path, '\\', '/') as p from file_event where path is not null))""")
def guess_path_kind(spark, d):
    return file_events(spark, d).where("path is not null").select("event_id", X.path_kind("path").alias("kind"))


@query("human_size", _with("f", " select id, case when file_size > 1073741824 then (file_size // 1073741824) || 'G' when file_size > 1048576 then (file_size // 1048576) || 'M' when file_size > 1024 then (file_size // 1024) || 'K' else file_size || 'B' end as size from f"))
def human_size(spark, d):
    return files(spark, d, "file_size").select("id", X.human_size("file_size").alias("size"))


@query("mime_type", _with("f", " select id, case lower(file_ext) " + " ".join(f"when '{k}' then '{v}'" for k, v in X.MIME_TYPES.items()) + " else 'application/octet-stream' end as mime from f"))
def mime_type(spark, d):
    return files(spark, d, "file_ext").select("id", X.mime_type("file_ext").alias("mime"))


@query("content_md5", _with("f", " select id, md5(content) as md5 from f where content is not null"))
def content_md5(spark, d):
    return files(spark, d, "content").where("content is not null").select("id", F.md5("content").alias("md5"))


_JSON = "case when json_valid(metadata) then metadata else '{}' end::json"
_FIELD = "coalesce(j->>'$.{0}', '')"


@query("metadata_text", _with("f", f""", j as (select id, {_JSON} as j from f) select id, 'file name:' || {_FIELD.format('name')} || ',file extension:' || {_FIELD.format('extension')} || ',file category:' || {_FIELD.format('category')}
  || ',size:' || coalesce(try_cast(j->>'$.size' as bigint), 0) || ' bytes,creation time:' || {_FIELD.format('created')} || ',last write time:' || {_FIELD.format('modified')} || ',author:' || {_FIELD.format('author')} || ',file attributes:' as text from j"""))
def metadata_text(spark, d):
    return files(spark, d, "metadata").select("id", X.metadata_text(X.parse_metadata("metadata")).alias("text"))


@query("metadata_fields", _with("f", f", j as (select id, {_JSON} as j from f) select id, {_FIELD.format('name')} as name, {_FIELD.format('extension')} as extension, coalesce(try_cast(j->>'$.size' as bigint), 0) as size, {_FIELD.format('author')} as author from j"))
def metadata_fields(spark, d):
    m = files(spark, d, "metadata").select("id", X.parse_metadata("metadata").alias("m"))
    return m.select("id", "m.name", "m.extension", "m.size", "m.author")


@query("valid_files", _with("f", f" select id from f where {_EXT} <> '' and {_EXT} not in ('log', 'bin') and not starts_with({_NAME}, '.')"))
def valid_files(spark, d):
    return files(spark, d, "path").where(X.valid_file("path", ["log", "bin"])).select("id")


@query("scan_dir_filter", _with("f", """ select id from f where starts_with(path, '/home/') and len(list_filter(list_slice(p, 1, len(p) - 1), lambda s: starts_with(s, '.') or s = 'claane')) = 0""").replace(
    "from f where", "from (select id, path, regexp_split_to_array(substr(path, 6 + 1), '[/\\\\]') as p from f) where"))
def scan_dir_filter(spark, d):
    return files(spark, d, "path").where(F.col("path").startswith("/home/") & ~X.in_ignored_directory("path", "/home/", ["claane"])).select("id")


@query("kept_content", _with("f", """, r as (select f.id, f.category, f.content, s.save_parsed_content as k from f join indexer_setting s on starts_with(f.path, s.root_path || '/') or starts_with(f.path, s.root_path || chr(92)))
  select id, case when coalesce(case category when 1 then k.document when 2 then k.image when 3 then k.audio when 4 then k.video else false end, false) then coalesce(content, '') else '' end as content from r"""))
def kept_content(spark, d):
    """The content that each file's root keeps. The settings are broadcast if there are few, which is checked."""
    settings = table(spark, d, "indexer_setting").select("root_path", "save_parsed_content")
    few = settings.limit(10_001).count() <= 10_000
    f = files(spark, d, "path", "category", "content")
    up = f.where("length(path) > 0").select("*", F.explode(X.ancestors("path")).alias("root_path"))
    return up.join(F.broadcast(settings) if few else settings, "root_path").select("id", X.kept_content("content", "category", "save_parsed_content").alias("content"))


# --- filters, counts and pages ------------------------------------------------------------------------------------


@query("unindexed_keyset", _with("f", " select id, path from f where content_index_status = 1 and category = 1 and id > 100 order by id limit 1000"))
def unindexed_keyset(spark, d):
    return R.keyset(files(spark, d, "path", "content_index_status", "category"), S.DOCUMENT, 100).select("id", "path")


@query("count_unindexed_by_category", _with("f", " select category, count(*) as n from f where content_index_status = 1 group by category"))
def count_unindexed_by_category(spark, d):
    return files(spark, d, "content_index_status", "category").where("content_index_status = 1").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("table_counts", "select 'file_info' as name, count(distinct id) as n from file_info union all select 'file_content_embedding', count(distinct id) from file_content_embedding union all select 'indexing_task', count(distinct id) from indexing_task")
def table_counts(spark, d):
    out = None
    for name in ("file_info", "file_content_embedding", "indexing_task"):
        one = table(spark, d, name).select("id").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("count_by_prefix", _with("f", " select count(*) as n from f where translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '/srv/share/%'"))
def count_by_prefix(spark, d):
    return files(spark, d, "path").where(X.under_directory("path", "/SRV/share")).agg(F.count(F.lit(1)).alias("n"))


@query("files_page", _with("f", " select id, path from f order by id desc limit 20 offset 20"))
def files_page(spark, d):
    return R.page(files(spark, d, "path"), 2, 20, F.desc("id"))


@query("paths_page_asc", _with("f", " select id, path from f order by path nulls first, id limit 25 offset 50"))
def paths_page_asc(spark, d):
    return R.page(files(spark, d, "path"), 3, 25, F.asc_nulls_first("path"), "id")


@query("paths_page_desc", _with("f", " select path from f order by id desc limit 25 offset 50"))
def paths_page_desc(spark, d):
    return R.path_page(files(spark, d, "path"), 3, 25, False)


@query("updated_since", _with("f", f" select id, path from f where update_time > timestamp '{_SINCE}'"))
def updated_since(spark, d):
    return R.updated_since(files(spark, d, "path", "update_time"), F.lit(_SINCE).cast("timestamp_ntz")).select("id", "path")


@query("updated_since_page", _with("f", f" select id, path from f where update_time > timestamp '{_SINCE}' order by id desc limit 20"))
def updated_since_page(spark, d):
    return R.page(updated_since(spark, d), 1, 20, F.desc("id"))


@query("files_by_ids", _with("f", " select id, path, md5 from f where id in (7, 11, 12, 13, 500)"))
def files_by_ids(spark, d):
    return R.by_names(files(spark, d, "path", "md5"), (7, 11, 12, 13, 500), "id").select("id", "path", "md5")


@query("chunks_by_file", _with("e", ", hot as (select file_id from e where file_id is not null group by 1 order by count(*) desc, file_id limit 1) select id, chunk_index, chunk_text from e where file_id in (select file_id from hot)"))
def chunks_by_file(spark, d):
    """The chunks of the file with most of them."""
    top = content(spark, d, "file_id").where("file_id is not null").groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_id").limit(1).collect()
    own = table(spark, d, "file_content_embedding").where(F.col("file_id") == (top[0].file_id if top else None))
    return once(own, "id", "chunk_index", "chunk_text")


@query("md5_dedup", _with("f", " select lower(md5) as md5, count(*) as n, min(id) as first_id from f where coalesce(md5, '') <> '' group by 1 having count(*) > 1"))
def md5_dedup(spark, d):
    known = files(spark, d, "md5").where("coalesce(md5, '') <> ''")
    return known.groupBy(F.lower("md5").alias("md5")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query("max_id", "select max(id) as max_id from file_info")
def max_id(spark, d):
    return table(spark, d, "file_info").agg(F.max("id").alias("max_id"))


# --- tasks --------------------------------------------------------------------------------------------------------


@query("task_page_sorted", _with("t", " select id, status, total_cnt from t order by total_cnt desc nulls last, id limit 10"))
def task_page_sorted(spark, d):
    return R.sorted_page(indexing_tasks(spark, d, "status", "total_cnt"), "total_cnt", False, 1, 10, ["total_cnt", "start_time"])


@query("latest_task", _with("t", " select id, embedding_model from t order by id desc limit 1"))
def latest_task(spark, d):
    return tasks.latest_task(indexing_tasks(spark, d, "embedding_model"))


@query("task_duration", _with("t", " select id, epoch(date_trunc('second', end_time))::bigint - epoch(date_trunc('second', start_time))::bigint as seconds from t"))
def task_duration(spark, d):
    return tasks.durations(indexing_tasks(spark, d, "start_time", "end_time"))


@query("task_paths", _with("t", " select id, unnest(string_split(paths, ',')) as path from t"))
def task_paths(spark, d):
    return indexing_tasks(spark, d, "paths").select("id", F.explode(F.split("paths", ",")).alias("path"))


@query("task_status", _with("t", " select case when status in ('pending', 'running', 'paused', 'completed', 'failed', 'cancelled') then status else 'pending' end as status, count(*) as n from t group by 1"))
def task_status(spark, d):
    return indexing_tasks(spark, d, "status").groupBy(X.task_status("status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_PROGRESS = """p as (select case when category in (2, 3) then category else 1 end as category, count(*) as total, count(*) filter (where content_index_status > 2) as processed,
  count(*) filter (where content_index_status = 3) as success, count(*) filter (where content_index_status = 4) as failed,
  count(*) filter (where content_index_status = 3 and coalesce(length(content), 0) = 0) as skipped from f group by 1)"""


@query("task_progress", _with("f", f", {_PROGRESS} select * from p"))
def task_progress(spark, d):
    return tasks.progress(files(spark, d, "category", "content_index_status", "content"))


@query("task_summary", _with("f", f", {_PROGRESS} select " + ", ".join(f"sum({c})::bigint as {c}" for c in ("total", "processed", "success", "failed", "skipped")) + " from p"))
def task_summary(spark, d):
    return tasks.summary(task_progress(spark, d))


# --- changes ------------------------------------------------------------------------------------------------------

_LOW = "translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("delete_prefix", _with("f", f" select id, path from f where not coalesce(path = '/srv/share' or {_LOW} like '/srv/share/%', false)"))
def delete_prefix(spark, d):
    return R.delete_prefix(files(spark, d, "path"), "/srv/share")


@query("delete_embeddings_by_prefix", _with("fe", f" select id, file_id from e where file_id is null or file_id not in (select id from f where {_LOW} like '/srv/share/%')"))
def delete_embeddings_by_prefix(spark, d):
    return R.delete_embeddings_of(content(spark, d, "file_id"), files(spark, d, "path"), "/srv/share")


@query("reroot_directory", _with("f", f" select id, case when {_LOW} like '/srv/share/%' then replace(path, '/srv/share', '/mnt/new') else path end as path from f"))
def reroot_directory(spark, d):
    return R.reroot(files(spark, d, "path"), "/srv/share", "/mnt/new")


@query("rename_file", _with("f", ", o as (select path as old from f order by id limit 1) select id, case when path = old then 'new.txt' else name end as name, case when path = old then '/tmp/new.txt' else path end as path from f, o"))
def rename_file(spark, d):
    f = files(spark, d, "path", "name")
    first = f.orderBy("id").select("path").take(1)
    return R.rename_file(f, first[0].path if first else "", "/tmp/new.txt")


@query("set_status", _with("f", " select id, case when id in (7, 11, 12) then 3 else content_index_status end as content_index_status from f"))
def set_status(spark, d):
    return R.set_status(files(spark, d, "content_index_status", "content_index_status_msg"), [7, 11, 12], content=S.INDEXED).select("id", "content_index_status")


@query("upsert_classify", _with("f", """, s as (select path, max(file_update_time + (id % 3 - 1) * interval 1 hour) as modified from (select id, path, file_update_time from f where path is not null
  union all select id, path || '.new', file_update_time from f where path is not null) group by path),
  k as (select path, arg_max(id, (file_update_time, id)) as id, arg_max(content_index_status, (file_update_time, id)) as st, max(file_update_time) as fu from f group by path)
  select s.path, k.id, case when k.path is null then 'new' when k.st = 3 and k.fu >= s.modified then 'skip' else 'update' end as action from s left join k on s.path = k.path"""))
def upsert_classify(spark, d):
    """A scan of all files, some earlier and some later than stored, and of a new path beside each."""
    f = files(spark, d, "path", "file_update_time", "content_index_status")
    some = f.where("path is not null")
    scan = some.select("id", "path", "file_update_time").unionByName(some.select("id", F.concat("path", F.lit(".new")).alias("path"), "file_update_time"))
    return R.upsert_plan(scan.select("path", F.expr("file_update_time + make_interval(0, 0, 0, 0, cast(id % 3 - 1 as int), 0, 0)").alias("modified")), f)


@query("upsert_apply", _with("f", """, s as (select path, max(file_update_time + (id % 3 - 1) * interval 1 hour) as modified from (select id, path, file_update_time from f where path is not null
  union all select id, path || '.new', file_update_time from f where path is not null) group by path),
  k as (select path, arg_max(id, (file_update_time, id)) as id, arg_max(content_index_status, (file_update_time, id)) as st, max(file_update_time) as fu from f group by path),
  plan as (select s.path, k.id, s.modified, case when k.path is null then 'new' when k.st = 3 and k.fu >= s.modified then 'skip' else 'update' end as action from s left join k on s.path = k.path)
  select f.path, coalesce(p.modified, f.file_update_time) as file_update_time, case when p.id is null then f.content_index_status else 1 end as content_index_status
  from f left join plan p on p.id = f.id and p.action = 'update' union all select path, modified, 1 from plan where action = 'new'"""))
def upsert_apply(spark, d):
    """The file table after the scan of upsert_classify; new files have new ids, which are not shown."""
    f = files(spark, d, "path", "file_update_time", "content_index_status")
    some = f.where("path is not null")
    scan = some.select("id", "path", "file_update_time").unionByName(some.select("id", F.concat("path", F.lit(".new")).alias("path"), "file_update_time"))
    times = scan.select("path", F.expr("file_update_time + make_interval(0, 0, 0, 0, cast(id % 3 - 1 as int), 0, 0)").alias("modified"))
    wide = f.withColumns({"name": F.lit(""), "file_ext": F.lit(""), "category": F.lit(1), "meta_index_status": F.lit(1), "is_invalid": F.lit(False)})
    return R.apply_upsert(times.groupBy("path").agg(F.max("modified").alias("modified")), wide).select("path", "file_update_time", "content_index_status")


# --- events -------------------------------------------------------------------------------------------------------

_RANK = "case kind when 'remove' then 0 when 'rename' then 1 when 'create' then 2 else 3 end"


@query("fs_event_kinds", _with("v", " select case when kind = 'rename' and to_path is null then 'remove' else kind end as kind, count(*) as n from v where path is not null and kind in ('remove', 'rename', 'create', 'modify') group by 1"))
def fs_event_kinds(spark, d):
    return EV.normalised(file_events(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("fs_debounce_merge", _with("v", f""", w as (select *, lag(ts) over (order by ts) as before from (select distinct ts from v where ts is not null)),
  s as (select ts, max(case when before is null or ts >= before + interval 10 minutes then ts end) over (order by ts) as session_start from w),
  n as (select v.event_id, v.ts, v.path, case when kind = 'rename' and to_path is null then 'remove' else kind end as kind, s.session_start from v join s on v.ts = s.ts
    where path is not null and kind in ('remove', 'rename', 'create', 'modify'))
  select session_start, path, arg_min(event_id, ({_RANK}, ts, event_id)) as event_id, arg_min(kind, ({_RANK}, ts, event_id)) as kind, count(*) as events from n group by session_start, path"""))
def fs_debounce_merge(spark, d):
    return EV.sessions(file_events(spark, d), "10 minutes").select("session_start", "path", "event_id", "kind", "events")


@query("fs_rename_pairing")
def fs_rename_pairing(spark, d):
    """Renames of the events table split into halves by source, and paired again within the window."""
    e = file_events(spark, d).where("path is not null and ts is not null").withColumn("source", F.regexp_extract("path", r"^(.{0,12})", 1))
    half = F.when(F.col("kind") == "rename", "rename_from").otherwise(F.col("kind"))
    first = e.select("event_id", "ts", half.alias("kind"), "path", "to_path", "source")
    second = e.where("kind = 'rename' and to_path is not null").select(
        "event_id", (F.col("ts") + F.expr("interval 100 milliseconds")).alias("ts"), F.lit("rename_to").alias("kind"), F.col("to_path").alias("path"), F.lit(None).cast("string").alias("to_path"), "source")
    return EV.paired(first.unionByName(second), "source")
