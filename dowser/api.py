"""A facade over a folder of index tables: search, files, settings, models, indexing, tasks and change maintenance.

Every change is one commit of all the tables that it touches (store.py), so a job that is lost midway leaves the index as it
was. Library code raises; the search calls here return empty results for empty queries, and a side of a hybrid search
that fails counts as empty.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dowser import schemas as S
from dowser.functions import exprs as X
from dowser.operators import pipeline, search, tasks
from dowser.operators import relational as R
from dowser.session import Folder, cut_lineage, stored
from dowser.sources import extract, files
from dowser.store import BUCKETS, Change, Store
from dowser.streaming import events as EV

TASK = S._struct(id=S._L, paths=S._S, embedding_model=S._S, status=S._S, start_time=S._TS, end_time=S._TS, duration=S._L, total_cnt=S._L, content_processed_cnt=S._L,
                 content_indexed_success_cnt=S._L, content_indexed_failed_cnt=S._L, content_indexed_skipped_cnt=S._L, remark=S._S, config_json=S._S, create_time=S._TS, update_time=S._TS)
PATHS = S._struct(line_num=S._L, file_id=S._L, path=S._S)
PLATFORM = S._struct(id=S._L, name=S._S, title=S._S, base_url=S._S, api_key=S._S, is_enable=S._B, create_time=S._TS, update_time=S._TS)
MODEL = S._struct(id=S._L, name=S._S, title=S._S, model_types=S._S, platform=S._S, is_enable=S._B, create_time=S._TS, update_time=S._TS)
TABLES = {"file_info": (S.FILE_INFO, "id"), "file_content_embedding": (S.CONTENT_EMBEDDING, "file_id"), "file_metadata_embedding": (S.META_EMBEDDING, "file_id"),
          "indexing_task": (TASK, "id"), "config": (S.CONFIG, "id"), "path_cache": (PATHS, "file_id"), "model_platform": (PLATFORM, "id"), "ai_model": (MODEL, "id")}
MULTILINGUAL, SKIPPED = "multilingual", "skipped"
MEDIA = (S.IMAGE, S.AUDIO)


@dataclass(frozen=True)
class Setting:
    """How the files below a root are indexed. Images and audio are, by analysers, unless the root is private."""

    root: str
    private: bool = False
    language: str = ""
    ignore_dirs: Sequence[str] = ()
    ignore_exts: Sequence[str] = ()
    ignore_files: Sequence[str] = ()
    keep: Sequence[int] = (S.DOCUMENT,)


class Stopped(Exception):
    """The task was asked to stop."""


@dataclass
class Engine:
    spark: SparkSession
    root: str
    embedder: pipeline.Embedder = field(default_factory=pipeline.hashing_embedder)
    model: str = "hashing"
    separator: str = "/"
    #: Embedders by language, for roots set to it; a language without one gets the engine's.
    by_language: Mapping[str, pipeline.Embedder] = field(default_factory=dict)
    #: Extractors by extension beside or in place of the built-in ones: analysers of images and audio, own loaders.
    analysers: Mapping[str, extract.Extractor] = field(default_factory=dict)
    #: Called with the step (start, scan, extract, embed, finish, stop, fail) and what is known of it.
    on_progress: Callable[[str, dict], None] = lambda step, known: None
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root, TABLES, self.buckets)
        self._stop = threading.Event()

    # --- search

    def warm_up(self) -> None:
        """Builds the path cache, so that the first search finds it; there is no result."""
        self._cache()

    def path_search(self, query: str) -> DataFrame:
        return search.path_search(self._cache(), query)

    def semantic_search(self, query: str, k: int = search.K, most: float = search.CUT_OFF) -> DataFrame:
        return search.semantic_search(self.store.read("file_content_embedding"), self.store.read("file_metadata_embedding"), self.store.read("file_info"), self.embedder([query])[0].tolist(), k, most)

    def hybrid_search(self, query: str, mode: str = "faithful") -> DataFrame:
        """Both searches; one that fails counts as empty. Either gives a few rows at most, so they are evaluated first."""

        def rows(find: Callable[[str], DataFrame], empty: str) -> DataFrame:
            try:
                df = find(query)
                return self.spark.createDataFrame(df.collect(), df.schema)
            except Exception:
                return self.spark.createDataFrame([], empty)

        return search.fuse(rows(self.path_search, "path string, score double, matched_keywords array<string>"), rows(self.semantic_search, "path string, score double, matched_chunk_ids array<bigint>"), mode)

    def intent(self, query: str) -> str:
        return self.spark.range(1).select(X.search_intent(F.lit(query)).alias("i")).first().i

    def search(self, query: str) -> DataFrame:
        """Routed by the query's intent."""
        return {"path": self.path_search, "semantic": self.semantic_search, "hybrid": self.hybrid_search}[self.intent(query)](query)

    def ask(self, query: str) -> DataFrame:
        """As the search box does: a leading / asks for paths; fewer than two characters find nothing."""
        if len(query) < 2:
            return self.path_search("")
        return self.path_search(query[1:]) if query.startswith("/") else self.semantic_search(query)

    def chunk_texts(self, ids: Sequence[int]) -> list[str]:
        return [r.chunk_text for r in R.chunks(self.store.read("file_content_embedding"), ids).collect()]

    # --- the path cache: a table of the index, numbered once

    def _cache(self) -> DataFrame:
        if "path_cache" not in self.store.where:
            self._commit({"path_cache": Change(search.path_cache(self.store.read("file_info")))}, self._mark())
        return self.store.read("path_cache")

    def _mark(self) -> dict[str, str]:
        """The time up to which paths are in the cache."""
        last = self.store.read("file_info").agg(F.max("update_time").alias("t")).first().t
        return {"path_cache": last.isoformat() if last else ""}

    def refresh_paths(self) -> None:
        """Adds the paths of files updated since the last time; numbers go on after the greatest."""
        cache, since = self._cache(), self.store.notes.get("path_cache", "")
        self._commit({"path_cache": Change(search.new_paths(cache, self.store.read("file_info"), datetime.fromisoformat(since) if since else None), append=True)}, self._mark())

    def keep_fresh(self, seconds: float = 10) -> threading.Event:
        """Refreshes the paths again and again until the event that is returned is set."""
        over = threading.Event()

        def run() -> None:
            while not over.wait(seconds):
                self.refresh_paths()

        threading.Thread(target=run, daemon=True).start()
        return over

    # --- files

    def files(self, number: int = 1, size: int = 20) -> DataFrame:
        return R.page(self.store.read("file_info"), number, size, F.desc("id"))

    def paths(self, number: int = 1, size: int = 1000, ascending: bool = True) -> DataFrame:
        return R.path_page(self.store.read("file_info"), number, size, ascending)

    def file(self, file_id: int) -> Row | None:
        return R.lookup(self.store.read("file_info"), "id", file_id)

    def counts(self) -> Row:
        """How many files there are, in all and by index status."""
        by = {r.content_index_status: r.n for r in self.store.read("file_info").groupBy("content_index_status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return Row(total=sum(by.values()), **{name: by.get(code, 0) for code, name in S.STATUSES.items()})

    def invalidate(self, file_id: int, reason: str) -> None:
        """Marks a file as invalid."""
        row = self.spark.createDataFrame([(file_id, True, reason)], "id bigint, is_invalid boolean, invalid_reason string")
        touched = self.store.touched(row, "id")
        self._commit({"file_info": Change(R.overlay(self.store.read("file_info", touched), row), buckets=touched)})

    def data(self, path: str) -> bytes | None:
        """A file's bytes; None if there is no such file."""
        got = files.read(self.spark.createDataFrame([(path,)], "path string")).first()
        return None if got is None else bytes(got.content)

    def path_type(self, path: str) -> str:
        """'file' or 'directory'; neither is an error."""
        info = files.kind_of(path)
        if info is None:
            raise FileNotFoundError(path)
        return info

    def stored_metadata(self, path: str) -> Row:
        """A file's metadata as it is now, overlaid by the extension and category that the index has of it."""
        now = files.described(self.spark.createDataFrame([(path,)], "path string"))
        known = self.store.read("file_info").select("path", F.col("file_ext").alias("_ext"), F.col("category").alias("_category"))
        row = now.join(known, "path", "left").select("path", "name", F.coalesce("_ext", "file_ext").alias("file_ext"), F.coalesce("_category", "category").alias("category"), "modified", "created", "file_size").first()
        if row is None:
            raise FileNotFoundError(path)
        return row

    def delete(self, file_id: int) -> None:
        if file_id >= 1:
            self._without(self.spark.createDataFrame([(file_id,)], "id bigint"))

    def clear(self) -> None:
        self._commit({n: Change(self.store.read(n).limit(0)) for n in ("file_info", "file_content_embedding", "file_metadata_embedding", "path_cache")})

    def _commit(self, changes: Mapping[str, Change], notes: Mapping[str, str] | None = None) -> None:
        self.store.commit(changes, notes)

    def _without(self, gone: DataFrame, more: Mapping[str, Change] | None = None) -> None:
        """Commits the removal of the files gone(id), with their embeddings and cached paths; reads and writes their
        buckets only."""
        gone = stored(gone.select("id").distinct())
        touched = self.store.touched(gone, "id")
        changes = {}
        for name in ("file_info", "file_content_embedding", "file_metadata_embedding", "path_cache"):
            if name in self.store.where:
                key = TABLES[name][1]
                changes[name] = Change(self.store.read(name, touched).join(gone.withColumnRenamed("id", key), key, "left_anti"), buckets=touched)
        self._commit(changes | dict(more or {}))

    # --- settings, models and platforms

    def config(self, name: str, default: str | None = None) -> str | None:
        row = R.lookup(self.store.read("config"), "name", name)
        return default if row is None else row.value

    def set_config(self, name: str, value: str) -> None:
        """Inserts or updates one entry; the table is small."""
        now = F.localtimestamp()
        rows = self.store.read("config")
        old = rows.withColumns({"value": F.when(F.col("name") == name, F.lit(value)).otherwise(F.col("value")), "update_time": F.when(F.col("name") == name, now).otherwise(F.col("update_time"))})
        new = self.spark.createDataFrame([(name, value)], "name string, value string").withColumns({"create_time": now, "update_time": now})
        self._commit({"config": Change(R.insert_or_ignore(old, new))})

    def settings(self) -> list[Setting]:
        return [Setting(**s) for s in json.loads(self.config("indexer_setting", "[]"))]

    def set_settings(self, settings: Sequence[Setting]) -> None:
        self.set_config("indexer_setting", json.dumps([asdict(s) for s in settings]))

    def watched(self) -> list[str]:
        return json.loads(self.config("fs_watcher_setting", "[]"))

    def add_watch(self, path: str) -> None:
        """Events below the path are applied from the next batch on; without any path all are."""
        self.set_config("fs_watcher_setting", json.dumps(sorted({*self.watched(), path})))

    def remove_watch(self, path: str) -> None:
        self.set_config("fs_watcher_setting", json.dumps(sorted({*self.watched()} - {path})))

    def models(self, kind: str | None = None, platform: str | None = None) -> DataFrame:
        rows = self.store.read("ai_model")
        if kind is not None and platform is not None:
            return R.model_by_type(rows, kind, platform)
        return (rows if platform is None else rows.where(F.col("platform") == platform)).orderBy("id")

    def find_model(self, name: str, platform: str) -> Row | None:
        return R.model_by_name(self.store.read("ai_model"), name, platform)

    def platforms(self, names: Sequence[str] | None = None) -> DataFrame:
        return R.by_names(self.store.read("model_platform"), names).orderBy("id")

    def put(self, table: str, row: Mapping[str, object], *by: str) -> None:
        """Inserts a model (by name and platform) or a platform (by name), or overwrites the given fields of it."""
        if table not in ("ai_model", "model_platform"):
            raise ValueError(table)
        by, rows, now = by or ("name",), self.store.read(table), F.localtimestamp()
        schema = TABLES[table][0]
        hit = F.lit(True)
        for c in by:
            hit = hit & (F.col(c) == F.lit(row[c]))
        fields = {k: F.when(hit, F.lit(v).cast(schema[k].dataType)).otherwise(F.col(k)) for k, v in row.items()} | {"update_time": F.when(hit, now).otherwise(F.col("update_time"))}
        if rows.where(hit).isEmpty():
            fresh = self.spark.range(1).select(*(F.lit(v).cast(schema[k].dataType).alias(k) for k, v in row.items()), now.alias("create_time"), now.alias("update_time"))
            self._commit({table: Change(R.append(rows, fresh))})
        else:
            self._commit({table: Change(rows.withColumns(fields))})

    def embedder_for(self, language: str) -> pipeline.Embedder:
        """The embedder of a root's language: the multilingual one only if it is asked for and there; else the engine's."""
        return self.by_language.get(MULTILINGUAL, self.embedder) if (language or "").strip().lower() == MULTILINGUAL else self.embedder

    # --- indexing

    def stop(self) -> None:
        """Asks the running task to stop: between two steps, and by cancelling its jobs."""
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(f"index {self.root}")

    def index(self, roots: Sequence[str | Setting], ignore_dirs: Sequence[str] = (), ignore_exts: Sequence[str] = (), ignore_files: Sequence[str] = (), keep: Sequence[int] = (S.DOCUMENT,), requeue: bool = True) -> Row:
        """Scans roots, extracts, chunks and embeds what is new or changed, and drops files that vanished; the finished
        task's row. A root given as a path has the setting that is stored for it, or else the arguments'."""
        if not roots:
            raise ValueError("no roots")
        known = {s.root: s for s in self.settings()}
        chosen = [r if isinstance(r, Setting) else known.get(r, Setting(r, False, "", ignore_dirs, ignore_exts, ignore_files, keep)) for r in roots]
        scans = [(s, files.scan(self.spark, [s.root], s.ignore_dirs, s.ignore_exts, s.ignore_files)) for s in chosen]

        def below(df: DataFrame) -> Column:
            hit = F.lit(False)
            for s in chosen:
                hit = hit | (F.col("path") == s.root) | F.col("path").startswith(s.root.rstrip("/\\") + self.separator)
            return hit

        return self._task([s.root for s in chosen], scans, lambda stored_files: stored_files.where(below(stored_files)), requeue)

    def index_paths(self, paths: DataFrame, requeue: bool = True) -> Row:
        """The same for the files paths(path), each with the setting of the root that it lies below. They are looked up
        where the tasks run; those that are not there any more leave the index."""
        paths = paths.where("path is not null").select("path").distinct()
        there = files.described(paths)
        scans, rest = [], F.lit(True)
        for s in sorted(self.settings(), key=lambda s: -len(s.root)):
            mine = F.col("path").startswith(s.root.rstrip("/\\") + self.separator) | (F.col("path") == s.root)
            scans.append((s, files.valid(there.where(rest & mine), [s.root], s.ignore_dirs, s.ignore_exts, s.ignore_files)))
            rest = rest & ~mine
        scans.append((Setting(""), files.valid(there.where(rest), [])))
        return self._task(["events"], scans, lambda stored_files: stored_files.join(paths, "path", "left_semi"), requeue)

    def _task(self, names: Sequence[str], scans: Sequence[tuple[Setting, DataFrame]], scope: Callable[[DataFrame], DataFrame], requeue: bool) -> Row:
        self._stop.clear()
        began, start = time.time(), self.spark.range(1).select(F.localtimestamp().alias("t")).first().t
        number = (self.store.read("indexing_task").agg(F.max("id").alias("m")).first().m or 0) + 1
        self._put_task(number, names, "running", start, None, None, "")
        self.on_progress("start", {"task": number, "paths": list(names)})
        self.spark.sparkContext.setJobGroup(f"index {self.root}", f"index {', '.join(names)}", True)
        try:
            self._ingest(scans, scope, requeue)
            status, remark = "completed", ""
        except Stopped:
            status, remark = "cancelled", "stopped"
        except Exception as e:
            status, remark = ("cancelled", "stopped") if self._stop.is_set() else ("failed", str(e)[:2000])
            if status == "failed":
                self._put_task(number, names, status, start, time.time() - began, None, remark)
                self.on_progress("fail", {"task": number, "error": remark})
                raise
        finally:
            self.spark.sparkContext._jsc.clearJobGroup()
        counts = tasks.summary(tasks.progress(self.store.read("file_info"))).first()
        self._put_task(number, names, status, start, time.time() - began, counts, remark)
        self.on_progress("finish" if status == "completed" else "stop", {"task": number, "total": counts.total or 0, "failed": counts.failed or 0})
        return self.task(number)

    def _put_task(self, number: int, names: Sequence[str], status: str, start: datetime, seconds: float | None, counts: Row | None, remark: str) -> None:
        now, c = F.localtimestamp(), counts.asDict() if counts else {}
        row = self.spark.range(1).select(
            F.lit(number).alias("id"), F.lit(",".join(names)).alias("paths"), F.lit(self.model).alias("embedding_model"), F.lit(status).alias("status"), F.lit(start).alias("start_time"),
            (now if seconds is not None else F.lit(None)).alias("end_time"), F.lit(None if seconds is None else int(seconds)).alias("duration"),
            *(F.lit(c.get(k) or 0).alias(a) for a, k in (("total_cnt", "total"), ("content_processed_cnt", "processed"), ("content_indexed_success_cnt", "success"),
                                                         ("content_indexed_failed_cnt", "failed"), ("content_indexed_skipped_cnt", "skipped"))),
            F.lit(remark).alias("remark"), F.lit(json.dumps([asdict(s) for s in self.settings()])).alias("config_json"), F.lit(start).alias("create_time"), now.alias("update_time"))
        touched = self.store.touched(row, "id")
        self._commit({"indexing_task": Change(self.store.read("indexing_task", touched).where(F.col("id") != number).unionByName(row.select(
            *(F.col(f.name).cast(f.dataType).alias(f.name) for f in TASK))), buckets=touched)})

    def _step(self, name: str, **known: object) -> None:
        if self._stop.is_set():
            raise Stopped
        self.on_progress(name, known)

    def _ingest(self, scans: Sequence[tuple[Setting, DataFrame]], scope: Callable[[DataFrame], DataFrame], requeue: bool) -> None:
        now = F.localtimestamp()
        # which files are new, changed, waiting or gone: by path and time, without their contents
        listed = None
        for k, (s, scan) in enumerate(scans):
            one = scan.select("path", "name", "file_ext", "category", "modified", "created", "file_size", F.lit(k).alias("root"), F.lit(s.private).alias("private"),
                              F.array(*map(F.lit, s.keep)).cast("array<int>").alias("keep"), F.lit((s.language or "").strip().lower() == MULTILINGUAL).alias("multilingual"))
            listed = one if listed is None else listed.unionByName(one)
        listed = stored(listed.dropDuplicates(["path"]))
        known = self.store.read("file_info")
        mine = scope(known.select("id", "path", "content_index_status", "file_update_time"))
        gone = mine.join(listed.select("path"), "path", "left_anti").select("id")
        plan = R.upsert_plan(listed, mine)
        status = F.when((F.col("action") == "new") | F.lit(requeue), S.WAITING).otherwise(F.col("was"))
        work = plan.where("action <> 'skip'").join(listed, "path").join(mine.select(F.col("id").alias("_id"), F.col("content_index_status").alias("was")), F.col("id") == F.col("_id"), "left").drop("_id")
        top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
        work = stored(work.withColumns({"id": F.coalesce("id", F.lit(top) + 1 + F.monotonically_increasing_id()), "status": status}))
        self._step("scan", listed=listed.count(), work=work.count())

        # each file is read once: fingerprint and text together
        media = ~F.col("private") & F.col("file_ext").isin(*self.analysers) if self.analysers else F.lit(False)
        wanted = (F.col("status") == S.WAITING) & ((F.col("category") == S.DOCUMENT) | (F.col("category").isin(*MEDIA) & media))
        texts = files.read(work.select("id", "path", "file_ext", "category", "keep", "multilingual", wanted.alias("wanted"))).withColumn("md5", F.md5("content"))
        texts = extract.extracted(texts.withColumn("content", F.when(F.col("wanted"), F.col("content"))), "content", "file_ext", registry=dict(self.analysers))
        texts = stored(texts.withColumn("text", F.when(F.col("wanted"), X.collapse_newlines("text"))))
        self._step("extract", files=texts.where("wanted").count())

        describe = F.to_json(F.struct("name", F.col("file_ext").alias("extension"), X.category_name("category").alias("category"), F.lit(0).alias("attributes"), F.col("file_size").alias("size"),
                                      F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"), F.lit("").alias("author")))
        rows = work.withColumn("metadata", describe)
        described, pieces = None, None
        for multilingual in (False, True):  # either kind has its own embedder
            embed = self.embedder_for(MULTILINGUAL if multilingual else "")
            kind = F.col("multilingual") == multilingual
            d = pipeline.embedded(rows.where(kind & (F.col("status") == S.WAITING)).select(F.col("id").alias("file_id"), X.metadata_text(X.parse_metadata("metadata")).alias("text")), "text", embed)
            p = pipeline.embedded(pipeline.chunked(texts.where(kind & F.col("wanted")), "id", "text"), "chunk_text", embed)
            described, pieces = (d, p) if described is None else (described.unionByName(d), pieces.unionByName(p))
        described, pieces = stored(described), stored(pieces)
        self._step("embed", chunks=pieces.count())

        # a chunk that fails marks its file, unless a later one does well; without chunks it is done, and skipped
        last = pieces.groupBy("file_id").agg(F.max_by(F.struct("error"), "chunk_index").alias("last")).select(F.col("file_id").alias("id"), F.lit(True).alias("some"), F.col("last.error").alias("error"))
        meta = described.select(F.col("file_id").alias("id"), F.col("error").alias("meta_error"), F.lit(True).alias("described"))
        done = rows.join(texts.select("id", "md5", "text", "wanted"), "id").join(last, "id", "left").join(meta, "id", "left")
        failed = F.col("error").isNotNull()
        fresh = done.select(
            "id", "name", "path", "category", "metadata", "md5", "file_ext", "file_size", F.col("created").alias("file_create_time"), F.col("modified").alias("file_update_time"), F.lit(False).alias("is_invalid"),
            F.when(F.col("wanted") & F.array_contains("keep", F.col("category")), F.col("text")).otherwise("").alias("content"),
            F.when(~F.col("wanted"), F.col("status")).when(failed, S.FAILED).otherwise(S.INDEXED).alias("content_index_status"),
            F.when(~F.col("wanted"), "").when(failed, F.col("error")).when(F.col("some"), "").otherwise(SKIPPED).alias("content_index_status_msg"),
            F.when(F.col("described").isNull(), F.col("status")).when(F.col("meta_error").isNotNull(), S.FAILED).otherwise(S.INDEXED).alias("meta_index_status"),
            F.coalesce("meta_error", F.lit("")).alias("meta_index_status_msg"), F.lit(None).cast("timestamp_ntz").alias("create_time"), now.alias("update_time"))

        leaving = stored(gone.unionByName(work.select("id")).distinct())
        touched = self.store.touched(leaving, "id")
        old = self.store.read("file_info", touched)
        since = old.select("id", F.col("create_time").alias("_since"), F.col("invalid_reason"))
        rows = fresh.join(since, "id", "left").withColumn("create_time", F.coalesce("_since", now)).drop("_since")
        changes = {"file_info": Change(old.join(leaving, "id", "left_anti").unionByName(rows, allowMissingColumns=True), buckets=touched)}
        for name, add in (("file_content_embedding", pieces), ("file_metadata_embedding", described)):
            own = self.store.read(name)
            first = own.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m + 1
            keep = self.store.read(name, touched).join(leaving.withColumnRenamed("id", "file_id"), "file_id", "left_anti")
            add = add.where("embedding is not null").withColumns({"id": F.lit(first) + F.monotonically_increasing_id(), "create_time": now})
            changes[name] = Change(keep.unionByName(add.select(*(c for c in own.columns if c in add.columns)), allowMissingColumns=True), buckets=touched)
        if "path_cache" in self.store.where:
            changes["path_cache"] = Change(self.store.read("path_cache", touched).join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti"), buckets=touched)
        self._commit(changes)
        if "path_cache" in self.store.where:
            self.refresh_paths()

    def task(self, number: int) -> Row | None:
        return R.lookup(self.store.read("indexing_task"), "id", number)

    def tasks(self, column: str = "id", ascending: bool = False, number: int = 1, size: int = 20) -> DataFrame:
        return R.sorted_page(self.store.read("indexing_task"), column, ascending, number, size, TASK.fieldNames())

    def delete_task(self, number: int) -> None:
        self._commit({"indexing_task": Change(self.store.read("indexing_task").where(F.col("id") != number))})

    def model_changed(self) -> bool:
        return tasks.model_changed(self.store.read("indexing_task"), self.model)

    # --- changes

    def apply_events(self, events: DataFrame) -> None:
        """One flush of file events, as flush() gives them: removals, then renames, then files to index. Paths are joined
        with the tables and looked up by tasks; none goes to the driver."""
        known = self.store.read("file_info")
        self._without(R.removed_ids(known, events.where("kind = 'remove'")))
        renames = events.where("kind = 'rename'")
        known = self.store.read("file_info")
        moved = stored(R.renamed(known, renames))
        touched = self.store.touched(moved, "id")
        if touched:
            new = moved.select("id", "path", "name").withColumn("update_time", F.localtimestamp())
            changes = {"file_info": Change(R.overlay(self.store.read("file_info", touched), new), buckets=touched)}
            if "path_cache" in self.store.where:
                changes["path_cache"] = Change(R.overlay(self.store.read("path_cache", touched), moved.select(F.col("id").alias("file_id"), "path"), "file_id"), buckets=touched)
            self._commit(changes)
        unknown = renames.join(known.select("path"), "path", "left_anti").where("to_path is not null").select(F.col("to_path").alias("path"), "is_file")
        again = cut_lineage(events.where("kind in ('create', 'modify')").select("path", "is_file").unionByName(unknown).where("coalesce(is_file, true)").select("path").distinct())
        if not again.isEmpty():
            self.index_paths(again)

    def apply_late(self, events: DataFrame) -> None:
        """Events that come after later ones were applied. What they name is taken from the index and looked up again, so
        that the files as they are now count, and not a time that has passed."""
        late = EV.normalised(events)
        self._without(R.removed_ids(self.store.read("file_info"), late.where("kind in ('remove', 'rename')")))
        named = late.where("kind in ('remove', 'rename') or coalesce(is_file, true)").select(F.explode(F.array("path", "to_path")).alias("path"))
        again = cut_lineage(named.where("path is not null").distinct())
        if not again.isEmpty():
            self.index_paths(again)

    def watch(self, folder: str, checkpoint: str, gap: str = EV.GAP, watermark: str = EV.WATERMARK):
        """Maintains the index by a folder of event files: debounced sessions, applied one after the other. A session
        is applied when the greatest time seen lies `watermark` behind its end; events that come later than that are
        applied by themselves. Of open sessions the strongest event of each path is kept in the checkpoint's folder."""
        held = Folder(self.spark, f"{checkpoint}/held")
        columns = [c for c in S.FILE_EVENT.fieldNames() if c != "arrive_time"]

        def step(batch: DataFrame, n: int) -> None:
            text = held.read(f"v{n - 1}.txt") if held.exists(f"v{n - 1}.txt") else ""
            before = datetime.fromisoformat(text) if text else None
            roots = self.watched()
            inside = F.lit(not roots)
            for r in roots:
                inside = inside | F.col("path").startswith(r.rstrip("/\\") + self.separator) | (F.col("path") == r) | F.col("path").isNull()
            fresh = batch.select(*columns).where(inside).persist()
            waiting = batch.sparkSession.read.schema(fresh.schema).parquet(f"{held.path}/v{n - 1}") if held.exists(f"v{n - 1}") else fresh.limit(0)
            last = fresh.agg((F.max("ts") - F.expr(f"interval {watermark}")).alias("t")).first().t
            bound = max((t for t in (before, last) if t is not None), default=None)
            # what waits was not behind the bound before
            late, closed, still = EV.split_by_bound(waiting.unionByName(fresh), before, bound, gap)
            EV.thinned(still, gap).select(*columns).write.mode("overwrite").parquet(f"{held.path}/v{n}")
            for df, apply in ((EV.sessions(closed, gap), self.apply_events), (late, self.apply_late)):
                df = cut_lineage(df)  # applied by several joins
                if not df.isEmpty():
                    apply(df)
            held.write(f"v{n}.txt", bound.isoformat() if bound else "")
            held.delete(f"v{n - 2}")
            fresh.unpersist()

        return files.event_log(self.spark, folder, S.FILE_EVENT).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
