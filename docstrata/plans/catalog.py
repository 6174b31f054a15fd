"""The registered queries of the document store and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.globs import any_match
from ..operators import chunks as C
from ..operators import convert as V
from ..operators import evaluate as E
from ..operators import index
from ..operators import ingest as W
from ..operators import retrieval as R
from ..operators import routes
from ..operators import store as S
from ..operators.snapshots import snapshot
from ..session import shared_dir
from ..sources import contract
from ..streaming import ingest, latest
from .views import BM25, FUSED, SEM, V_DOCS, V_FILES, V_GOLDEN, read, v_conv, v_docs, v_files, v_golden

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CUT = "2024-01-20 00:00:00"
NOW = "2024-01-30 12:00:00"
KEYS = ("logical_path", "version_id", "event_id")
TASK_ROWS = 250_000  # rows of a few numbers that a task gets


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


# Versions.


@query(f"with {V_FILES} select logical_path, version_id, event_id, size_bytes from cur")
def current_files(spark: SparkSession, d: str) -> DataFrame:
    return S.current(v_files(spark, d)).select(*KEYS, "size_bytes")


@query(f"with {V_FILES} select logical_path, version_id, event_id from latest where tombstone")
def tombstoned_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.tombstoned(v_files(spark, d)).select(*KEYS)


@query(f"""with {V_FILES} select logical_path, version_id, event_id, r::int as ordinal,
  not tombstone and sum((not tombstone)::int) over (partition by logical_path order by version_id desc, event_id desc rows unbounded preceding) = 1 as is_current from ranked""")
def version_list(spark: SparkSession, d: str) -> DataFrame:
    return S.version_list(v_files(spark, d)).select(*KEYS, "ordinal", "is_current")


@query(f"""with {V_FILES}, past as (select *, row_number() over (partition by logical_path order by version_id desc, event_id desc) as q from v_files where version_id <= '2024-01-10')
  select logical_path, version_id, event_id from past where q = 1 and not tombstone""")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    return S.as_of(v_files(spark, d), at("2024-01-10 00:00:00")).select(*KEYS)


@query(f"with {V_FILES} select logical_path, version_id from cur order by logical_path limit 50 offset 20")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return S.list_page(v_files(spark, d), 50, 20).select("logical_path", "version_id")


@query(f"with {V_FILES} select logical_path, size_bytes from cur where starts_with(logical_path, 'click/')")
def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.current(v_files(spark, d).filter(F.col("logical_path").startswith("click/"))).select("logical_path", "size_bytes")


@query(f"with {V_FILES} select logical_path from cur where regexp_matches(logical_path, '^[^/]*/user-[^/]*[02468]\\.md$')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.current(v_files(spark, d).filter(any_match(F.col("logical_path"), ["*/user-*[02468].md"], expand=False))).select("logical_path")


@query(f"with {V_FILES} select logical_path, version_id from cur where refresh_frequency_sec is not null and timestamp '2024-01-30 12:00:00' > refreshed_at + to_seconds(refresh_frequency_sec)")
def refresh_due(spark: SparkSession, d: str) -> DataFrame:
    return S.refresh_due(v_files(spark, d), at(NOW)).select("logical_path", "version_id")


@query(f"with {V_FILES} select logical_path, version_id, event_id from ranked where r > 1 and version_id < '{CUT}'")
def prune_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.prunable(v_files(spark, d), at(CUT)).select(*KEYS)


@query(f"with {V_FILES} select logical_path, version_id, event_id from ranked where r = 1 or version_id >= '{CUT}'")
def prune_kept(spark: SparkSession, d: str) -> DataFrame:
    return S.prune(v_files(spark, d), at(CUT)).select(*KEYS)


# Statistics.


@query(f"""with {V_FILES} select count_if(r = 1 and not tombstone) as current, count_if(r = 1 and tombstone) as tombstoned, count(*) as versions, count_if(r = 1) as paths,
  coalesce(sum(size_bytes) filter (r = 1 and not tombstone), 0)::bigint as current_bytes, coalesce(sum(size_bytes), 0)::bigint as all_bytes from ranked""")
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.stats_counts(v_files(spark, d))


@query(f"with {V_FILES} select source_type, count(*) as n from cur group by 1")
def stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    return S.count_by(S.current(v_files(spark, d)), "source_type")


@query(f"""with {V_FILES}, c as (select mime_type, count(*) as c from cur group by 1), q as (select *, row_number() over (order by c desc, mime_type) as q from c)
  select case when q <= 10 then mime_type else '(other)' end as mime_type, sum(c)::bigint as n from q group by 1""")
def stats_mime_topn_other(spark: SparkSession, d: str) -> DataFrame:
    return S.top_and_other(S.current(v_files(spark, d)), "mime_type")


@query(f"""with {V_FILES} select count(refresh_frequency_sec) as scheduled,
  count_if(refresh_frequency_sec is not null and timestamp '2024-01-30 12:00:00' > refreshed_at + to_seconds(refresh_frequency_sec)) as due from cur""")
def refresh_health(spark: SparkSession, d: str) -> DataFrame:
    return S.refresh_health(v_files(spark, d), at(NOW))


# Blobs and ingest.


@query(f"with {V_DOCS} select sha256, any_value(size_bytes)::bigint as size_bytes, count(*) as copies from v_docs group by 1")
def blob_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return v_docs(spark, d).groupBy("sha256").agg(F.first("size_bytes").alias("size_bytes"), F.count("*").alias("copies"))


@query(f"with {V_DOCS} select distinct sha256 from v_docs where sha256 not in (select sha256 from v_docs where lang is distinct from 'fr')")
def orphan_blobs(spark: SparkSession, d: str) -> DataFrame:
    """What is left over when the versions of one language are gone."""
    docs = v_docs(spark, d)
    refs = docs.filter(~F.col("lang").eqNullSafe("fr")).withColumnRenamed("sha256", "blob_sha256")
    return S.orphan_blobs(docs.select("sha256").distinct(), refs)


@query(f"with {V_DOCS} select doc_id, case when lang = 'fr' then 'mime' else 'size' end as reason from v_docs where lang = 'fr' or size_bytes > 4000")
def strip_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = v_docs(spark, d).select("doc_id", "size_bytes", F.concat(F.lit("text/"), F.col("lang")).alias("mime_type"), F.col("content").alias("bytes"))
    return S.strip_candidates(rows, 4000, ["text/fr"]).select("doc_id", "reason")


def _later(docs: DataFrame) -> DataFrame:
    """A later state of all documents: long ones are edited, Spanish ones are gone, French ones are there a second time."""
    content = F.coalesce("content", F.lit(""))
    now = docs.filter(~F.col("lang").eqNullSafe("es")).withColumn("content", F.when(F.col("size_bytes") > 3000, F.concat(content, F.lit("!"))).otherwise(content))
    return now.unionByName(now.filter("lang = 'fr'").withColumn("logical_path", F.concat(F.lit("again/"), F.col("logical_path"))))


V_LATER = """edit as (select logical_path, lang, coalesce(size_bytes > 3000, false) as edited, coalesce(content, '') || case when size_bytes > 3000 then '!' else '' end as content from v_docs where lang is distinct from 'es'),
v_later as (select *, false as fresh from edit union all select 'again/' || logical_path, lang, edited, content, true from edit where lang = 'fr'),
v_gone as (select logical_path, coalesce(content, '') as content from v_docs where lang = 'es')"""


@query(f"with {V_DOCS}, {V_LATER} select logical_path, case when fresh then 'new' when edited then 'changed' else 'unchanged' end as status from v_later")
def ingest_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = v_docs(spark, d)
    known = docs.select("logical_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("source_sha256"))
    return S.ingest_gate(_later(docs).select("logical_path", F.sha2("content", 256).alias("source_sha256")), known).select("logical_path", "status")


@query(f"with {V_DOCS}, {V_LATER} select logical_path, timestamp '2024-01-30 12:00:00' as version_id, true as tombstone, 'source gone' as change_note from v_gone")
def sync_tombstones(spark: SparkSession, d: str) -> DataFrame:
    docs = v_docs(spark, d)
    return S.sync(docs, _later(docs), at(NOW))


@query(f"""with {V_DOCS}, m as (select logical_path, 'moved/' || logical_path as new_path, sha256 from v_docs where lang = 'de')
  select new_path as logical_path, false as tombstone, sha256 from m union all select logical_path, true, sha256 from m""")
def move_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = v_docs(spark, d).withColumn("version_id", at(CUT)).withColumn("tombstone", F.lit(False))
    return S.move(docs.select("logical_path", "version_id", "tombstone", "sha256"), _renames(docs), at(NOW)).select("logical_path", "tombstone", "sha256")


def _renames(docs: DataFrame) -> DataFrame:
    return docs.filter("lang = 'de'").select(F.col("logical_path").alias("old_path"), F.concat(F.lit("moved/"), F.col("logical_path")).alias("new_path"))


@query(f"""with {V_DOCS}, c as (select *, unnest(range(0, greatest(ceil(length(content) / 1800.0), 1)::int))::int as chunk_index from v_docs where lang = 'de')
  select 'moved/' || logical_path as logical_path, chunk_index, sha256('moved/' || logical_path || chr(10) || 'about ' || coalesce(lang, '') || chr(10) || chr(10) || substr(content, chunk_index * 1800 + 1, 1800)) as sha from c""")
def move_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of moved paths, with their search text built anew."""
    docs = v_docs(spark, d).withColumn("version_id", at(CUT)).withColumn("description", F.concat(F.lit("about "), F.coalesce("lang", F.lit(""))))
    chunks = C.hard_cut(docs.select("logical_path", "content"), 1800).select("logical_path", at(CUT).alias("version_id"), "chunk_index", "chunk_content", F.lit("").alias("context"), F.lit("").alias("search_text"))
    return S.moved_chunks(chunks, docs, _renames(docs), at(NOW)).select("logical_path", "chunk_index", F.sha2("search_text", 256).alias("sha"))


@query(f"""with {V_DOCS} select count(*) as stripped, coalesce(sum(size_bytes), 0)::bigint as reclaimed_bytes from
  (select sha256, min(lang) as lang, any_value(size_bytes) as size_bytes from v_docs group by 1) where lang = 'fr' or size_bytes > 4000""")
def blob_reclaimable(spark: SparkSession, d: str) -> DataFrame:
    rows = v_docs(spark, d).groupBy("sha256").agg(F.concat(F.lit("text/"), F.min("lang")).alias("mime_type"), F.first("size_bytes").alias("size_bytes"), F.encode(F.first("content"), "UTF-8").alias("bytes"))
    return S.reclaimable(rows, 4000, ["text/fr"])


@query(f"with {V_DOCS} select sha256, any_value(base64(encode(content))) as bytes_base64 from v_docs group by 1")
def blob_base64(spark: SparkSession, d: str) -> DataFrame:
    rows = v_docs(spark, d).select("sha256", F.lit("text/plain").alias("mime_type"), "size_bytes", F.encode("content", "UTF-8").alias("bytes"))
    return S.read_bytes(S.new_blobs(rows)).select("sha256", F.regexp_replace("bytes_base64", "\\s+", "").alias("bytes_base64"))


def _entries(docs: DataFrame, **more) -> DataFrame:
    cols = (F.lit("text/markdown").alias("mime_type"), F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("bytes"), F.lit("local").alias("source_type"), F.col("logical_path").alias("source_path"), F.lit(0).cast("long").alias("source_mtime_ms"))
    return docs.select("logical_path", *cols, *[F.lit(v).alias(k) for k, v in more.items()])


def _two_states(spark: SparkSession, d: str, settings: W.Settings = W.Settings()) -> str:  # noqa: B008
    """A store that has taken all documents and then their later state, which is tried twice."""
    where, docs = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", v_docs(spark, d)
    W.ingest_batch(spark, where, "first", _entries(docs), at(CUT), settings)
    for _ in range(2):
        W.ingest_batch(spark, where, "second", _entries(_later(docs)), at(NOW), settings, in_scope="")
    return where


@query(f"""with {V_DOCS}, {V_LATER} select logical_path, sha256(content) as content_sha256, (case when edited and not fresh then 2 else 1 end)::bigint as versions, true as searchable,
  case when fresh or edited then 'ok' else 'unchanged' end as outcome from v_later""")
def store_ingest_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two states of all documents through the write path: what is current, whether its chunks can be found, and what
    became of each entry of the second."""
    store = W.read_store(spark, _two_states(spark, d))
    counts = store["files"].filter("not tombstone").groupBy("logical_path").agg(F.count("*").alias("versions"))
    found = S.current_chunks(store["chunks"], store["files"]).filter(F.col("search_text").startswith(F.col("logical_path"))).select("logical_path").distinct()
    told = store["outcomes"].filter("key = 'second'").select("logical_path", F.col("status").alias("outcome"))
    rows = S.current(store["files"]).join(counts, "logical_path").join(found.withColumn("there", F.lit(True)), "logical_path", "left").join(told, "logical_path")
    return rows.select("logical_path", "content_sha256", "versions", F.coalesce("there", F.lit(False)).alias("searchable"), "outcome")


@query(f"""with {V_DOCS}, {V_LATER}, f as (select logical_path, case when fresh or edited then timestamp '{NOW}' else timestamp '{CUT}' end as version_id, false as tombstone, content from v_later
    union all select logical_path, timestamp '{NOW}', true, null from v_gone)
  select 'files' as tbl, logical_path || ' ' || strftime(version_id, '%Y-%m-%d') as key, tombstone::bigint as n, sha256(content) as sha from f
  union all select 'chunks', logical_path || ' ' || strftime(version_id, '%Y-%m-%d'), 1, null from f where not tombstone
  union all select 'blobs', sha256(content), any_value(octet_length(encode(content))), null from f where not tombstone group by 1, 2
  union all select 'pinned', 'files', (select count(*) from v_docs) + (select count(*) from v_later where fresh or edited) + (select count(*) from v_gone), null
  union all select 'revision', 'short chunks', 1, null""")
def store_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """After two states: old versions pruned with their chunks and blobs, all chunks cut anew under another revision, and
    each table in one part; an older snapshot still has all."""
    where = _two_states(spark, d)
    before = snapshot(spark, where)
    W.prune(spark, where, "prune", at("2024-01-25 00:00:00"))
    W.reindex(spark, where, "reindex", "short chunks", W.Settings(chunks=C.Config(target=400, longest=600)))
    W.collect_blobs(spark, where, "collect")
    now = W.compact(spark, where, "compact")
    key, none = F.concat_ws(" ", "logical_path", F.date_format("version_id", "yyyy-MM-dd")), F.lit(None).cast("string")
    row = lambda rows, tbl, key, n, sha=none: rows.select(F.lit(tbl).alias("tbl"), key.alias("key"), n.cast("long").alias("n"), sha.alias("sha"))
    short = F.least(F.lit(1), F.sum((F.char_length("chunk_content") <= 600).cast("int")))
    parts = [
        row(now.read("files"), "files", key, F.col("tombstone").cast("int"), F.col("content_sha256")), row(now.read("chunks").groupBy(key.alias("key")).agg(short.alias("n")), "chunks", F.col("key"), F.col("n")),
        row(now.read("blobs"), "blobs", F.col("sha256"), F.octet_length("bytes")), row(before.read("files").agg(F.count("*").alias("n")), "pinned", F.lit("files"), F.col("n")),
        row(spark.range(1), "revision", F.lit(now.revision), F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"""with {V_DOCS}, {V_LATER} select logical_path, sha256(content) as content_sha256, (1 + edited::int)::bigint as versions, 'unchanged' as status, timestamp '2024-01-20 04:00:00' as refreshed_at, false as due from v_later where not fresh
  union all select logical_path, sha256(content), 1, 'failed:source gone', timestamp '2024-01-20 04:00:00', false from v_gone""")
def store_refresh_loop(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a source that is read again every hour: two ticks, after its later state has come."""
    where, docs = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", v_docs(spark, d)
    W.ingest_batch(spark, where, "first", _entries(docs, refresh_frequency_sec=3600), at(CUT))
    source = _entries(_later(docs), error=None).withColumn("error", F.col("error").cast("string"))
    live = lambda due: source.join(due.select("logical_path").hint("shuffle_hash"), "logical_path", "left_semi")
    W.refresh(spark, where, "tick 1", live, at("2024-01-20 02:00:00"))
    again = W.due(snapshot(spark, where), at("2024-01-20 02:00:00")).select("logical_path", F.lit(True).alias("due"))
    again = again.unionByName(W.due(W.refresh(spark, where, "tick 2", live, at("2024-01-20 04:00:00")), at("2024-01-20 04:00:00")).select("logical_path", F.lit(True).alias("due"))).distinct()
    files = W.with_status(snapshot(spark, where))
    counts = files.groupBy("logical_path").agg(F.count("*").alias("versions"))
    rows = S.current(files).join(counts, "logical_path").join(again, "logical_path", "left")
    return rows.select("logical_path", "content_sha256", "versions", F.col("last_refresh_status").alias("status"), "refreshed_at", F.coalesce("due", F.lit(False)).alias("due"))


# The search text of a document that is one chunk: path, the start of the text as description, the text.
V_SEARCHED = r"""searched as (select logical_path, logical_path || chr(10) || case when body <> '' then body else logical_path || ' (text/markdown)' end || chr(10) || chr(10) || content as text from
  (select *, trim(regexp_replace(substr(regexp_replace(content, '^\s+|\s+$', '', 'g'), 1, 200), '\s+', ' ', 'g')) as body from v_later))"""


@query(f"""with {V_DOCS}, {V_LATER}, {V_SEARCHED}, golden as (select item_id as query_id, text as query from benchmark), {BM25.replace('doc_id as key', 'logical_path as key').replace('from documents', 'from searched')}
  select query_id, key as logical_path, score, rank::int as rank from kw where rank <= 10""")
def index_after_commits(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark passages against the index that two commits have left, a document a chunk; no text is read."""
    where = _two_states(spark, d, W.Settings(chunks=C.Config(target=1 << 30, longest=1 << 30, by_heading=False)))
    return index.search(snapshot(spark, where), read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))).select("query_id", "logical_path", "score", "rank")


def _talks(name: str) -> contract.Source:
    """Conversations as documents: a page a turn, and the length of all turns in place of a modification time."""
    path = F.concat(F.lit("talks/"), F.col("conv_id").cast("string"), F.lit(".md"))

    def listed(spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.read.parquet(folder).groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("source_mtime_ms"))
        return rows.select(path.alias("logical_path"), F.concat(F.lit("talk:"), F.col("conv_id").cast("string")).alias("source_path"), "source_mtime_ms")

    def fetched(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
        rows = spark.read.parquet(folder).select(path.alias("logical_path"), F.col("turn").alias("page_no"), "text").join(entries.select("logical_path"), "logical_path", "left_semi")
        pages = V.pages_to_markdown(rows.withColumnRenamed("logical_path", "doc"))
        return pages.select(F.col("doc").alias("logical_path"), F.encode("markdown", "UTF-8").alias("bytes"), F.lit("text/markdown").alias("mime_type"), F.lit(None).cast("string").alias("error"))

    return contract.Source(name, listed, fetched, lambda folder: F.col("logical_path").startswith("talks/"))


@query("""with t as (select *, max(turn) over (partition by conv_id) as most from conversations),
  a as (select conv_id, sum(length(text)) as stamp from t where most < 6 group by 1),
  b as (select conv_id, sum(length(text)) as stamp, string_agg('## Page ' || turn || chr(10) || chr(10) || trim(text), chr(10) || chr(10) order by turn, '## Page ' || turn || chr(10) || chr(10) || trim(text)) as markdown
    from t where most > 1 and role <> 'system' group by 1)
  select 'talks/' || coalesce(a.conv_id, b.conv_id) || '.md' as logical_path, b.conv_id is null as tombstone, sha256(b.markdown) as content_sha256,
    case when b.conv_id is null then null when a.stamp = b.stamp then 'unchanged' else 'ok' end as outcome, a.stamp is not distinct from b.stamp as probed from a full join b on a.conv_id = b.conv_id""")
def source_probe_and_sync(spark: SparkSession, d: str) -> DataFrame:
    """A registered source in two states, the second with sync: long conversations are new, system turns are taken out, and
    short conversations are gone; what the probe finds unchanged is not read."""
    talks = read(spark, d, "conversations").withColumn("most", F.max("turn").over(Window.partitionBy("conv_id")))
    where = f"{shared_dir(spark)}/talks-{uuid.uuid4().hex}"
    for state, rows in (("a", talks.filter("most < 6")), ("b", talks.filter("most > 1 and role <> 'system'"))):
        rows.drop("most").write.parquet(f"{where}/{state}")
    contract.register(_talks("talks"))
    contract.add(spark, f"{where}/store", "a", f"talks:{where}/a", at(CUT))
    now = contract.add(spark, f"{where}/store", "b", f"talks:{where}/b", at(NOW), sync=True)
    told = now.read("outcomes").filter("key = 'b'").select("logical_path", F.col("status").alias("outcome"), F.col("source_sha256").isNull().alias("probed"))
    rows = S.latest(now.read("files")).join(told, "logical_path", "left")
    return rows.select("logical_path", "tombstone", "content_sha256", "outcome", F.coalesce("probed", F.lit(False)).alias("probed"))


@query()
def reindex_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents' chunks built anew for smaller chunks: their number and the least and greatest length by path."""
    files = v_docs(spark, d).select("logical_path", at(CUT).alias("version_id"), F.lit(False).alias("tombstone"), F.lit("").alias("description"), "content")
    rows = W.rechunk(files, W.Settings(chunks=C.Config(target=400, longest=600)))
    return rows.groupBy("logical_path").agg(F.count("*").alias("chunks"), F.min(F.char_length("chunk_content")).alias("least"), F.max(F.char_length("chunk_content")).alias("most"))


# Paths and urls.


@query(r"""select page_id, 'remotes/' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) || '/' ||
  case when p = '' then 'index' else p end as logical_path from (select *, trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/') as p from pages)""")
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.path_for_url(F.col("url")).alias("logical_path"))


RULES = (routes.Rule("mobile", r"^https?://m\.(?<host>[^/]+)/"), routes.Rule("blog", r"^https?://blog\.(?<host>[^/]+)/(?<lang>[a-z]{2})/"), routes.Rule("secure", r"^https://(?<host>[^/]+)/"))


@query(r"""select page_id, case when regexp_matches(url, '^https?://m\.([^/]+)/') then 'mobile' when regexp_matches(url, '^https?://blog\.([^/]+)/([a-z]{2})/') then 'blog'
  when regexp_matches(url, '^https://([^/]+)/') then 'secure' end as rule, regexp_extract(url, '^https?://blog\.([^/]+)/([a-z]{2})/', 2) as lang from pages""")
def route_urls(spark: SparkSession, d: str) -> DataFrame:
    routes.validate(RULES)
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", routes.route(url, RULES).alias("rule"), F.element_at(routes.variables(url, RULES[1]), "lang").alias("lang"))


@query(r"""select page_id, rtrim(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-') as slug from pages""")
def slug_paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


TREE = """tree as (select array_to_string(p[1:depth], '/') as node, depth, bool_or(len(p) = depth or depth = 6) as is_file, count(*) as files
  from (select p, unnest(range(1, least(len(p), 6) + 1))::int as depth from (select list_filter(string_split(logical_path, '/'), lambda x: x <> '') as p from cur)) group by 1, 2)"""


@query(f"with {V_FILES}, {TREE} select node, depth, is_file, files from tree")
def path_tree(spark: SparkSession, d: str) -> DataFrame:
    return S.path_tree(S.current(v_files(spark, d)))


@query(f"""with {V_FILES}, {TREE}, t as (select *, case when depth = 1 then '' else regexp_replace(node, '/[^/]*$', '') end as parent from tree),
  q as (select *, row_number() over (partition by parent order by node) as q, greatest(count(*) over (partition by parent) - 20, 0) as dropped from t)
  select node, depth, is_file, files, parent, dropped from q where q <= 20""")
def path_tree_truncated(spark: SparkSession, d: str) -> DataFrame:
    return S.truncate_tree(S.path_tree(S.current(v_files(spark, d))))


@query()
def diff_versions(spark: SparkSession, d: str) -> DataFrame:
    return S.diff_versions(v_conv(spark, d))


# Texts.


@query(rf"""with {V_DOCS}, x as (select doc_id, case when doc_id % 3 = 0 then '# About ' || lang || ' ##' || chr(10) || content else content end as text, doc_id % 3 = 0 as titled, lang, content, logical_path from v_docs),
  y as (select *, trim(regexp_replace(substr(regexp_replace(content, '^\s+|\s+$', '', 'g'), 1, 200), '\s+', ' ', 'g')) as body from x)
  select doc_id, case when titled and lang is not null then 'About ' || lang || case when body <> '' then ' — ' || body else '' end when body <> '' then body else logical_path || ' (text/markdown)' end as description from y""")
def describe_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every third document with a title in front."""
    title = F.concat(F.lit("# About "), F.col("lang"), F.lit(" ##\n"))
    text = F.when((F.col("doc_id") % 3 == 0) & F.col("lang").isNotNull(), F.concat(title, "content")).otherwise(F.col("content"))
    return v_docs(spark, d).select("doc_id", T.describe(F.col("logical_path"), F.lit("text/markdown"), text).alias("description"))


@query(f"with {V_DOCS} select doc_id, sha256(logical_path || chr(10) || coalesce(lang, '') || chr(10) || chr(10) || content) as sha from v_docs")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return v_docs(spark, d).select("doc_id", F.sha2(T.search_text(F.col("logical_path"), F.col("lang"), F.col("content")), 256).alias("sha"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as lines from documents")
def slice_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.slice_lines(F.col("text"), 2, 3).alias("lines"))


TERMS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9_]+'), lambda x: length(x) >= 3 and x not in (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))"
FIRST_TEN = "list_filter({0}, lambda x, i: list_position({0}, x) = i)[1:10]"


@query(f"""select item_id, array_to_string({FIRST_TEN.format('t')}, ' ') as terms from (select item_id, {TERMS.format('text')} as t from benchmark)""")
def snippet_terms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.snippet_terms(F.col("text")), " ").alias("terms"))


# Where a snippet of z(text, p) begins, p being the first term's place or null, and the snippet itself.
SNIPPET = """s as (select *, p - 100 as s from z), g as (select *, nullif(strpos(substr(text, s), ' '), 0) + s - 1 as g from s),
  b as (select *, case when p is null or p <= 101 then 1 when g < p then g + 1 else s end as b from g)"""
CUT_OUT = "(case when b > 1 then '…' else '' end) || substr(text, b, 300) || (case when b + 300 <= length(text) then '…' else '' end) as snippet"


@query(f"with z as (select doc_id, text, nullif(strpos(lower(text), 'nd'), 0) as p from documents), {SNIPPET} select doc_id, {CUT_OUT} from b")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.make_snippet(F.col("text"), F.array(F.lit("nd"))).alias("snippet"))


@query(r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160) || '‘’‚‛“”„‟–—', ' ' || repeat(chr(39), 4) || repeat(chr(34), 4) || '--'), '(?m)[ \t]+$', '', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as sha from documents""")
def docmd_normalize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(T.normalize_docmd(F.col("text")), 256).alias("sha"))


@query(r"""select page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g')) as sha from pages""")
def strip_html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.sha2(T.strip_html_blocks(F.col("html")), 256).alias("sha"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", V.html_to_markdown(F.col("html")).alias("markdown"))


@query(r"""with p as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g') as h from pages)
  select page_id, len(regexp_extract_all(h, '(?i)<h1[ >]')) as headings, len(regexp_extract_all(h, '(?i)<li[ >]')) as items, len(regexp_extract_all(h, '(?i)<a [^>]*href=')) as links, len(regexp_extract_all(h, '(?i)<img ')) as images from p""")
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    """What of each page's structure its markdown has: headings, list items, links and images, as many as its elements."""
    count = lambda pattern: F.regexp_count("m", F.lit(pattern)).cast("long")
    rows = read(spark, d, "pages").select("page_id", V.html_to_markdown(F.col("html")).alias("m"))
    return rows.select("page_id", count(r"(?m)^# ").alias("headings"), count(r"(?m)^ *-   ").alias("items"), count(r"(?<![\\!])\[[^\]]*\]\(").alias("links"), count(r"!\[[^\]]*\]\(").alias("images"))


@query(f"with {V_DOCS} select logical_path, i::int as chunk_index, substr(content, i * 1800 + 1, 1800) as chunk_content from (select *, unnest(range(0, greatest(ceil(length(content) / 1800.0), 1)::int)) as i from v_docs)")
def chunk_hard_cut(spark: SparkSession, d: str) -> DataFrame:
    return C.hard_cut(v_docs(spark, d), 1800)


@query(f"""with {V_DOCS}, c as (select logical_path, i::int as chunk_index, substr(content, i * 1800 + 1, 1800) as c from (select *, unnest(range(0, greatest(ceil(length(content) / 1800.0), 1)::int)) as i from v_docs)),
  l as (select *, string_split(lag(c) over (partition by logical_path order by chunk_index), chr(10)) as b from c)
  select logical_path, chunk_index, case when b is null then c else array_to_string(b[greatest(len(b) - 1, 1):len(b)], chr(10)) || chr(10) || c end as chunk_content from l""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.add_overlap(C.hard_cut(v_docs(spark, d), 1800))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(v_docs(spark, d))


def _markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("logical_path"), V.html_to_markdown(F.col("html")).alias("content"))


@query()
def chunk_markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Converted pages, packed by section, with their breadcrumbs."""
    return C.chunk_documents(_markdown_pages(spark, d), C.Config(target=500, longest=700))


@query()
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.section_lines(_markdown_pages(spark, d)).groupBy("logical_path", "section").agg(F.count("*").alias("lines"), F.count_if("in_fence").alias("fenced"))


# Retrieval.


@query(f"with {V_GOLDEN}, {BM25} select query_id, key, score, rank::int as rank from kw where rank <= 10")
def bm25_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), v_golden(spark, d))


@query(f"with golden as (select 0::bigint as query_id, 'thandha the ononed attion' as query), {BM25} select key, score, rank::int as rank from kw where rank <= 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    one = spark.sql("select 0L as query_id, 'thandha the ononed attion' as query")
    return R.bm25(read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), one, 20).select("key", "score", "rank")


@query(f"with {V_GOLDEN}, {SEM} select query_id, key, score, rank::int as rank from sem where rank <= 10")
def semantic_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic(read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding"), v_golden(spark, d).select("query_id", "vector"))


@query(f"with golden as (select vec_id as query_id, embedding as vector from embeddings where vec_id = (select min(vec_id) from embeddings)), {SEM} select key, score, rank::int as rank from sem where rank <= 20")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    one = rows.orderBy("key").limit(1).select(F.col("key").alias("query_id"), F.col("embedding").alias("vector"))
    return R.semantic(rows, one, 20).select("key", "score", "rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    docs, vectors, g = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding"), v_golden(spark, d)
    return R.fuse(R.semantic(vectors, g.select("query_id", "vector"), 50), R.bm25(docs, g.select("query_id", "query"), 50), 0.6, depth=30)


@query(f"with {V_GOLDEN}, {BM25}, {SEM}, {FUSED} select query_id, key, score, rank::int as rank from fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "key", "score", "rank")


DIVERSE = """diverse as (select * from (select *, row_number() over (partition by query_id order by many and within > 3, rank) as final_rank from (
  select f.*, d.source || '/' || d.lang || '.md' as logical_path, d.text, row_number() over (partition by query_id, d.source, d.lang order by rank) as within, count(*) over (partition by query_id) > 10 as many
  from fused f join documents d on d.doc_id = f.key)) where final_rank <= 10)"""


@query(f"with {V_GOLDEN}, {BM25}, {SEM}, {FUSED}, {DIVERSE} select query_id, key, logical_path, final_rank::int as final_rank from diverse")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat("source", F.lit("/"), "lang", F.lit(".md")).alias("logical_path"))
    return R.diversify(docs.join(_fused(spark, d), "key"), 10).select("query_id", "key", "logical_path", "final_rank")


@query(f"with {V_GOLDEN}, {BM25}, {SEM}, {FUSED}, {DIVERSE} select query_id, logical_path, key, final_rank::int as final_rank, score, semantic, keyword from diverse")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat("source", F.lit("/"), "lang", F.lit(".md")).alias("logical_path"), "text")
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return R.search(docs, vectors, v_golden(spark, d)).drop("snippet")


@query(f"""with {V_GOLDEN}, {BM25}, {SEM}, {FUSED}, {DIVERSE}, t as (select d.query_id, d.key, d.final_rank, d.text, {TERMS.format('g.query')} as t from diverse d join golden g using (query_id)),
  z as (select *, list_min(list_filter(list_transform({FIRST_TEN.format('t')}, lambda x: strpos(lower(text), x)), lambda x: x > 0)) as p from t), {SNIPPET}
  select query_id, key, final_rank::int as final_rank, {CUT_OUT} from b""")
def hybrid_search_snippets(spark: SparkSession, d: str) -> DataFrame:
    return R.search(*_searched(spark, d), v_golden(spark, d)).select("query_id", "key", "final_rank", "snippet")


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat("source", F.lit("/"), "lang", F.lit(".md")).alias("logical_path"), "text")
    return docs, read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")


ONE_SIDE = """fused as (select query_id, key, {0} as semantic, {1} as keyword, round(1.0::double / (60 + rank) * 61, 6) as score, rank from {2} where rank <= 30)"""


@query(f"with {V_GOLDEN}, {BM25}, {ONE_SIDE.format('null::double', 'score', 'kw')}, {DIVERSE} select query_id, logical_path, key, final_rank::int as final_rank, score, keyword from diverse")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(*_searched(spark, d), v_golden(spark, d), mode="keyword").select("query_id", "logical_path", "key", "final_rank", "score", "keyword")


@query(f"with {V_GOLDEN}, {SEM}, {ONE_SIDE.format('score', 'null::double', 'sem')}, {DIVERSE} select query_id, logical_path, key, final_rank::int as final_rank, score, semantic from diverse")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(*_searched(spark, d), v_golden(spark, d), mode="semantic").select("query_id", "logical_path", "key", "final_rank", "score", "semantic")


RERANK = """q as (select c.*, list_distinct(list_filter(string_split_regex(lower(query), '[^a-z]+'), lambda x: x <> '')) as qt, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as dt from c),
  s as (select *, round(1 / (1 + exp(-(len(list_intersect(qt, dt)) / greatest(len(qt), 1) * 8 - 4))), 6) as rerank_score from q)"""


@query(f"""with {V_GOLDEN}, {BM25}, {SEM}, f as (with {FUSED} select * from fused), c as (select f.query_id, f.key, f.score, f.rank as old, g.query, d.text from f join golden g using (query_id) join documents d on d.doc_id = f.key),
  {RERANK}, fused as (select query_id, key, score, rerank_score, row_number() over (partition by query_id order by rerank_score desc, old) as rank from s), {DIVERSE}
  select query_id, key, final_rank::int as final_rank, rerank_score from diverse""")
def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(*_searched(spark, d), v_golden(spark, d), scorer=R.lexical_score).select("query_id", "key", "final_rank", "rerank_score")


@query(f"with {V_GOLDEN}, {BM25} select query_id, key, score, rank::int as rank from kw where rank <= 10")
def bm25_stored_index(spark: SparkSession, d: str) -> DataFrame:
    """From postings that are written first: a search reads no text."""
    where = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    R.term_statistics(docs)[0].write.parquet(f"{where}/postings")
    R.statistics_of(docs, spark.read.parquet(f"{where}/postings")).write.parquet(f"{where}/corpus")
    return R.bm25_of_index(spark.read.parquet(f"{where}/postings"), spark.read.parquet(f"{where}/corpus"), v_golden(spark, d))


@query(f"""with {V_GOLDEN}, {BM25}, c as (select k.*, g.query, d.text from kw k join golden g using (query_id) join documents d on d.doc_id = k.key where rank <= 30), {RERANK}
  select query_id, key, rerank_score, (row_number() over (partition by query_id order by rerank_score desc, rank))::int as rerank_rank from s""")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    docs, g = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), v_golden(spark, d).select("query_id", "query")
    hits = R.bm25(docs, g, 30).join(g, "query_id")
    return R.rerank(docs.join(hits, "key")).select("query_id", "key", "rerank_score", "rerank_rank")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    docs, g = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), v_golden(spark, d).select("query_id", "query")
    expected = R.containing(docs, g.select("query_id", F.col("query").alias("passage"))).groupBy("query_id").agg(F.min("key").alias("expected"))
    golden = expected.withColumn("kind", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    return R.expected_rank(R.bm25(docs, g, 10), golden)


GOLDEN_RANKS = f"""{V_GOLDEN}, {BM25}, e as (select query_id, min(doc_id) as expected from golden join documents on contains(text, query) group by 1),
  r as (select e.query_id, case when e.query_id % 2 = 0 then 'even' else 'odd' end as kind, coalesce(min(k.rank), 0) as rank from e left join kw k on k.query_id = e.query_id and k.key = e.expected and k.rank <= 10 group by 1, 2)"""


@query(f"""with {GOLDEN_RANKS}
  select coalesce(kind, 'overall') as kind, count(*) as n, round(avg((rank between 1 and 1)::int), 6) as recall_1, round(avg((rank between 1 and 3)::int), 6) as recall_3,
    round(avg((rank between 1 and 5)::int), 6) as recall_5, round(avg(case when rank > 0 then 1.0::double / rank else 0 end), 6) as mrr from r group by rollup(kind)""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.metrics(_ranked(spark, d))


@query(f"""with {GOLDEN_RANKS}, m as (select round(avg((rank between 1 and 1)::int), 6) as recall_1, round(avg((rank between 1 and 3)::int), 6) as recall_3, round(avg(case when rank > 0 then 1.0::double / rank else 0 end), 6) as mrr from r)
  select * from (select 'recall_1' as metric, recall_1 as value, 0.9::double as threshold from m union all select 'recall_3', recall_3, 0.95 from m union all select 'mrr', mrr, 0.93 from m) where value < threshold""")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.gate(R.metrics(_ranked(spark, d)), {"recall_1": 0.90, "recall_3": 0.95, "mrr": 0.93})


@query(f"""with {V_GOLDEN}, {BM25}, e as (select query_id, min(doc_id) as expected from golden join documents on contains(text, query) group by 1),
  v as (select e.query_id, d as depth, coalesce(min(k.rank), 0) as rank from e cross join (select unnest([3, 10]) as d) left join kw k on k.query_id = e.query_id and k.key = e.expected and k.rank <= d group by 1, 2)
  select 'top' || depth as variant, count(*) as n, round(avg((rank between 1 and 5)::int), 6) as recall_5, round(avg(case when rank > 0 then 1.0::double / rank else 0 end), 6) as mrr from v group by depth""")
def eval_variants(spark: SparkSession, d: str) -> DataFrame:
    """Two settings over one golden set."""
    docs, g = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), v_golden(spark, d).select("query_id", "query")
    golden = R.containing(docs, g.select("query_id", F.col("query").alias("passage"))).groupBy("query_id").agg(F.min("key").alias("expected")).withColumn("kind", F.lit("all"))
    rows = R.compare_variants({f"top{k}": R.bm25(docs, g, k) for k in (3, 10)}, golden)
    return rows.filter("kind = 'overall'").select("variant", "n", "recall_5", "mrr")


@query()
def eval_chunk_variants(spark: SparkSession, d: str) -> DataFrame:
    """Three variants of chunking and reranking over one golden set of whole passages, with answer@3."""
    docs = v_docs(spark, d).select("logical_path", F.coalesce("content", F.lit("")).alias("content"))
    passages = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    holding = R.containing(docs.select(F.col("logical_path").alias("key"), F.col("content").alias("text")), passages.withColumnRenamed("query", "passage"))
    golden = holding.groupBy("query_id").agg(F.min("key").alias("expected")).join(passages, "query_id").withColumns({"kind": F.lit("passage"), "answer": F.substring("query", 1, 30)})
    variants = (E.Variant("whole", C.Config(4000, 15000, by_heading=False)), E.Variant("current"), E.Variant("rerank", scorer=R.lexical_score))
    where = f"{shared_dir(spark)}/variants-{uuid.uuid4().hex}"
    golden.write.parquet(f"{where}/golden")
    return E.compared(docs, spark.read.parquet(f"{where}/golden"), variants, f"{where}/chunks").filter("kind = 'overall'")


# Rendering.


@query("""with c as (select l_orderkey, count(*) as n, string_agg('### @part ' || l_partkey || ' — ' || l_linenumber || chr(10) || chr(10) || l_returnflag, chr(10) || chr(10) order by l_linenumber, l_partkey, l_returnflag) as body,
    '  - ' || string_agg(distinct l_returnflag, chr(10) || '  - ' order by l_returnflag) as labels from lineitem group by 1)
  select o_orderkey, '---' || chr(10) || 'source_url: https://e.org/' || o_orderkey || chr(10) || 'number: ' || o_orderkey || chr(10) || 'kind: issue' || chr(10) || 'title: Order ' || o_orderkey || chr(10) || 'state: ' || o_orderstatus
    || coalesce(chr(10) || 'labels:' || chr(10) || labels, '') || chr(10) || 'created_at: ' || chr(39) || strftime(o_orderdate, '%Y-%m-%d') || chr(39) || chr(10) || '---' || chr(10) || '# Issue #' || o_orderkey || ': Order ' || o_orderkey
    || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || o_orderpriority || coalesce(chr(10) || chr(10) || '## Comments (' || n || ')' || chr(10) || chr(10) || body, '') as markdown from orders left join c on o_orderkey = l_orderkey""")
def issue_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders as issues, their items as comments and labels."""
    lines = read(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f")).alias("x"))
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    comments = F.transform("x", lambda x: F.struct(F.concat(F.lit("part "), x["p"].cast("string")).alias("author"), x["n"].cast("string").alias("created_at"), x["f"].alias("body")))
    key, none = F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    rows = read(spark, d, "orders").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.concat(F.lit("https://e.org/"), key).alias("html_url"), F.col("o_orderkey").alias("number"), F.lit(False).alias("is_pull"), F.concat(F.lit("Order "), key).alias("title"), F.col("o_orderpriority").alias("body"),
        F.col("o_orderstatus").alias("state"), F.lit(None).cast("boolean").alias("draft"), none.alias("author"), F.array().cast("array<string>").alias("assignees"), F.array_sort(F.array_distinct("x.f")).alias("labels"),
        none.alias("milestone"), none.alias("due_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), none.alias("updated_at"), none.alias("closed_at"),
        F.array().cast("array<struct<kind:string,number:long>>").alias("links"), comments.alias("comments"),
    )
    return V.issues_to_markdown(rows).select("o_orderkey", "markdown")


@query("""with c as (select l_orderkey as doc, l_linenumber as r, min(l_partkey)::varchar as a, min(l_returnflag) as b from lineitem group by 1, 2),
  m as (select doc, unnest(range(min(r), max(r) + 1)) as r, min(r) as r0 from c group by 1)
  select m.doc, string_agg('| ' || coalesce(a, '') || ' | ' || coalesce(b, '') || ' |' || case when m.r = r0 then chr(10) || '| --- | --- |' else '' end, chr(10) order by m.r) as markdown from m left join c on c.doc = m.doc and c.r = m.r group by 1""")
def cells_to_table(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a sheet: a row for each line number from its least to its greatest, empty where it has none."""
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    tasks = max(spark.sparkContext.defaultParallelism, -(-items.count() // TASK_ROWS))
    lines = items.repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))
    cell = lambda i, v: F.struct(F.lit(i).alias("col"), F.col(v).cast("string").alias("value"))
    cells = lines.select(F.col("l_orderkey").alias("doc"), F.lit("s").alias("sheet"), F.col("l_linenumber").cast("int").alias("row"), F.inline(F.array(cell(1, "l_partkey"), cell(2, "l_returnflag"))))
    return V.cells_to_table(cells).select("doc", "markdown")


@query("""select conv_id as doc, string_agg('## Page ' || turn || chr(10) || chr(10) || trim(text), chr(10) || chr(10) order by turn, '## Page ' || turn || chr(10) || chr(10) || trim(text)) as markdown from conversations group by 1""")
def pages_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return V.pages_to_markdown(read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text"))


@query(r"""with l as (select conv_id as doc, turn // 2 as slide, turn as pos, role, unnest(range(0, len(string_split(text, chr(10))))) as part, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) as t from conversations),
  p as (select doc, slide, min((pos, part)) filter (t <> '' and role = 'user') as own, min((pos, part)) filter (t <> '') as any_ from l group by 1, 2),
  u as (select l.*, own, coalesce(own, any_) as picked, coalesce(case when own is not null then pos = own[1] else (pos, part) = any_ end, false) as used from l join p using (doc, slide)),
  s as (select *, sum((not used)::int) over (partition by doc, slide, pos) > 1 as several from u),
  b as (select doc, slide, pos, string_agg(case when role <> 'user' and several then '- ' || t else t end, chr(10) order by part) as block from s where not used and t <> '' group by 1, 2, 3),
  k as (select doc, slide, string_agg(block, chr(10) || chr(10) order by pos) as body from b group by 1, 2),
  h as (select doc, slide, min(t) filter ((pos, part) = picked) as title from s group by 1, 2)
  select doc, string_agg('## Slide ' || slide || coalesce(': ' || title, '') || coalesce(chr(10) || chr(10) || body, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by slide) as markdown from h left join k using (doc, slide) group by 1""")
def slides_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as decks, two turns a slide: user turns are title shapes, the others body shapes, a paragraph a line."""
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 2).alias("slide"), F.col("turn").alias("position"), "role", F.posexplode(F.split("text", "\n")).alias("part", "text"))
    shapes = rows.select("doc", "slide", "position", "part", F.lit("shape").alias("kind"), F.when(F.col("role") == "user", "title").otherwise("body").alias("placeholder"), F.lit(0).alias("level"), F.lit(False).alias("bullet"), "text", F.array().cast("array<string>").alias("cells"))
    return V.slides_to_markdown(shapes)


# Streaming.


@query(f"with {V_FILES} select logical_path, version_id, event_id, size_bytes from cur")
def stream_ingest_current(spark: SparkSession, d: str) -> DataFrame:
    """events replayed as a stream of files into a store, and the store's current view."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = read(spark, d, "events")
    stream = spark.readStream.schema(source.schema).format("parquet").load(f"{d}/event[s].parquet")
    run = ingest.append_stream(stream, f"{where}/store", f"{where}/checkpoint", lambda b: _as_files(b))
    run.awaitTermination()
    return ingest.current_from(spark, f"{where}/store").select(*KEYS, "size_bytes")


@query(f"with {V_FILES} select logical_path, version_id, event_id, size_bytes, tombstone from latest")
def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream in no order and many batches; the state of each path is its latest version."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    shuffled = _as_files(read(spark, d, "events")).repartition(6, F.xxhash64("event_id"))
    shuffled.write.parquet(f"{where}/in")
    stream = spark.readStream.schema(shuffled.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    held = spark.conf.get(latest.PROVIDER[0])
    spark.conf.set(*latest.PROVIDER)
    try:
        ingest.append_stream(latest.latest_stream(stream), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(latest.PROVIDER[0], held)
    return latest.last_updates(spark.read.parquet(f"{where}/out")).select(*KEYS, "size_bytes", "tombstone")


def _as_files(batch: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    path = F.concat(F.col("event_type"), F.lit("/user-"), F.col("user_id").cast("string"), F.lit(".md"))
    return batch.withColumn("k", k).select(path.alias("logical_path"), F.col("ts").alias("version_id"), "event_id", (F.col("k") % 10 == 0).alias("tombstone"), F.floor(F.col("value") * 100).cast("long").alias("size_bytes"))

