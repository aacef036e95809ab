"""Registered queries of the forms for sizes beyond a row, a table rewrite or one literal, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import logs, logscan, repomap, search, store, symbol_join
from ..sources import files as sources
from . import catalogue as c
from .registry import query, table

# --- logs of any length: a log a return flag, in chunks of orders ------------------------------------------------

CHUNK_ORDERS, GUARD = 500, (4000, 1500, 700)


def _lines_sql(kind: str) -> str:
    return f"t AS (SELECT l_returnflag AS log_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos, {c._case(kind)} AS line FROM lineitem)"


def long_logs(spark, sf_dir, kind: str) -> DataFrame:
    line = F.expr(c._case(kind).replace("VARCHAR(20)", "STRING"))
    pos = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("log_id"), F.expr(f"l_orderkey div {CHUNK_ORDERS}").cast("long").alias("chunk"), pos.alias("pos"), line.alias("line"))


def _settings(lines: DataFrame, hint: str, exit_code: int = 0) -> DataFrame:
    return lines.select("log_id").distinct().select("log_id", F.lit(hint).alias("type_hint"), F.lit(exit_code).alias("exit_code"), F.lit(False).alias("bypass"))


def _kept(spark, sf_dir, kind: str, hint: str) -> DataFrame:
    lines = long_logs(spark, sf_dir, kind)
    return logscan.prune_lines(lines, _settings(lines, hint))[0]


_CARGO = f"""{_lines_sql('cargo_test')}, e AS (SELECT *, CASE WHEN regexp_matches({c._BARE}, '^(error|failures:|----|FAILED)') THEN 1 WHEN {c._BARE} LIKE 'test result:%' THEN 0 END AS ev, {c._BARE} AS bare FROM t),
i AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY pos), 0) = 1 OR bare LIKE 'test result:%' OR bare LIKE 'warning:%' AS keep FROM e)"""


@query(f"WITH {_CARGO} SELECT log_id, pos AS line_no, line FROM i WHERE keep")
def log_scan_cargo_test(spark, sf_dir):
    return _kept(spark, sf_dir, "cargo_test", "auto")


@query(f"""WITH {_CARGO}, s AS (SELECT log_id, count(*) AS n_lines, count(*) FILTER (WHERE keep) AS n_kept, sum(length(line) + 1) - 1 AS raw, sum(length(line) + 1) FILTER (WHERE keep) - 1 AS kept FROM i GROUP BY 1)
SELECT log_id, 'cargo_test' AS kind, n_lines, n_kept, greatest(1, raw // 4)::BIGINT AS orig_tokens, greatest(1, kept // 4)::BIGINT AS new_tokens FROM s""")
def log_scan_summary(spark, sf_dir):
    lines = long_logs(spark, sf_dir, "cargo_test")
    return logscan.prune_lines(lines)[1].select("log_id", "kind", "n_lines", "n_kept", "orig_tokens", "new_tokens")


@query(f"""WITH {_lines_sql('pytest')}, i AS (SELECT *, max(regexp_matches(line, '=+ (FAILURES|ERRORS|short test summary info) =+|^ERROR collecting ')::INT) OVER (PARTITION BY log_id ORDER BY pos) = 1 AS sec FROM t)
SELECT log_id, pos AS line_no, line FROM i WHERE sec OR (NOT {c._PASS} AND NOT {c._FAIL} AND {c._FRAME})""")
def log_scan_pytest(spark, sf_dir):
    return _kept(spark, sf_dir, "pytest", "pytest")


@query(f"""WITH {_lines_sql('pytest_states')}, e AS (SELECT *, CASE WHEN {c._ON} THEN 1 WHEN {c._OFF} THEN 0 END AS ev FROM t),
i AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY pos), 0) = 1 AS sec FROM e)
SELECT log_id, pos AS line_no, line FROM i WHERE sec OR {c._STAYS} OR (NOT ({c._GOING}) AND (regexp_matches(line, '^\\s*(warning:|AssertionError)') OR contains(line, 'passed in')))
UNION ALL SELECT log_id, max(pos) + 1, 'pytest: ' || count(*) FILTER (WHERE regexp_matches(line, '^\\s*FAILED ')) || ' FAILED, ' || count(*) FILTER (WHERE NOT sec AND NOT {c._STAYS} AND {c._GOING}) || ' passed (repetitive logs pruned)' FROM i GROUP BY 1""")
def log_scan_pytest_states(spark, sf_dir):
    return _kept(spark, sf_dir, "pytest_states", "pytest-states")


@query(f"""WITH {_lines_sql('npm')}, w AS (SELECT log_id, string_agg(line, chr(10) ORDER BY pos) AS x FROM t GROUP BY 1)
SELECT log_id, CASE WHEN length(x) > {GUARD[0]} THEN x[1:{GUARD[1]}] || chr(10) || chr(10) || '... [truncated ' || (length(x) - {sum(GUARD[1:])}) || ' characters] ...' || chr(10) || chr(10) || x[length(x) - {GUARD[2] - 1}:] ELSE x END AS raw FROM w""")
def log_scan_guard(spark, sf_dir):
    """Start and end of logs of any length, read without putting a whole log together."""
    return logscan.guarded(long_logs(spark, sf_dir, "npm"), *GUARD)


@query(f"""WITH {_lines_sql('npm')}, w AS (SELECT log_id, string_agg(line, chr(10) ORDER BY pos) AS x FROM t GROUP BY 1),
g AS (SELECT log_id, CASE WHEN length(x) > {GUARD[0]} THEN x[1:{GUARD[1]}] || chr(10) || chr(10) || '... [truncated ' || (length(x) - {sum(GUARD[1:])}) || ' characters] ...' || chr(10) || chr(10) || x[length(x) - {GUARD[2] - 1}:] ELSE x END AS raw FROM w),
l AS (SELECT log_id, raw, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS pos FROM g),
f AS (SELECT log_id, any_value(raw) AS raw, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT ({c._DROP['npm']})), '') AS filtered FROM l GROUP BY 1)
SELECT log_id, filtered, greatest(1, length(raw) // 4)::BIGINT AS orig_tokens, greatest(1, length(filtered) // 4)::BIGINT AS new_tokens FROM f""")
def log_scan_guarded_prune(spark, sf_dir):
    """Guarded at reading, then pruned as rows."""
    lines = long_logs(spark, sf_dir, "npm")
    rows = logscan.guarded(lines, *GUARD).join(_settings(lines, "npm"), "log_id")
    return logs.prune(rows).select("log_id", "filtered", "orig_tokens", "new_tokens")


# --- similar names for many queries, and the index of trigrams ----------------------------------------------------

TYPO = f"replace({c.NAME}, 'l', '')"
#: Distinct words of conversations beside the symbols of part; queries: the symbols' names with letters left out.
_NAMES = f"n AS (SELECT DISTINCT {c.NAME} AS name FROM part UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_]+')) FROM conversations), q AS (SELECT DISTINCT {TYPO} AS query FROM part)"
_BARE = "regexp_replace(lower({}), '[_\\-\\s]', '', 'g')"
_PAIRS = f"""f AS (SELECT query, name, lower(query) AS q, lower(name) AS t, {_BARE.format('query')} AS qc, {_BARE.format('name')} AS tc FROM q, n WHERE query <> '' AND name <> ''),
z AS (SELECT *, least(length(qc), length(tc))::DOUBLE / greatest(length(qc), length(tc), 1) AS r, CASE WHEN length(q) >= 3 AND length(t) >= 3 THEN 2.0::DOUBLE * len(list_intersect({c._tri('q')}, {c._tri('t')})) / (len({c._tri('q')}) + len({c._tri('t')})) ELSE 0 END AS dice FROM f),
y AS (SELECT query, name, round(CASE WHEN q = t THEN 1.0::DOUBLE WHEN qc = tc THEN 0.98::DOUBLE ELSE greatest(CASE WHEN qc <> '' AND tc <> '' AND (contains(qc, tc) OR contains(tc, qc)) AND r >= 0.4 THEN 0.75::DOUBLE + 0.20::DOUBLE * r ELSE 0 END,
  1.0::DOUBLE - levenshtein(q, t)::DOUBLE / greatest(length(q), length(t), 1), 1.0::DOUBLE - levenshtein(qc, tc)::DOUBLE / greatest(length(qc), length(tc), 1), dice) END, 6) AS score FROM z)"""


def _typos(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(TYPO).alias("name")).distinct()


@query(f"WITH {_NAMES}, {_PAIRS} SELECT query, name, score FROM y WHERE score >= 0.5")
def symbol_similar_pairs(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0))).alias("name"))
    names = table(spark, sf_dir, "part").select(F.expr(c.NAME).alias("name")).unionByName(words)
    return symbol_join.similar_pairs(_typos(spark, sf_dir), names).select("query", "name", "score")


_PART_PAIRS = f"{c._SYMBOLS}, n AS (SELECT DISTINCT name FROM s), q AS (SELECT DISTINCT {TYPO} AS query FROM part), {_PAIRS}"


@query(f"WITH {_PART_PAIRS}, d AS (SELECT DISTINCT query, s.name, file_path, line, score FROM s JOIN y USING (name) WHERE score >= 0.5), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file_path, line, name)::INT AS place FROM d) SELECT * FROM p WHERE place <= 15")
def symbol_fuzzy_many(spark, sf_dir):
    return symbol_join.fuzzy_many(c.part_symbols(spark, sf_dir), _typos(spark, sf_dir)).select("query", "name", "file_path", "line", "score", "place")


@query(f"WITH {_PART_PAIRS}, d AS (SELECT DISTINCT query, file_path, s.name, score FROM s JOIN y USING (name) WHERE score >= 0.4), p AS (SELECT *, row_number() OVER (PARTITION BY query, file_path ORDER BY score DESC, name)::INT AS place FROM d) SELECT * FROM p WHERE place <= 3")
def symbol_suggest_many(spark, sf_dir):
    return symbol_join.suggest_many(c.part_symbols(spark, sf_dir), _typos(spark, sf_dir))


def _index(spark, sf_dir) -> symbol_join.NameIndex:
    path = f"{sources.own_folder(spark)}/names/{uuid.uuid4().hex}"
    symbol_join.write_index(c.part_symbols(spark, sf_dir), path)
    return symbol_join.NameIndex(spark, path)


@query(f"WITH {c._SYMBOLS} SELECT * FROM s WHERE name ILIKE '%RING%'")
def symbol_like_indexed(spark, sf_dir):
    """All places, not the first ones, by the posted trigrams."""
    return _index(spark, sf_dir).like("RING", None)


@query(f"WITH {c._SYMBOLS} SELECT * FROM s WHERE contains(lower(name), 'l_r') ORDER BY file_path, line, name LIMIT 15")
def symbol_like_escape_indexed(spark, sf_dir):
    return _index(spark, sf_dir).like("l_r")


@query(f"WITH {c._SYMBOLS}, {c._SIM}, l AS (SELECT *, 1.0::DOUBLE AS score, 'like' AS match FROM s WHERE name ILIKE '%RING%' ORDER BY file_path, line, name LIMIT 15), z3 AS (SELECT DISTINCT s.name, file_path, line, score, 'fuzzy' AS match FROM s JOIN y USING (name) WHERE score >= 0.5 ORDER BY score DESC, file_path, line, name LIMIT 15) SELECT * FROM l UNION ALL SELECT name, file_path, line, score, match FROM z3")
def search_cascade_indexed(spark, sf_dir):
    """A search that finds names by their trigrams, and one that falls back to similar names."""
    index = _index(spark, sf_dir)
    return index.search("RING").unionByName(index.search("smal_rings"))


# --- the store: deltas by buckets ---------------------------------------------------------------------------------


def _order_store(spark, sf_dir) -> store.Store:
    """The index of orders as a stored table: one row a file."""
    rows = c.order_index(spark, sf_dir)
    table_ = store.Store(spark, f"{sources.own_folder(spark)}/stores/{uuid.uuid4().hex}", rows.schema, ["project_root", "file_path"])
    table_.upsert(rows, F.struct("mtime", "id"))
    return table_


_LATEST = "r AS (SELECT *, row_number() OVER (PARTITION BY project_root, file_path ORDER BY mtime DESC, id DESC, new DESC) AS k FROM u)"


@query(f"WITH {c._INDEX}, {c._FRESH}, u AS (SELECT *, 0 AS new FROM x UNION ALL SELECT *, 1 FROM f), {_LATEST} SELECT project_root, file_path, id, file_hash, mtime FROM r WHERE k = 1")
def store_upsert(spark, sf_dir):
    """A later upsert of some keys adds files of their rows only."""
    rows = _order_store(spark, sf_dir)
    rows.upsert(c._fresh(spark, sf_dir), F.struct("mtime", "id"))
    return rows.read()


_GONE = "customer WHERE c_nationkey BETWEEN 3 AND 9"


@query(f"WITH {c._INDEX}, {c._FRESH}, u AS (SELECT *, 0 AS new FROM x UNION ALL SELECT *, 1 FROM f), {_LATEST}, k AS (SELECT * FROM r WHERE k = 1 AND NOT (project_root = 'F' AND file_path IN (SELECT c_custkey::VARCHAR FROM {_GONE}))) SELECT project_root, file_path, id, file_hash, mtime FROM k WHERE mtime >= TIMESTAMP '1998-08-01' - INTERVAL 200 DAY")
def store_purge_compacted(spark, sf_dir):
    """Deletions and expiry as tombstones, then a compaction of the buckets that have gathered sets."""
    import datetime

    rows = _order_store(spark, sf_dir)
    rows.upsert(c._fresh(spark, sf_dir), F.struct("mtime", "id"))
    rows.delete(table(spark, sf_dir, "customer").filter("c_nationkey BETWEEN 3 AND 9").select(F.lit("F").alias("project_root"), F.col("c_custkey").cast("string").alias("file_path")))
    rows.expire(datetime.datetime(1998, 8, 1), 200, "mtime")
    rows.compact(3)
    return rows.read()


_PLACES = f"""{c.LINES}, w AS (SELECT doc_id, n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS snippet, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM l)
SELECT DISTINCT doc_id::VARCHAR AS file_path, n::INT AS line, name FROM w WHERE NOT regexp_matches(snippet, '^(#|//|/\\*|\\*)') AND contains(lower(name), 'shing')"""


@query(f"WITH {_PLACES}")
def index_stream_search(spark, sf_dir):
    """Walk, index and search as one: documents arrive as a stream, each batch replaces its files' occurrences in the store, and a search reads the store."""
    from ..streaming.index import keep_indexed

    place = f"{sources.own_folder(spark)}/streams/{uuid.uuid4().hex}"
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/document[s].parquet")
    docs = docs.select(F.col("doc_id").cast("string").alias("file_path"), "text")
    rows = keep_indexed(docs, f"{place}/index", f"{place}/state")
    found = search.like(rows.read().withColumn("line", F.col("line").cast("int")), "shing", None)
    return found.select("file_path", "line", "name").distinct()


@query(f"WITH {c.VALID} SELECT category, sum(original)::BIGINT AS original, sum(optimized)::BIGINT AS optimized, sum(saved)::BIGINT AS saved, count(*) AS count FROM s GROUP BY 1")
def savings_store(spark, sf_dir):
    """Sums of a stream of savings in a store that takes each batch once."""
    from ..streaming.index import keep_savings

    place = f"{sources.own_folder(spark)}/streams/{uuid.uuid4().hex}"
    rows = c._event_stream(spark, sf_dir).selectExpr(*c.SAVINGS.split(", CAST")[:1], *("CAST" + x for x in c.SAVINGS.split(", CAST")[1:]))
    return keep_savings(rows, f"{place}/sums", f"{place}/state").read()


# --- the read cache as state --------------------------------------------------------------------------------------

_TIMED = """e AS (SELECT user_id::VARCHAR AS key, event_id AS read_ord, ts, event_type, lag(ts) OVER w AS last_ts, lag(event_type) OVER w AS last_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, last_ts IS NULL OR ts > last_ts + INTERVAL 6 HOUR AS new FROM e), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY key ORDER BY read_ord) AS span FROM n)"""


def _timed_reads(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("read_ord"), F.col("ts").alias("at"), F.col("event_type").alias("content"))


def _run_cached(spark, rows: DataFrame, place: str) -> DataFrame:
    stream = rows.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


@query(f"WITH {_TIMED} SELECT key, read_ord, row_number() OVER (PARTITION BY key, span ORDER BY read_ord) AS read_no, CASE WHEN new THEN 'FIRST_READ' WHEN last_type = event_type THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM g")
def read_cache_expiry(spark, sf_dir):
    """Statuses of a stream of reads whose entries expire six hours after a key's last read."""
    from ..streaming import cache

    place = f"{sources.own_folder(spark)}/streams/{uuid.uuid4().hex}"
    with cache.rocksdb(spark):
        return _run_cached(spark, cache.cached_reads(_timed_reads(c._event_stream(spark, sf_dir)), "6 hours"), place)


@query("""WITH u AS (SELECT 0 AS turn, * FROM events UNION ALL SELECT 1, * FROM events),
s AS (SELECT turn, user_id::VARCHAR AS key, event_id AS read_ord, row_number() OVER w AS read_no, CASE WHEN row_number() OVER w = 1 THEN 'FIRST_READ' WHEN lag(event_type) OVER w = event_type THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM u WINDOW w AS (PARTITION BY user_id ORDER BY turn, event_id))
SELECT key, read_ord, read_no, status FROM s WHERE turn = 1""")
def read_cache_restart(spark, sf_dir):
    """A stream whose entries are published to a store, and a new stream, of the same reads once more, that starts from that store."""
    from ..streaming import cache

    place = f"{sources.own_folder(spark)}/streams/{uuid.uuid4().hex}"
    with cache.rocksdb(spark):
        reads = _timed_reads(c._event_stream(spark, sf_dir))
        _run_cached(spark, cache.cached_reads(reads), f"{place}/first")
        kept = cache.entries(spark, f"{place}/first/state")
        stored = store.Store(spark, f"{place}/cache", kept.schema, ["key"])
        stored.replace(kept)
        return _run_cached(spark, cache.cached_reads(reads, start=stored.read()), f"{place}/second")


# --- read keys and large budgets ----------------------------------------------------------------------------------

_ODD = "CASE p_partkey % 5 WHEN 0 THEN './a/../' || path || '#L3-9' WHEN 1 THEN '/x//./' || path || '/../../y#L4-L7' WHEN 2 THEN '../../' || path || '/.' WHEN 3 THEN path || '#run' ELSE 'a/b/../../../' || path || '#L12' END"
_FOLD = """list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(p, '/'), lambda s: [s])), lambda o, s: CASE WHEN s[1] IN ('', '.') THEN o WHEN s[1] <> '..' THEN list_concat(o, s)
  WHEN len(o) > 0 AND o[len(o)] <> '..' THEN o[1:len(o) - 1] WHEN p LIKE '/%' THEN o ELSE list_concat(o, s) END)"""


@query(f"""WITH {c.PATHS}, k AS (SELECT p_partkey, replace({_ODD}, chr(92), '/') AS k FROM q), f AS (SELECT p_partkey, string_split(k, '#')[1] AS p, CASE WHEN contains(k, '#') THEN string_split(k, '#')[2] END AS fr FROM k),
g AS (SELECT *, (CASE WHEN p LIKE '/%' THEN '/' ELSE '' END) || array_to_string({_FOLD}, '/') AS path FROM f)
SELECT p_partkey, CASE WHEN path = '' THEN '.' ELSE path END AS path, CASE WHEN fr IS NULL THEN 'file' WHEN fr LIKE 'L%' THEN 'lines' ELSE 'symbol' END AS kind,
  CASE WHEN fr LIKE 'L%' THEN regexp_extract(fr, '^L([0-9]+)', 1)::INT END AS start, CASE WHEN fr LIKE 'L%' THEN regexp_extract(fr, '([0-9]+)$', 1)::INT END AS "end", CASE WHEN fr NOT LIKE 'L%' THEN fr END AS symbol FROM g""")
def read_keys_canonical(spark, sf_dir):
    key = F.expr(_ODD)
    return c.part_paths(spark, sf_dir).select("p_partkey", scalars.read_key(key).alias("k")).select("p_partkey", "k.*")


@query("""WITH f AS (SELECT doc_id, (n_chars % 97)::DOUBLE AS score, greatest(1, n_chars // 4)::BIGINT AS tokens FROM documents), b AS (SELECT (sum(tokens) // 2)::BIGINT AS budget FROM f),
o AS (SELECT *, (row_number() OVER w)::INT AS place, (10 + sum(tokens) OVER w)::BIGINT AS spent FROM f WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id, score, tokens, place, spent FROM o, b WHERE spent <= budget""")
def repo_budget_large(spark, sf_dir):
    """A budget of half of all tokens, by ranges of scores."""
    rows = c.documents(spark, sf_dir).select("doc_id", (F.col("n_chars") % 97).cast("double").alias("score"), F.greatest(F.lit(1), F.expr("n_chars div 4")).cast("long").alias("tokens"))
    budget = rows.agg(F.coalesce(F.expr("sum(tokens) div 2"), F.lit(0))).first()[0]
    return repomap.within_budget(rows, budget, 10, "doc_id", one_task=0)
