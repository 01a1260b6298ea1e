"""Extraction, caches and change streams over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.extract.code import extract_nodes
from symgraph.extract.lines import RULES, scan_lines
from symgraph.functions import predicates as P
from symgraph.operators.build import assign_ord, build_graph
from symgraph.plans.adapters import code_graph, with_graph
from symgraph.schema import node_id
from symgraph.session import checkpoint, table
from symgraph.sources.files import deleted_files, is_supported, language, split_cached
from symgraph.streaming.changes import debounce, snapshot_batches


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select(F.col("path").alias("file"), "mtime")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of an earlier run: some files are newer now, some gone."""
    n = F.length("file")
    return _files(spark, d).select(F.when(n % 11 == 0, F.concat("file", F.lit(".old"))).otherwise(F.col("file")).alias("file"), (F.col("mtime") - F.when(n % 7 == 0, 1).otherwise(0)).alias("mtime"))


CACHE = "cache AS (SELECT CASE WHEN length(path) % 11 = 0 THEN path || '.old' ELSE path END AS file, mtime - CASE WHEN length(path) % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM source_files)"


def incremental_hits(spark, d):
    hit, miss = split_cached(_files(spark, d), _cache(spark, d))
    return hit.withColumn("hit", F.lit(True)).unionAll(miss.withColumn("hit", F.lit(False)))


def deleted_cached(spark, d):
    return deleted_files(_cache(spark, d), _files(spark, d))


def extracted_nodes(spark, d):
    """All symbols of the source files, numbered by file and place."""
    rows = extract_nodes(table(spark, d, "source_files").select("path", "ext", "text")).where("error IS NULL")
    out = assign_ord(rows)
    return out.select("ord", node_id(F.col("file"), F.col("qualified_name"), F.col("kind")).alias("id"), "file", "name", "qualified_name", "kind", "line_start", "line_end", "signature", "visibility", F.size("refs").alias("n_refs"))


def extraction_errors(spark, d):
    return extract_nodes(table(spark, d, "source_files").select("path", "ext", "text")).where("error IS NOT NULL").select("file", "error")


def extracted_edges(spark, d):
    """Calls resolved between the extracted symbols."""
    rows = extract_nodes(table(spark, d, "source_files").select("path", "ext", "text")).where("error IS NULL")
    n = checkpoint(assign_ord(rows).withColumn("id", node_id(F.col("file"), F.col("qualified_name"), F.col("kind"))))
    return build_graph(n).edges.select("src", "dst", "kind")


def language_routing(spark, d):
    t = table(spark, d, "source_files")
    return t.groupBy(language(F.col("ext")).alias("language"), is_supported(F.col("ext")).alias("supported")).agg(F.count(F.lit(1)).alias("files"))


def line_scan(spark, d):
    """All source files read by the line rules of each language that has no more than these."""
    t = table(spark, d, "source_files").select("path", F.explode(F.array(*[F.lit(x) for x in sorted(RULES)])).alias("language"), "text")
    per = t.select(F.concat("language", F.lit("|"), "path").alias("path"), "language", "text")  # so that a row of the result tells its rules
    out = scan_lines(per)
    return out.select(F.substring_index("file", "|", 1).alias("language"), F.regexp_replace("file", r"^[a-z]+\|", "").alias("file"), "name", "kind", "line_start", "col_no", "signature")


def extracted_functions(spark, d):
    """The functions and methods of Go and Rust files, whose declarations begin with a word of their own."""
    files = table(spark, d, "source_files").where(F.lower("ext").isin("go", "rs")).select("path", "ext", "text")
    return extract_nodes(files).where("kind IN ('function', 'method')").select("file", "name", "line_start")


def path_predicates(spark, d):
    """The four rules for test files and the three for generated ones, over all paths."""
    f = F.col("path")
    flags = {"rank": P.is_test_rank, "map": P.is_test_map, "cli": P.is_test_cli, "audit": P.is_test_audit, "generated_map": P.is_generated_map, "generated_change": P.is_generated_change, "generated_tool": P.is_generated_tool_change}
    return table(spark, d, "source_files").select("path", *[fn(f).alias(n) for n, fn in flags.items()], P.compress_path(f).alias("short"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("change"), F.col("ts").cast("timestamp").alias("ts"))


def debounce_sessions(spark, d):
    return debounce(changes(spark, d), "1 hour").select("path", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n", "change")


def snapshot_node_batches(spark, d):
    return snapshot_batches(code_graph(spark, d))[0]


def snapshot_edge_batches(spark, d):
    return snapshot_batches(code_graph(spark, d))[1]


QUERIES = {f.__name__: f for f in (incremental_hits, deleted_cached, extracted_nodes, extraction_errors, extracted_edges, extracted_functions, language_routing, line_scan, path_predicates, debounce_sessions, snapshot_node_batches, snapshot_edge_batches)}

_SLASH = "replace({}, chr(92), '/')"
ORACLE = {
    "incremental_hits": f"WITH {CACHE} SELECT s.path AS file, s.mtime, coalesce(c.mtime = s.mtime, false) AS hit FROM source_files s LEFT JOIN cache c ON c.file = s.path",
    "deleted_cached": f"WITH {CACHE} SELECT file FROM cache WHERE file NOT IN (SELECT path FROM source_files)",
    "language_routing": """SELECT CASE lower(ext) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'typescript' WHEN 'c' THEN 'c' END AS language,
        lower(ext) IN ('py', 'rs', 'go', 'java', 'ts', 'js', 'c') AS supported, count(*) AS files FROM source_files GROUP BY 1, 2""",
    "line_scan": """WITH l AS (SELECT path AS file, unnest(t) AS raw, generate_subscripts(t, 1) AS line_start FROM (SELECT path, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS t FROM source_files)),
        m AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l), g AS (SELECT m.*, language FROM m, (SELECT unnest(['kotlin', 'swift', 'ruby', 'php', 'shell', 'markdown']) AS language) WHERE line <> '' AND (language = 'markdown' OR NOT regexp_matches(line, '^(//|#|/\\*|\\*|<!--)'))),
        b AS (SELECT *, CASE language WHEN 'kotlin' THEN regexp_extract(line, '^(fun |class |data class |object |interface |enum class )\\s*[\\p{L}\\p{N}_-]', 1) WHEN 'swift' THEN regexp_extract(line, '^(func |class |struct |enum |protocol |extension )\\s*[\\p{L}\\p{N}_-]', 1)
            WHEN 'ruby' THEN regexp_extract(line, '^(def self\\.|def |class |module )\\s*[\\p{L}\\p{N}_-]', 1) WHEN 'php' THEN regexp_extract(line, '^(function |class |interface |trait )\\s*[\\p{L}\\p{N}_-]', 1) WHEN 'shell' THEN regexp_extract(line, '^(function )\\s*[\\p{L}\\p{N}_-]', 1)
            ELSE regexp_extract(line, '^(### |## |# )\\s*[\\p{L}\\p{N}_-]', 1) END AS begun FROM g),
        n AS (SELECT *, CASE WHEN begun <> '' THEN regexp_extract(substr(line, length(begun) + 1), '^\\s*([\\p{L}\\p{N}_-]+)', 1) WHEN language = 'shell' THEN regexp_extract(line, '^([\\p{L}\\p{N}_-]+)\\s*\\(\\)', 1) WHEN language = 'markdown' THEN ltrim(regexp_extract(line, '^#\\S*\\s+(\\S+)', 1), '#') ELSE '' END AS name FROM b)
        SELECT language, file, name, CASE WHEN language = 'markdown' THEN 'section' WHEN begun IN ('class ', 'data class ', 'object ') THEN 'class' WHEN begun IN ('interface ', 'protocol ', 'trait ') THEN 'interface' WHEN begun IN ('enum ', 'enum class ') THEN 'enum' WHEN begun = 'struct ' THEN 'struct' WHEN begun IN ('extension ', 'module ') THEN 'module' ELSE 'function' END AS kind,
            CAST(line_start AS INTEGER) AS line_start, CAST(strlen(regexp_extract(raw, '^(\\s*)', 1)) AS INTEGER) AS col_no, line AS signature FROM n WHERE name <> ''""",
    "extracted_functions": """WITH l AS (SELECT path AS file, lower(ext) AS ext, unnest(t) AS line, generate_subscripts(t, 1) AS line_start FROM (SELECT path, ext, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM source_files WHERE lower(ext) IN ('go', 'rs')))
        SELECT file, name, CAST(line_start AS INTEGER) AS line_start FROM (SELECT *, CASE ext WHEN 'go' THEN regexp_extract(line, '^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)', 1) ELSE regexp_extract(line, '^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?(?:async\\s+|unsafe\\s+|const\\s+)*fn\\s+(\\w+)', 1) END AS name FROM l) WHERE name <> ''""",
    "path_predicates": """SELECT path, regexp_matches(lower(path), '/test|\\\\test|/spec|\\\\spec|__test__|_test\\.|\\.test\\.|\\.spec\\.|/fixture|/mock|/stub|/fake|(_test\\.go|_test\\.py|_test\\.rs|test\\.ts|test\\.js)$') AS rank,
        regexp_matches(lower(path), '/test|/spec|/fixture|/mock|__tests__|\\.test\\.|\\.spec\\.|_test\\.') AS map,
        regexp_matches(lower(path), '(^|/)(tests?|specs?|fixtures?|mocks?|__tests__|__mocks__|testfixtures)(/|$)|(test\\.java|tests\\.java|test\\.rs|test\\.tsx?|test\\.jsx?|test\\.py|test\\.go|tests?\\.cs|_test\\.dart)$|\\.spec\\.|\\.test\\.|(^|/)test_[^/]*$|(^|/)conftest\\.py$') AS cli,
        regexp_matches(lower(path), 'test|spec') AS audit,
        regexp_matches(lower(path), '(\\.min\\.js|\\.min\\.css)$|\\.chunk\\.|\\.bundle\\.|/dist/|/build/|/resources/monitor/|/resources/static/|/generated/|(^|/)[^./]*\\.[0-9a-f]{8,}\\.[^/]*$') AS generated_map,
        regexp_matches(path, '(^|/)\\.symgraph/|(^|/)(target|dist|build|\\.dart_tool|generated)(/|$)|(\\.g\\.dart|\\.generated\\.rs|\\.pb\\.go|\\.designer\\.cs)$') AS generated_change,
        regexp_matches(path, 'node_modules/|target/|dist/|build/|\\.symgraph/|package-lock\\.json|Cargo\\.lock|generated/|(\\.min\\.js|\\.min\\.css)$') AS generated_tool,
        CASE WHEN len(string_split(path, '/')) > 4 THEN string_split(path, '/')[1] || '/.../' || array_to_string(string_split(path, '/')[-3:], '/') ELSE path END AS short FROM source_files""",
    "debounce_sessions": """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change, ts FROM events),
        g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM c),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT path, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts)) AS end_us, count(*) AS n, arg_max(change, struct_pack(t := ts, c := change)) AS change FROM s GROUP BY path, k""",
    "snapshot_node_batches": with_graph("SELECT ord, id, (row_number() OVER (ORDER BY id, ord) - 1) // 50 AS batch FROM v"),
    "snapshot_edge_batches": with_graph("SELECT source, target, kind, (row_number() OVER (ORDER BY source, target, kind) - 1) // 100 AS batch FROM (SELECT a.id AS source, b.id AS target, e.kind FROM e JOIN v a ON a.ord = e.src JOIN v b ON b.ord = e.dst)"),
}
