"""Queries of data-set building, manifests and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import text
from framewise.operators import dataset, manifest, qc
from framewise.operators.ranks import ordered_rank, seeded_rank
from framewise.params import SPLITS, Split
from framewise.plans.series import EVENTS_SQL, event_series, table


def entity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, language and page number of URLs, ``unknown`` where missing."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.entity("url", r"^https?://([^/]+)").alias("host"),
        text.entity("url", r"^https?://[^/]+/([a-z]{2})/").alias("lang"),
        text.entity("url", r"[?&]page=([0-9]+)").alias("page"),
        text.entity("url", r"#(\w+)").alias("fragment"),
    )


ENTITY_PARSE = r"""
SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), 'unknown') AS host,
       coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), ''), 'unknown') AS lang,
       coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), 'unknown') AS page,
       coalesce(nullif(regexp_extract(url, '#(\w+)', 1), ''), 'unknown') AS fragment
FROM pages
"""


def run_key_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of run keys made of customers; one in seven lacks a session."""
    c = table(spark, sf_dir, "customer")
    session = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.format_string("_ses-%d", F.col("c_nationkey")))
    key = F.concat(F.format_string("sub-C%d", "c_custkey"), session, F.lit("_task-rest10_run-"), text.zfill(F.col("c_custkey") % 1200, 3))
    return c.select("c_custkey", key.alias("k")).select("c_custkey", *text.entities("k"))


RUN_KEY_ENTITIES = """
SELECT c_custkey, 'C' || c_custkey AS subject_id, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE c_nationkey::VARCHAR END AS session_id,
       'rest10' AS task, CASE WHEN c_custkey % 1200 < 1000 THEN lpad((c_custkey % 1200)::VARCHAR, 3, '0') ELSE (c_custkey % 1200)::VARCHAR END AS run_id
FROM customer
"""


def path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sub, ses, run = F.col("o_custkey").cast("string"), F.lower("o_orderstatus"), F.col("o_orderkey").cast("string")
    path = text.preprocessed_path("/data/", sub, ses, F.lit("videos"), run)
    name = text.chunk_name(sub, ses, F.lit("videos"), run, F.lit(0), F.lit(19))
    made = o.select("o_orderkey", path.alias("path"), name.alias("chunk"))
    return made.withColumns({"name": text.basename("path"), "stem": text.stem("path"), "masked": text.masked_name("path")})


PATH_TEMPLATE = """
WITH p AS (SELECT o_orderkey, o_custkey AS s, lower(o_orderstatus) AS e, CASE WHEN length(o_orderkey::VARCHAR) < 3 THEN lpad(o_orderkey::VARCHAR, 3, '0') ELSE o_orderkey::VARCHAR END AS r FROM orders),
q AS (SELECT *, 'sub-' || s || '_ses-' || e || '_task-videos_dir-AP_run-' || r || '_bold_mcf_corrected_flirt_masked' AS f FROM p)
SELECT o_orderkey, '/data/_subject_id_' || s || '/_referencetype_standard/_run_' || r || '_session_' || e || '_task_name_videos/' || f || '.nii.gz' AS path,
       f || '.nii.gz' AS name, f AS stem,
       '/data/_subject_id_' || s || '/_referencetype_standard/_run_' || r || '_session_' || e || '_task_name_videos/' || f || '_masked.nii.gz' AS masked,
       'sub-' || s || '_ses-' || e || '_task-videos_run-' || r || '_chunk-0-19.nii.gz' AS chunk
FROM q
"""


def task_and_mask_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of four kinds, two of them wanted; subjects with and without the older ones' letter."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ("_Videos", "_Rest5", "_pictures", "")))
    task = F.concat(F.upper(F.substring_index("p_type", " ", 1)), F.get(kinds, F.col("p_size") % 4))
    subject = F.concat(F.lit("ICC"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, "A").otherwise(""))
    return p.select("p_partkey", text.is_wanted_task(task).alias("wanted"), text.mask_kind(subject).alias("mask"))


ROUTING = """
WITH t AS (SELECT p_partkey, lower(split_part(p_type, ' ', 1) || ['_Videos', '_Rest5', '_pictures', ''][p_size % 4 + 1]) AS task,
                  'ICC' || p_partkey || CASE WHEN p_size % 3 = 0 THEN 'A' ELSE '' END AS subject FROM part)
SELECT p_partkey, regexp_matches(task, 'videos|rest') AS wanted, CASE WHEN subject LIKE '%A' THEN 'older' ELSE 'younger' END AS mask FROM t
"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"))
    return a.union(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject")))


def subject_union_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.subject_split(_subjects(spark, sf_dir), "subject", Split())


_SPLIT = """
u AS (SELECT user_id AS subject FROM events UNION SELECT o_custkey FROM orders),
r AS (SELECT subject, row_number() OVER (ORDER BY md5(subject::VARCHAR || '#42'), subject) AS r, count(*) OVER () AS n FROM u),
h AS (SELECT *, ceil(n * 0.3::DECIMAL(10,4)) AS held FROM r),
sp AS (SELECT subject, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - ceil(held / 2) THEN 'val' ELSE 'test' END AS split FROM h)"""

SUBJECT_SPLIT = f"WITH {_SPLIT} SELECT subject, split FROM sp"


def split_assign_no_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and subjects of each split in both domains, and the subjects that are in more than one split (none)."""
    split = subject_union_split(spark, sf_dir)
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"))
    both = dataset.tagged_union({"A_corrupted": a, "B_motion_free": b})
    rows = dataset.assign_split(both, split, "subject")
    return rows.groupBy("domain", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subject").alias("n_subjects"))


SPLIT_ASSIGN = f"""
WITH {_SPLIT}, b AS (SELECT 'A_corrupted' AS domain, user_id AS subject FROM events UNION ALL SELECT 'B_motion_free', o_custkey FROM orders)
SELECT domain, split, count(*) AS n_rows, count(DISTINCT b.subject) AS n_subjects FROM b JOIN sp ON b.subject = sp.subject GROUP BY ALL
"""


def split_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that each split keeps: events as chunks of corrupted runs, orders of the first priority as motion-free ones."""
    split = subject_union_split(spark, sf_dir)
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("chunk"), F.col("user_id").alias("subject"))
    b = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("subject"))
    rows = []
    for name in SPLITS:
        own = split.filter(F.col("split") == name).drop("split")
        tables = dataset.split_tables(a.join(own, "subject"), b.join(own, "subject"), name, "chunk")
        rows += [t.select(F.lit(k).alias("table"), "chunk", "subject") for k, t in tables.items()]
    return dataset.union_by_name(*rows)


SPLIT_POLICY = f"""
WITH {_SPLIT}, a AS (SELECT event_id AS chunk, user_id AS subject, split FROM events JOIN sp ON user_id = subject),
b AS (SELECT o_orderkey AS chunk, o_custkey AS subject, split FROM orders JOIN sp ON o_custkey = subject WHERE o_orderpriority = '1-URGENT'),
k AS (SELECT split, count(*) AS n FROM b GROUP BY split),
c AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(chunk::VARCHAR || '#42'), chunk) AS i FROM a)
SELECT split || '_motion_free' AS "table", chunk, subject FROM b
UNION ALL SELECT 'train_corrupted_all', chunk, subject FROM a WHERE split = 'train'
UNION ALL SELECT CASE split WHEN 'train' THEN 'train_corrupted_balanced_epoch0' ELSE split || '_corrupted_balanced' END, chunk, subject FROM c JOIN k USING (split) WHERE i <= n
"""


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    return dataset.balanced_sample(e, "event_type", "event_id", 1981)


BALANCED = """
SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '#42'), event_id) <= 1981
"""


def semi_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return dataset.existing(docs, table(spark, sf_dir, "labels"), "doc_id", "doc_id")


def anti_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return dataset.absent(docs, table(spark, sf_dir, "labels"), "doc_id", "doc_id")


def existence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return dataset.with_existence(docs, table(spark, sf_dir, "labels"), "doc_id", "doc_id")


def existence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = existence_flag(spark, sf_dir)
    return f.groupBy("lang").agg(F.count_if("preprocessed_exists").alias("n_found"), F.count_if(~F.col("preprocessed_exists")).alias("n_missing"))


def slice_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_series(spark, sf_dir).groupBy("run_key").agg(F.count(F.lit(1)).alias("n_vols"))
    shift = F.col("run_key") % 5
    start = F.when(shift == 0, -1).when(shift == 1, F.col("n_vols") - 10).when(shift == 2, 5).otherwise(0)
    end = F.when(shift == 2, 4).otherwise(start + 19)
    rows = e.select("run_key", "n_vols", start.cast("long").alias("chunk_start"), end.cast("long").alias("chunk_end"))
    return rows.withColumn("status", dataset.slice_status(F.col("chunk_start"), F.col("chunk_end"), F.col("n_vols")))


SLICES = f"""
WITH {EVENTS_SQL}, c AS (SELECT run_key, count(*) AS n_vols, CASE run_key % 5 WHEN 0 THEN -1 WHEN 1 THEN count(*) - 10 WHEN 2 THEN 5 ELSE 0 END::BIGINT AS chunk_start FROM e GROUP BY run_key),
b AS (SELECT *, (CASE WHEN run_key % 5 = 2 THEN 4 ELSE chunk_start + 19 END)::BIGINT AS chunk_end FROM c)
SELECT run_key, n_vols, chunk_start, chunk_end, CASE WHEN chunk_start < 0 OR chunk_end >= n_vols OR chunk_start > chunk_end
  THEN 'error: invalid slice [' || chunk_start || ', ' || chunk_end || '] of ' || n_vols || ' volumes' ELSE 'ok' END AS status FROM b
"""


def manifest_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.round("value", 4).alias("value"))
    return manifest.keep_last(e, ["user_id"], ["ts", "event_id"]).drop("ts")


KEEP_LAST = """
SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the older manifest; the lines' orders that were returned, and keys that no order has, as the newer one."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("input_path"), F.lit("processed").alias("status"), F.lit(0).alias("n"))
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return manifest.upsert(old, li.select(key.cast("string").alias("input_path"), F.lit("skipped").alias("status"), F.col("l_linenumber").alias("n")), order=["n"])


UPSERT = """
WITH n AS (SELECT (CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END)::VARCHAR AS input_path, max(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT coalesce(n.input_path, o_orderkey::VARCHAR) AS input_path, CASE WHEN n.input_path IS NULL THEN 'processed' ELSE 'skipped' END AS status, coalesce(n.n, 0)::INTEGER AS n
FROM orders FULL JOIN n ON n.input_path = o_orderkey::VARCHAR
"""


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("o_orderkey"))
    return dataset.union_by_name(a, b)


UNION_BY_NAME = """
SELECT o_orderkey, o_orderpriority, NULL::VARCHAR AS status FROM orders UNION ALL SELECT l_orderkey, NULL, l_linestatus FROM lineitem
"""


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") < 10, "FAIL").when(F.col("value") > 100, "MISSING").otherwise("PASS"))
    return manifest.status_pivot(e, "event_type", "status", ["PASS", "FAIL", "MISSING"])


STATUS_PIVOT = """
SELECT event_type, count(*) FILTER (value BETWEEN 10 AND 100) AS "n_PASS", count(*) FILTER (value < 10) AS "n_FAIL", count(*) FILTER (value > 100) AS "n_MISSING", count(*) AS n_all
FROM events GROUP BY event_type
"""


def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as expected outputs; numbers of their orders stand for what a volume check found."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("output_path"), F.col("c_mktsegment").alias("task"))
    n, price = F.count(F.lit(1)), F.col("o_totalprice")
    shape = lambda k: F.format_string("(4, 4, 4, %d)", k)
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("output_path")).agg(
        F.when(n % 13 == 0, "truncated").alias("load_error"),
        shape(n).alias("input_shape"),
        shape(F.when(n % 11 == 0, n - 1).otherwise(n)).alias("output_shape"),
        n.alias("n_volumes"),
        n.alias("n_brain_voxels"),
        F.count_if(price > 490000).alias("n_nonzero_outside_brain"),
        F.count_if(price > 100000).alias("n_outside"),
        (F.min("o_totalprice") / 30000.0).alias("mean_signal_brain"),
        F.count_if(price <= 2000).alias("n_zero_volumes"),
    )
    counts = ["n_volumes", "n_brain_voxels", "n_zero_outside_brain", "n_zero_volumes"]
    return manifest.verification(c, o).withColumns({k: F.col(k).cast("double") for k in counts})


VERIFICATION = """
WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_totalprice > 490000) AS nz, count(*) FILTER (o_totalprice > 100000) AS nout,
                  min(o_totalprice) / 30000.0 AS m, count(*) FILTER (o_totalprice <= 2000) AS z FROM orders GROUP BY o_custkey),
j AS (SELECT c_custkey AS output_path, c_mktsegment AS task, o.*, n IS NOT NULL AS there, coalesce(n % 13 <> 0, false) AS ok, coalesce(n % 13 <> 0 AND n % 11 <> 0, false) AS dims
      FROM customer LEFT JOIN o ON o_custkey = c_custkey),
t AS (SELECT *, '(4, 4, 4, ' || n || ')' AS a, '(4, 4, 4, ' || (n - (n % 11 = 0)::INTEGER) || ')' AS b FROM j),
k AS (SELECT *, CASE WHEN NOT there THEN '' WHEN NOT ok THEN 'Load error: truncated' WHEN NOT dims THEN 'Shape mismatch: input=' || a || ' output=' || b
       ELSE concat_ws(' ', CASE WHEN nz > 0 THEN 'Non-brain voxels not fully zeroed (' || nz || ' non-zero outside brain).' END,
                      CASE WHEN m <= 1 THEN 'Brain signal unexpectedly low.' END, CASE WHEN z > 0 THEN z || ' all-zero brain volume(s).' END) END AS notes FROM t)
SELECT output_path, task, there AS output_exists, ok AS file_loadable, dims AS dims_match, CASE WHEN ok THEN n END::DOUBLE AS n_volumes, CASE WHEN ok THEN a END AS input_shape,
       CASE WHEN ok THEN b END AS output_shape, CASE WHEN dims THEN n END::DOUBLE AS n_brain_voxels, CASE WHEN dims THEN nz END::DOUBLE AS n_zero_outside_brain,
       CASE WHEN dims THEN format('{:.2f}', (CASE WHEN nout > 0 THEN (nout - nz) / nout * 100 ELSE 100 END)::DOUBLE)::DOUBLE END AS pct_outside_zeroed, CASE WHEN dims THEN format('{:.4f}', m)::DOUBLE END AS mean_signal_brain,
       dims AND m > 1 AS brain_has_signal, CASE WHEN dims THEN z END::DOUBLE AS n_zero_volumes, CASE WHEN NOT there THEN 'MISSING' WHEN notes <> '' THEN 'FAIL' ELSE 'PASS' END AS status, notes
FROM k
"""


def verification_load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As verification_report, with inputs and masks that can't be read."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("output_path"))
    n = F.count(F.lit(1))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("output_path")).agg(
        F.when(n % 13 == 0, "truncated").alias("load_error"),
        F.when(n % 3 == 0, "no such input").alias("input_error"),
        F.when(n % 5 == 0, "no such mask").alias("mask_error"),
        F.format_string("(4, 4, 4, %d)", n).alias("input_shape"),
        F.format_string("(4, 4, 4, %d)", F.when(n % 11 == 0, n - 1).otherwise(n)).alias("output_shape"),
        n.alias("n_volumes"),
        n.alias("n_brain_voxels"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_nonzero_outside_brain"),
        (n + 5).alias("n_outside"),
        (F.min("o_totalprice") / 3000.0).alias("mean_signal_brain"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_zero_volumes"),
    )
    kept = ["output_path", "file_loadable", "dims_match", "input_shape", "pct_outside_zeroed", "mean_signal_brain", "brain_has_signal", "status", "notes"]
    return manifest.verification(c, o).select(*kept)


VERIFICATION_ERRORS = """
WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS nz, min(o_totalprice) / 3000.0 AS m, count(*) FILTER (o_orderstatus = 'P') AS z FROM orders GROUP BY o_custkey),
j AS (SELECT c_custkey AS output_path, o.*, n IS NOT NULL AS there, coalesce(n % 13 <> 0, false) AS ok, coalesce(n % 3 = 0, false) AS noin, coalesce(n % 5 = 0, false) AS nomask FROM customer LEFT JOIN o ON o_custkey = c_custkey),
t AS (SELECT *, ok AND NOT noin AND n % 11 <> 0 AS dims, ok AND NOT nomask AND (noin OR n % 11 <> 0) AS seen FROM j),
k AS (SELECT *, CASE WHEN NOT there THEN '' WHEN NOT ok THEN 'Load error: truncated'
       WHEN NOT dims AND NOT noin THEN 'Shape mismatch: input=(4, 4, 4, ' || n || ') output=(4, 4, 4, ' || (n - 1) || ')' WHEN nomask THEN 'Mask load error: no such mask'
       ELSE concat_ws(' ', CASE WHEN noin THEN 'Input load error: no such input' END, CASE WHEN nz > 0 THEN 'Non-brain voxels not fully zeroed (' || nz || ' non-zero outside brain).' END,
                      CASE WHEN m <= 1 THEN 'Brain signal unexpectedly low.' END, CASE WHEN z > 0 THEN z || ' all-zero brain volume(s).' END) END AS notes FROM t)
SELECT output_path, ok AS file_loadable, dims AS dims_match, CASE WHEN ok AND NOT noin THEN '(4, 4, 4, ' || n || ')' END AS input_shape,
       CASE WHEN seen THEN format('{:.2f}', (n + 5 - nz) / (n + 5)::DOUBLE * 100)::DOUBLE END AS pct_outside_zeroed, CASE WHEN seen THEN format('{:.4f}', m)::DOUBLE END AS mean_signal_brain,
       coalesce(seen AND m > 1, false) AS brain_has_signal, CASE WHEN NOT there THEN 'MISSING' WHEN notes <> '' THEN 'FAIL' ELSE 'PASS' END AS status, notes
FROM k
"""


def extraction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks of their orders' runs, of which some can't be read, some aren't 4-D and some chunks are there already."""
    key = F.col("l_orderkey").cast("string")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("subject_id"), F.lower("l_returnflag").alias("session_id"), F.col("l_linenumber").cast("string").alias("run_id"),
        F.lit("rest5").alias("task"), key.alias("preprocessed_bold_file"), (F.col("l_linenumber") - 2).alias("chunk_start"), (F.col("l_linenumber") + 17).alias("chunk_end"), "l_quantity",
    )
    o = table(spark, sf_dir, "orders")
    runs = o.select(
        F.col("o_orderkey").cast("string").alias("preprocessed_bold_file"),
        (F.col("o_custkey") % 8 + 16).alias("n_vols"),
        F.when(F.col("o_orderstatus") == "P", 3).otherwise(4).alias("n_axes"),
        F.when(F.col("o_totalprice") > 480000, "truncated").alias("load_error"),
    )
    there = li.filter("l_quantity >= 45").select(text.chunk_name(*(F.col(c) for c in ("subject_id", "session_id", "task", "run_id", "chunk_start", "chunk_end"))).alias("name"))
    log = manifest.extraction_log(li.drop("l_quantity"), runs, there, "/out/train/A_corrupted/", "train", "A_corrupted", F.lit("2020-01-02 03:04:05").cast("timestamp"))
    return log.groupBy(*(c for c in log.columns)).agg(F.count(F.lit(1)).alias("n"))


EXTRACTION_LOG = """
WITH l AS (SELECT l_orderkey, l_suppkey::VARCHAR AS subject_id, lower(l_returnflag) AS session_id, l_linenumber::VARCHAR AS run_id, 'rest5' AS task, l_linenumber - 2 AS chunk_start, l_linenumber + 17 AS chunk_end, l_quantity FROM lineitem),
m AS (SELECT *, 'sub-' || subject_id || '_ses-' || session_id || '_task-rest5_run-' || lpad(run_id, 3, '0') || '_chunk-' || chunk_start || '-' || chunk_end || '.nii.gz' AS name FROM l),
e AS (SELECT DISTINCT name FROM m WHERE l_quantity >= 45),
p AS (SELECT m.*, e.name IS NOT NULL AS there, o_custkey % 8 + 16 AS n, CASE WHEN o_totalprice > 480000 THEN 'Load failed: truncated' WHEN o_orderstatus = 'P' THEN 'Not 4D: 3 axes' WHEN e.name IS NOT NULL THEN ''
  WHEN chunk_start < 0 OR chunk_end >= o_custkey % 8 + 16 THEN 'error: invalid slice [' || chunk_start || ', ' || chunk_end || '] of ' || (o_custkey % 8 + 16) || ' volumes' ELSE '' END AS message
  FROM m JOIN orders ON o_orderkey = l_orderkey LEFT JOIN e ON e.name = m.name)
SELECT 'train' AS split, 'A_corrupted' AS domain, subject_id, session_id, run_id, task, chunk_start, chunk_end, CASE WHEN message = '' THEN '/out/train/A_corrupted/' || name ELSE '' END AS output_path,
       CASE WHEN message <> '' THEN 'error' WHEN there THEN 'skipped_exists' ELSE 'ok' END AS status, message, '2020-01-02T03:04:05' AS timestamp, count(*) AS n FROM p GROUP BY ALL
"""


def patched_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is missing, one that is empty and one that has values, each offered the same filling."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("").alias("empty"))
    fill = F.concat(F.lit("/path/"), F.col("doc_id").cast("string"))
    for c in ("missing", "empty", "lang"):
        docs = qc.patch_column(docs, c, fill)
    return docs


PATCHED = "SELECT doc_id, lang, '/path/' || doc_id AS empty, '/path/' || doc_id AS missing FROM documents"


def pair_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    a = lab.filter("quality = 1").select(F.col("doc_id").alias("a_id"))
    b = lab.filter("quality = 0").select(F.col("doc_id").alias("b_id"))
    return dataset.zip_pairs(a, b, 42, "a_id", "b_id")


PAIR_ZIP = """
WITH a AS (SELECT doc_id AS a_id, row_number() OVER (ORDER BY doc_id) AS rank FROM labels WHERE quality = 1),
b AS (SELECT doc_id AS b_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id) AS rank FROM labels WHERE quality = 0)
SELECT rank, a_id, b_id FROM a JOIN b USING (rank)
"""


def epoch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    n = lab.filter("quality = 0").count()
    return dataset.epoch_queue(lab.filter("quality = 1").select("doc_id"), "doc_id", n)


EPOCH_QUEUE = """
WITH b AS (SELECT count(*) AS n FROM labels WHERE quality = 0),
a AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '#42#0'), doc_id) - 1 AS p, count(*) OVER () AS m FROM labels WHERE quality = 1)
SELECT doc_id, p // n AS epoch, p % n AS slot FROM a, b WHERE p < (m // n) * n
"""


def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the test loader: one domain in order, the last batch may be short."""
    a = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return dataset.loader(a, None, "test", "doc_id", 16).select("doc_id", "rank", "batch")


LOADER = """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM labels WHERE quality = 1
"""


def train_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch 1 of the train loader: queued pairs in full batches."""
    lab = table(spark, sf_dir, "labels")
    return dataset.loader(lab.filter("quality = 1").select("doc_id"), lab.filter("quality = 0").select("doc_id"), "train", "doc_id", 16, epoch=1)


TRAIN_LOADER = """
WITH n AS (SELECT count(*) AS n FROM labels WHERE quality = 0),
a AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '#42#0'), doc_id) - 1 AS p FROM labels WHERE quality = 1),
b AS (SELECT doc_id AS b_key, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '#42#1'), doc_id) AS rank FROM labels WHERE quality = 0),
j AS (SELECT b.rank, a.doc_id, b_key, (b.rank - 1) // 16 AS batch FROM a, n, b WHERE a.p // n = 1 AND a.p % n + 1 = b.rank)
SELECT * FROM j QUALIFY count(*) OVER (PARTITION BY batch) = 16
"""


def path_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of URLs in lexicographic order of their bytes."""
    return ordered_rank(table(spark, sf_dir, "pages").select("url", "page_id"), ["url", "page_id"])


PATH_RANK = "SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) AS rank FROM pages"


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_rank(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


SHUFFLE = "SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '#7'), o_orderkey) AS rank FROM orders"

_EXISTS = "SELECT doc_id, lang FROM documents WHERE doc_id {} (SELECT doc_id FROM labels)"

QUERIES = {
    "entity_parse": (entity_parse, ENTITY_PARSE),
    "run_key_entities": (run_key_entities, RUN_KEY_ENTITIES),
    "path_template": (path_template, PATH_TEMPLATE),
    "task_and_mask_routing": (task_and_mask_routing, ROUTING),
    "subject_union_split": (subject_union_split, SUBJECT_SPLIT),
    "split_assign_no_leak": (split_assign_no_leak, SPLIT_ASSIGN),
    "split_policy": (split_policy, SPLIT_POLICY),
    "verification_load_errors": (verification_load_errors, VERIFICATION_ERRORS),
    "extraction_log": (extraction_log, EXTRACTION_LOG),
    "patched_columns": (patched_columns, PATCHED),
    "balanced_sample": (balanced_sample, BALANCED),
    "semi_existing": (semi_existing, _EXISTS.format("IN")),
    "anti_existing": (anti_existing, _EXISTS.format("NOT IN")),
    "existence_flag": (existence_flag, "SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS preprocessed_exists FROM documents"),
    "existence_counts": (
        existence_counts,
        "SELECT lang, count(*) FILTER (l.doc_id IS NOT NULL) AS n_found, count(*) FILTER (l.doc_id IS NULL) AS n_missing "
        "FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang",
    ),
    "slice_validation": (slice_validation, SLICES),
    "manifest_keep_last": (manifest_keep_last, KEEP_LAST),
    "manifest_upsert": (manifest_upsert, UPSERT),
    "union_by_name": (union_by_name, UNION_BY_NAME),
    "status_pivot": (status_pivot, STATUS_PIVOT),
    "verification_report": (verification_report, VERIFICATION),
    "pair_zip": (pair_zip, PAIR_ZIP),
    "epoch_queue": (epoch_queue, EPOCH_QUEUE),
    "loader_batches": (loader_batches, LOADER),
    "train_loader": (train_loader, TRAIN_LOADER),
    "path_sort_rank": (path_sort_rank, PATH_RANK),
    "seeded_shuffle": (seeded_shuffle, SHUFFLE),
}
