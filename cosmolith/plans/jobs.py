"""The two jobs as queries: each is run twice into one new folder of the shared one, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cosmolith.functions.shared import shared_dir
from cosmolith.plans.catalogue import _STATS, _round, query
from jobs import common, text_catalogue, track_histories


def _twice(spark, job, source: str) -> str:
    out = f"{shared_dir(spark)}/{job.NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, common.load_config(job.NAME, input=source, output=out))
    return out


@query("""WITH d AS (SELECT user_id track, cast(ts AS date) AS day, count(*) n, sum(cast(value AS decimal(24, 6))) m FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND isfinite(value) GROUP BY 1, 2),
 c AS (SELECT *, date_diff('day', DATE '1970-01-01', day) t, cast(m AS double) mass, cast(sum(m) OVER (PARTITION BY track ORDER BY day) AS double) total FROM d),
 p AS (SELECT *, max(mass) OVER (PARTITION BY track ORDER BY t) peak, lead(total) OVER w nt, lead(t) OVER w tt FROM c WINDOW w AS (PARTITION BY track ORDER BY t)),
 e AS (SELECT *, sum(CASE WHEN mass = peak THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t) epoch FROM p)
SELECT track, day, n, round(mass, 6) mass, round(total, 6) total, round((total - nt) / (t - tt), 6) rate, round(peak, 6) peak, first_value(day) OVER s peak_day,
 round(min(mass / nullif(peak, 0)) OVER s, 6) since_peak_min, strftime(day, '%Y-%m') AS month FROM e WINDOW s AS (PARTITION BY track, epoch ORDER BY t)""")
def job1_track_histories(spark, d):
    return _round(spark.read.parquet(f"{_twice(spark, track_histories, f'{d}/events.parquet')}/histories").withColumn("month", F.col("month").cast("string")))


@query(rf"""WITH w AS (SELECT doc_id id, coalesce(lang, 'und') AS "group", coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
 m AS (SELECT id, "group", cast(len(w) AS bigint) n_words, cast(length(t) AS bigint) n_chars, cast(len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS bigint) n_lines,
  len(list_distinct(w)) / nullif(cast(len(w) AS double), 0) "distinct", length(array_to_string(w, '')) / nullif(cast(len(w) AS double), 0) "length" FROM w),
 b AS (SELECT m.*, bin_id FROM m JOIN (VALUES (0, -1, 64), (1, 64, 256), (2, 256, 1024), (3, 1024, 1000000000000)) v(bin_id, lo, hi) ON n_words > lo AND n_words <= hi),
 r AS (SELECT bin_id, "group", "length" y, row_number() OVER (PARTITION BY bin_id, "group" ORDER BY "length") - 1 r, count(*) OVER (PARTITION BY bin_id, "group") n FROM b WHERE "length" IS NOT NULL),
 st AS (SELECT bin_id, "group", (max(CASE WHEN r = (n - 1) // 2 THEN y END) + max(CASE WHEN r = n // 2 THEN y END)) / 2 median FROM r GROUP BY 1, 2),
 dv AS (SELECT r.bin_id, r."group", r.n, row_number() OVER (PARTITION BY r.bin_id, r."group" ORDER BY abs(y - median)) - 1 k, abs(y - median) dev FROM r JOIN st USING (bin_id, "group")),
 mad AS (SELECT bin_id, "group", dev mad FROM dv WHERE k = n // 2)
SELECT id, bin_id, b."group", n_words, n_chars, n_lines, round("distinct", 6) "distinct", round("length", 6) "length", round("length" - median, 6) "offset", round(("length" - median) / nullif(mad, 0), 6) deviation
FROM b LEFT JOIN st USING (bin_id, "group") LEFT JOIN mad USING (bin_id, "group")""")
def job2_text_catalogue(spark, d):
    return _round(spark.read.parquet(f"{_twice(spark, text_catalogue, f'{d}/documents.parquet')}/catalogue").withColumn("group", F.col("group").cast("string")))
