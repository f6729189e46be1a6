"""Queries of the general problems 2 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import incremental, units
from tesserae.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.process(load(spark, d, "file_scans"), load(spark, d, "index_runs"), load(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.agreeing(units.common_values(load(spark, d, "extracted_values"), load(spark, d, "label_units")))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return units.common_values(load(spark, d, "extracted_values"), load(spark, d, "label_units"))


QUERIES = {f.__name__: f for f in (p2_found, p5_found, p5_values)}

SQL = {
    "p2_found": """
WITH good AS (SELECT DISTINCT run_id FROM index_runs WHERE run_status = 'success'),
cur AS (SELECT * FROM files WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY try_cast(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST) = 1),
held AS (SELECT source_path, lower(left(sha256, 16)) AS held FROM cur WHERE status = 'indexed' AND sha256 <> ''),
content AS (
  SELECT g.run_id, s.source_path, arg_max(lower(left(s.sha256, 16)), {'a': s.scanned_at, 'b': s.scan_id}) AS now
  FROM good g JOIN file_scans s ON s.run_id <= g.run_id WHERE s.sha256 <> '' AND s.source_path IS NOT NULL GROUP BY ALL),
steps AS (SELECT c.run_id, c.source_path, now, held, lag(now) OVER w AS before, row_number() OVER w AS k
  FROM content c LEFT JOIN held USING (source_path) WINDOW w AS (PARTITION BY c.source_path ORDER BY c.run_id))
SELECT run_id, source_path FROM steps WHERE now IS DISTINCT FROM CASE WHEN k = 1 THEN held ELSE before END
""",
}
