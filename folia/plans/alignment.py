"""The query of aligned volumes over the documents table, and its SQL.

A thousand documents are a volume. As recognised, every third of them has another letter at each 50th place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import alignment
from folia.plans.shared import rows, with_inputs

LETTER = r"[\p{L}]"
UNITS = "SELECT CAST(floor(doc_id / 1000) AS BIGINT) AS volume, CAST(doc_id % 1000 AS INT) AS unit, text FROM {documents}"


def aligned_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where recognised volumes differ from their authority."""
    units = rows(spark, sf_dir, UNITS)
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    misread = units.withColumn("text", F.when(F.col("unit") % 3 == 0, F.regexp_replace(letters, "(.{49}).", "$1Ω")).otherwise(letters))
    return alignment.substitutions(misread, units, LETTER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"b_aligned_volumes": aligned_volumes}

ORACLE_SQL: dict[str, str] = {
    "b_aligned_volumes": with_inputs(
        """SELECT volume, unit, min(place) AS "at", ocr, auth, find, replace
      FROM (SELECT volume, unit, before + p - 1 AS place, 'Ω' AS ocr, auth[p] AS auth, auth[p-3:p-1] || 'Ω' || ocr[p+1:p+3] AS find, auth[p-3:p-1] || auth[p] || ocr[p+1:p+3] AS replace
            FROM (SELECT volume, unit, before, t AS auth, o || coalesce(substring(following, 1, 3), '') AS ocr, unnest(range(50, length(t) + 1, 50)) AS p
                  FROM (SELECT *, coalesce(sum(length(t)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                               coalesce(lead(substring(o, 1, 3)) OVER w, '') || coalesce(lead(substring(o, 1, 3), 2) OVER w, '') || coalesce(lead(substring(o, 1, 3), 3) OVER w, '') AS following
                        FROM o WINDOW w AS (PARTITION BY volume ORDER BY unit))
                  WHERE unit % 3 = 0)
            WHERE auth[p] <> 'Ω')
      GROUP BY ALL""",
        u=UNITS, t=r"SELECT volume, unit, regexp_replace(coalesce(text, ''), '[^\pL]', '', 'g') AS t FROM u",
        o=r"SELECT volume, unit, t, CASE WHEN unit % 3 = 0 THEN regexp_replace(t, '(.{49}).', '\1Ω', 'g') ELSE t END AS o FROM t WHERE t <> ''"),
}
