"""The scalar rules as SQL functions, and the text chunker as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from verdure import search
from verdure.config import Reflectance
from verdure.functions.calendar import MONTHS

_C = Reflectance()
_INDEX = "greatest(-1.0D, least(1.0D, ({n} - {r}) / ({n} + {r})))"
_S2 = f"greatest((CAST({{0}} AS DOUBLE) - CASE WHEN ts >= TIMESTAMP_NTZ '{_C.offset_from}' THEN {_C.offset}D ELSE 0D END) / {_C.scale}D, 0.0001D)"
_HLS = f"greatest(CAST({{0}} AS DOUBLE) / {_C.scale}D, 0.0001D)"
_PART = "trim(regexp_extract(lower(trim(raw)), '^([^-/–]*)', 1))"

#: Name and parameters, result type, body.
FUNCTIONS = {
    "ndvi_classes(red INT, nir INT, cls INT, ts TIMESTAMP_NTZ)": ("DOUBLE", f"CASE WHEN red > 0 AND nir > 0 AND cls IN {_C.clear_classes} THEN {_INDEX.format(r=_S2.format('red'), n=_S2.format('nir'))} END"),
    "ndvi_bits(red INT, nir INT, qa INT)": ("DOUBLE", f"CASE WHEN red <> {_C.fill} AND nir <> {_C.fill} AND qa <> {_C.qa_fill} AND (qa & {_C.bad_bits}) = 0 AND (shiftright(qa, {_C.aerosol_shift}) & 3) <> {_C.aerosol_high} THEN {_INDEX.format(r=_HLS.format('red'), n=_HLS.format('nir'))} END"),
    "parse_month(raw STRING)": ("INT", f"CASE WHEN try_cast({_PART} AS DOUBLE) IS NOT NULL THEN CASE WHEN bround(try_cast({_PART} AS DOUBLE)) BETWEEN 1 AND 12 AND NOT isnan(try_cast({_PART} AS DOUBLE)) THEN CAST(bround(try_cast({_PART} AS DOUBLE)) AS INT) END WHEN length({_PART}) >= 3 THEN nullif(CAST(array_position(array({', '.join(repr(m) for m in MONTHS)}), substr({_PART}, 1, 3)) AS INT), 0) END"),
    "stage_at(qc INT, emergence DOUBLE, panicle_init DOUBLE, peak DOUBLE, harvest DOUBLE, day DOUBLE)": ("INT", "CASE WHEN qc IS NULL THEN -1 WHEN qc >= 10 THEN 0 WHEN harvest <= day THEN 5 WHEN peak <= day THEN 4 WHEN panicle_init <= day THEN 3 WHEN emergence <= day THEN 2 ELSE 1 END"),
}


@udtf(returnType="source string, chunk string")
class Chunks:
    """``SELECT d.id, c.* FROM docs d, LATERAL chunks(d.name, d.text) c``."""

    def eval(self, name: str | None, text: str | None) -> Iterator[tuple[str, str]]:
        yield from search.chunks_of(name or "", text or "")


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session's SQL; returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("chunks", Chunks)
    return [h.partition("(")[0] for h in FUNCTIONS] + ["chunks"]
