"""The column expressions as SQL functions of a session: temporary functions whose bodies Spark inlines, so they cost what the expressions cost."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandlake.functions.columns import FLAG_NAMES

_OPS = "transform(regexp_extract_all({c}, '([0-9]+[MIDNSHP=X])', 1), x -> struct(cast(substr(x, 1, length(x) - 1) as bigint) as n, right(x, 1) as op))"
_SUM = "aggregate(" + _OPS + ", 0L, (a, o) -> a + if(contains('{kinds}', o.op), o.n, 0L))"
_NAMES = ", ".join(f"if((f & {1 << i}) <> 0, '{n}', null)" for i, n in enumerate(FLAG_NAMES))
_NUMBER = "coalesce(try_cast(regexp_extract(c, '{p}', 1) as bigint), 0L)"

FUNCTIONS = {
    "cigar_ops(c STRING) RETURNS ARRAY<STRUCT<n: BIGINT, op: STRING>>": _OPS.format(c="c"),
    "ref_span(c STRING) RETURNS BIGINT": _SUM.format(c="c", kinds="MDN=X"),
    "query_len(c STRING) RETURNS BIGINT": _SUM.format(c="c", kinds="MIS=X"),
    "revcomp(s STRING) RETURNS STRING": "translate(reverse(s), 'ACMGRSVTWYHKDBNacgtn', 'TGKCYSBAWRDMHVNtgcan')",
    "flag_names(f BIGINT) RETURNS STRING": f"concat_ws(',', {_NAMES})",
    "natural_key(s STRING) RETURNS STRING": "array_join(transform(regexp_extract_all(s, '([0-9]+|[^0-9]+)', 1), x -> if(x rlike '^[0-9]', concat('0', lpad(cast(length(ltrim('0', x)) as string), 3, '0'), ltrim('0', x)), x)), '')",
    "unclipped_5p(f BIGINT, p BIGINT, c STRING) RETURNS BIGINT": "if((f & 16) <> 0, p + greatest("
    + _SUM.format(c="c", kinds="MDN=X")
    + ", 1L) + "
    + _NUMBER.format(p="([0-9]+)H$")
    + " + "
    + _NUMBER.format(p="([0-9]+)S(?:[0-9]+H)?$")
    + ", p - "
    + _NUMBER.format(p="^([0-9]+)H")
    + " - "
    + _NUMBER.format(p="^(?:[0-9]+H)?([0-9]+)S")
    + " + 1)",
    "region_overlap(a BIGINT, b BIGINT, c BIGINT, d BIGINT) RETURNS BIGINT": "greatest(0L, least(b, d) - greatest(a, c))",
}
#: Functions that make rows: the operations of a CIGAR with their places, and the runs of a mismatch string.
TABLES = {
    "cigar_blocks(c STRING, p BIGINT) RETURNS TABLE (op STRING, start BIGINT, n BIGINT)": "SELECT o.op, p + aggregate(slice({ops}, 1, i), 0L, (a, x) -> a + if(contains('MDN=X', x.op), x.n, 0L)), o.n FROM (SELECT posexplode({ops}) AS (i, o))".format(ops=_OPS.format(c="c")),
    "md_columns(m STRING) RETURNS TABLE (at INT, kind STRING, text STRING)": "SELECT i, if(x rlike '^[0-9]', '=', if(startswith(x, '^'), 'D', 'X')), ltrim('^', x) FROM (SELECT posexplode(regexp_extract_all(m, '([0-9]+|[\\\\^][A-Za-z]+|[A-Za-z])', 1)) AS (i, x))",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and gives their names."""
    for signature, body in (FUNCTIONS | TABLES).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS | TABLES]
