"""Query 6: the mix of all documents."""

from trackguard.llm import mixing as M
from trackguard.llm.catalog import query, table

_DRAWS = ", ".join(f"sum(CASE WHEN CAST((coin + {k} * 4398046511104) % 281474976710656 AS DOUBLE) < fraction * 281474976710656.0 THEN size ELSE 0 END) AS d{k}" for k in range(64))
_MISS = ", ".join(f"{{'m': abs(source_size * copies + d{k} - target), 'k': CAST({k} AS BIGINT)}}" for k in range(64))
SQL = f"""
WITH doc AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                    CAST('0x' || substr(md5(coalesce('id:' || doc_id, 'text:' || coalesce(text, ''))), 1, 12) AS BIGINT) AS coin FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
turn AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM src),
room AS (SELECT *, CAST(sum(source_size) OVER () * 3 - 2 * coalesce(sum(cap) OVER o, 0) AS BIGINT) AS left_twice,
                CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS left_weight
         FROM turn WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, left_twice / (left_weight * 2) AS own_level, cap <= left_twice / (left_weight * 2) * weight AS held FROM room),
tgt AS (SELECT source, source_size, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE (SELECT arg_min(own_level, cap / weight) FROM held WHERE NOT held) * weight END AS target FROM held),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1 END AS rate FROM tgt),
per AS (SELECT *, floor(rate) AS copies, rate - floor(rate) AS fraction FROM rate),
drawn AS (SELECT source, {_DRAWS} FROM (SELECT doc.*, fraction FROM doc JOIN per ON doc.source IS NOT DISTINCT FROM per.source) GROUP BY source),
best AS (SELECT per.*, list_min([{_MISS}]).k * 4398046511104 AS shift FROM per JOIN drawn ON drawn.source IS NOT DISTINCT FROM per.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN CAST((coin + shift) % 281474976710656 AS DOUBLE) < fraction * 281474976710656.0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM doc JOIN best ON doc.source IS NOT DISTINCT FROM best.source"""


@query("op6_mixing", SQL)
def op6_mixing(spark, sf_dir):
    return M.mix_report(table(spark, sf_dir, "documents"))
