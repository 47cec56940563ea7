"""Query 2: every page written to archives and read back."""

from trackguard.llm import warc
from trackguard.llm.catalog import query, table

SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100"""


@query("op2_warc", SQL)
def op2_warc(spark, sf_dir):
    return warc.read(warc.write(table(spark, sf_dir, "pages")), payload=False).drop("url")
