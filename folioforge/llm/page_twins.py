"""DuckDB twins of the page operators, for tables whose pages have one ``<article>`` of headings and paragraphs."""

from __future__ import annotations


def _unescaped(c: str) -> str:
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


EXTRACT = f"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS art FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(art, '</?(?:p|h1)>'), lambda x: trim(regexp_replace({_unescaped("regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))) AS t FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(t, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""


def _id(*parts: str) -> str:
    h = f"sha256(concat_ws(chr(0), {', '.join(parts)}))"
    return f"('<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>')"


_HIDDEN = "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<iframe[^>]*>.*?</iframe>|<head>.*?</head>"
_LINE = "(?i)</?(?:article|body|br|div|footer|h1|html|li|nav|ol|p|title|ul)[^>]*>"
_PLAIN = _unescaped(f"regexp_replace(regexp_replace(replace(regexp_replace(body, '{_HIDDEN}', '', 'g'), chr(10), ' '), '{_LINE}', chr(10), 'g'), '<[^>]*>', '', 'g')")

WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body, CAST(page_id AS VARCHAR) AS k FROM pages),
r AS (SELECT *, {_id("'response'", "coalesce(k, '')", "url", "body")} AS rid, 'sha256:' || sha256(body) AS source_digest,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) AS headers,
  array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS plain FROM p),
m AS (SELECT *, 'source-content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-status: 200' || chr(13) || chr(10) || 'source-length: ' || strlen(body) || chr(13) || chr(10) || 'text-length: ' || strlen(plain) || chr(13) || chr(10)
  || 'title: ' || trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) || chr(13) || chr(10) || 'conversion-id: ' || {_id("'conversion'", "rid")} || chr(13) || chr(10) || chr(13) || chr(10) || headers AS fields FROM r),
x AS (SELECT page_id, 'metadata' AS record_type, rid, url, source_digest, 'application/warc-fields' AS content_type, fields AS block FROM m
  UNION ALL SELECT page_id, 'conversion', rid, url, source_digest, 'text/plain; charset=utf-8', plain FROM m)
SELECT page_id, record_type, {_id("record_type", "rid")} AS record_id, rid AS refers_to, url AS target_uri, '1970-01-01T00:00:00Z' AS date, content_type, block, 'sha256:' || sha256(block) AS block_digest, source_digest FROM x
"""
