"""DuckDB twins of the queries that SQL can express."""

OP7 = """
WITH cap AS (
  SELECT page_id * 2 AS id, url, page_id * 4 AS ts, true AS full_,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, 'day ' || (page_id % 28) AS modified,
    octet_length(encode(coalesce(html, ''))) AS size FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, url, page_id * 4 + CASE WHEN page_id % 7 = 0 THEN -2 ELSE 2 END, false,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN '"changed"' ELSE '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' END,
    'day ' || (page_id % 28), 0 FROM pages
), bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z]+://', '') AS b FROM cap
), part AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '\\.html$', ''), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda f: f <> '' AND NOT (
      starts_with(f, 'utm_') OR starts_with(f, 'ref=') OR starts_with(f, 'fbclid=') OR starts_with(f, 'gclid=')))) AS fields FROM bare
), own AS (
  SELECT id, ts, full_, etag, modified, size, host || path || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS address FROM part
), found AS (
  SELECT r.id, r.ts, r.etag, r.modified, r.address, (SELECT max(f.ts) FROM own f WHERE f.full_ AND f.address = r.address AND f.ts < r.ts) AS then_ts FROM own r WHERE NOT r.full_
), hit AS (
  SELECT r.*, f.id AS target, f.etag AS etag_then, f.modified AS modified_then, f.size AS size_then,
    CASE WHEN f.id IS NULL THEN 'no_response' WHEN r.etag IS NOT NULL THEN CASE WHEN r.etag = f.etag THEN 'resolved' ELSE 'modified' END
      WHEN r.modified = f.modified THEN 'resolved' ELSE 'modified' END AS status
  FROM found r LEFT JOIN own f ON f.full_ AND f.address = r.address AND f.ts = r.then_ts
)
SELECT id AS record_id, address, target AS target_id, status, CASE WHEN status = 'resolved' THEN
  'content-length: ' || size_then || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || ts || chr(10) || 'etag: ' || etag_then || chr(10) || 'x-cache: hit' END AS headers
FROM hit
"""
