"""Independent SQL for every check in :mod:`fleetframe.plans.checks`.

Written for DuckDB over the driver's tables (views ``region nation customer
supplier part orders lineitem events documents embeddings pages benchmark
labels conversations``).  Composed-text checks build the same lines as the
Spark side and parse them with SQL regular expressions, so the parsers are
compared, not their inputs.  Column names match the Spark output.
"""

from __future__ import annotations

ASSIGN = r"^\s*([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
LOG = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (?:(WARNING|ERROR|INFO): )?(.*)$"
ALIASES = ("('scm','scm'),('SCM','scm'),('om','om'),('OM','om'),('datanode','datanode'),"
           "('DataNode','datanode'),('DATANODE','datanode'),('recon','recon'),('Recon','recon'),"
           "('RECON','recon'),('s3gateway','s3gateway'),('S3Gateway','s3gateway'),"
           "('S3GATEWAY','s3gateway'),('httpfs','httpfs'),('HttpFS','httpfs'),('HTTPFS','httpfs')")
TS = "'%Y-%m-%d %H:%M:%S'"

SQL: dict[str, str] = {}

SQL["conf_parse"] = rf"""
WITH l AS (
  SELECT c_custkey, CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN 'CUST_' || c_custkey || '="' || c_name || '"  # ' || c_mktsegment
    WHEN 'BUILDING' THEN '# CUST_' || c_custkey || '="' || c_name || '"'
    WHEN 'FURNITURE' THEN 'CUST_' || c_custkey || '=' || c_nationkey
    WHEN 'HOUSEHOLD' THEN '  CUST_' || c_custkey || '="\${{NATION}}/' || c_nationkey || '"'
    ELSE 'CUST_' || c_custkey || '=''' || c_name || ' ' || c_mktsegment || '''  # quoted' END AS line
  FROM customer),
p AS (
  SELECT c_custkey, regexp_extract(line, '{ASSIGN}', 1) AS key, regexp_extract(line, '{ASSIGN}', 2) AS rest
  FROM l WHERE regexp_matches(line, '{ASSIGN}'))
SELECT c_custkey, key,
  CASE WHEN starts_with(rest, '"')
         THEN regexp_replace(regexp_extract(rest, '^"((?:[^"\\]|\\.)*)"', 1), '\\([$"\\`])', '\1', 'g')
       WHEN starts_with(rest, '''') THEN regexp_extract(rest, '^''([^'']*)''', 1)
       ELSE regexp_replace(regexp_extract(rest, '^(\S*)', 1), '\\(.)', '\1', 'g') END AS value
FROM p
"""

SQL["conf_last_wins"] = rf"""
WITH l AS (SELECT c_nationkey AS source, c_custkey AS line_no,
                  'SEG_' || c_mktsegment || '="' || c_name || '"' AS line FROM customer),
p AS (SELECT source, line_no, regexp_extract(line, '{ASSIGN}', 1) AS key,
             regexp_extract(regexp_extract(line, '{ASSIGN}', 2), '^"((?:[^"\\]|\\.)*)"', 1) AS value
      FROM l WHERE regexp_matches(line, '{ASSIGN}'))
SELECT source, key, arg_max(value, line_no) AS value, max(line_no) AS line_no FROM p GROUP BY source, key
"""

SQL["xml_props"] = r"""
WITH x AS (SELECT n_nationkey, '<property><name>nation.' || n_nationkey || '</name><value>' || n_name
                  || '</value>' || CASE WHEN n_regionkey <> 0 THEN '<description>region ' || n_regionkey
                  || '</description>' ELSE '' END || '</property>' AS xml FROM nation)
SELECT n_nationkey, regexp_extract(xml, '<name>([^<]*)</name>', 1) AS name,
       regexp_extract(xml, '<value>([^<]*)</value>', 1) AS value,
       CASE WHEN regexp_matches(xml, '<description>')
            THEN regexp_extract(xml, '<description>([^<]*)</description>', 1) END AS description
FROM x
"""

SQL["props_resolve"] = r"""
WITH raw AS (
  SELECT p_brand AS source, 'part.' || p_partkey || '.type = ' || p_type AS line FROM part
  UNION ALL SELECT p_brand, 'part.' || p_partkey || '.label=${part.' || p_partkey || '.type}/${brand.'
                   || p_brand || '}/size-' || p_size FROM part
  UNION ALL SELECT p_brand, 'part.' || p_partkey || '.full=${part.' || p_partkey || '.label}@$x' FROM part
  UNION ALL SELECT p_brand, '# part ' || p_partkey FROM part),
kv AS (SELECT source, trim(split_part(line, '=', 1)) AS key, trim(substr(line, strpos(line, '=') + 1)) AS value
       FROM raw WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')
                  AND NOT starts_with(trim(line), '!') AND strpos(line, '=') > 0),
tk AS (SELECT source, key, regexp_extract_all(value, '(\$\{[^}]*\}|[^$]+|\$)', 1) AS toks FROM kv),
tok AS (SELECT source, key, unnest(range(len(toks))) AS pos, unnest(toks) AS t FROM tk),
res AS (SELECT tok.source, tok.key, tok.pos, coalesce(d.value, tok.t) AS piece
        FROM tok LEFT JOIN kv d ON d.source = tok.source
             AND regexp_matches(tok.t, '^\$\{[^}]*\}$')
             AND d.key = regexp_extract(tok.t, '^\$\{([^}]*)\}$', 1))
SELECT source, key, string_agg(piece, '' ORDER BY pos) AS resolved FROM res GROUP BY source, key
"""

SQL["pipe_facts"] = r"""
WITH r AS (SELECT s_suppkey,
             concat_ws('|', s_name, '10.' || s_nationkey || '.' || s_suppkey,
                       CASE WHEN s_acctbal < 0 THEN 'ppc64le' ELSE 'x86_64' END, 'Linux', 'rocky')
             || CASE WHEN s_acctbal >= 0 THEN '|9.' || s_nationkey ELSE '' END AS raw FROM supplier),
s AS (SELECT s_suppkey, string_split(raw, '|') AS f FROM r)
SELECT s_suppkey, f[1] AS hostname, f[2] AS ip_address, f[3] AS cpu_arch, f[4] AS os_type,
       f[5] AS os_dist, CASE WHEN len(f) >= 6 THEN f[6] END AS os_version FROM s
"""

_LOG_BODY = "'user ' || user_id || ' event ' || event_id"
_STAMP = f"'[' || strftime(ts, {TS}) || '] '"
SQL["log_parse"] = rf"""
WITH l AS (SELECT event_id, CASE event_type
    WHEN 'error' THEN chr(27) || '[0;31m' || {_STAMP} || 'ERROR: ' || {_LOG_BODY} || chr(27) || '[0m'
    WHEN 'click' THEN chr(27) || '[1;33m' || {_STAMP} || 'WARNING: ' || {_LOG_BODY} || chr(27) || '[0m'
    WHEN 'view' THEN chr(27) || '[0;34m' || {_STAMP} || 'INFO: ' || {_LOG_BODY} || chr(27) || '[0m'
    WHEN 'purchase' THEN chr(27) || '[0;32m' || {_STAMP} || {_LOG_BODY} || chr(27) || '[0m'
    ELSE 'no timestamp here: ' || {_LOG_BODY} END AS line FROM events),
c AS (SELECT event_id, regexp_replace(line, chr(27) || '\[[0-9;]*m', '', 'g') AS clean FROM l)
SELECT event_id,
  CASE WHEN regexp_matches(clean, '{LOG}')
       THEN strftime(strptime(regexp_extract(clean, '{LOG}', 1), {TS}), {TS}) END AS ts,
  CASE WHEN regexp_matches(clean, '{LOG}')
       THEN coalesce(nullif(regexp_extract(clean, '{LOG}', 2), ''), 'LOG') END AS level,
  CASE WHEN regexp_matches(clean, '{LOG}') THEN regexp_extract(clean, '{LOG}', 3) ELSE clean END AS message
FROM c
"""

SQL["test_log_parse"] = r"""
WITH l AS (SELECT event_id, CASE event_type
    WHEN 'purchase' THEN chr(27) || '[0;32m[PASS] check ' || event_id || chr(27) || '[0m'
    WHEN 'error' THEN chr(27) || '[0;31m[FAIL] check ' || event_id || chr(27) || '[0m'
    WHEN 'signup' THEN '[TEST] check ' || event_id
    ELSE 'Tests run: ' || event_id END AS line FROM events),
c AS (SELECT event_id, regexp_replace(line, chr(27) || '\[[0-9;]*m', '', 'g') AS clean FROM l)
SELECT event_id, regexp_extract(clean, '^\[(PASS|FAIL|TEST)\] (.*)$', 1) AS status,
       regexp_extract(clean, '^\[(PASS|FAIL|TEST)\] (.*)$', 2) AS name
FROM c WHERE regexp_matches(clean, '^\[(PASS|FAIL|TEST)\] (.*)$')
"""

SQL["step_parse"] = r"""
WITH l AS (SELECT event_id, CASE WHEN event_type = 'error'
             THEN 'FAILED:host' || user_id || ':stage' || nullif(regexp_extract(props, '([0-9]+)', 1), '')
             ELSE 'SUCCESS:host' || user_id END AS line FROM events),
s AS (SELECT event_id, string_split(line, ':') AS f FROM l)
SELECT event_id, CASE WHEN f[1] IN ('SUCCESS', 'FAILED') THEN f[1] END AS status,
       CASE WHEN len(f) >= 2 THEN f[2] END AS host,
       CASE WHEN len(f) >= 3 THEN array_to_string(f[3:], ':') END AS stage FROM s
"""

SQL["ps_parse"] = r"""
WITH l AS (SELECT s_suppkey, 'rocky  ' || s_suppkey || '  0.0  1.2 123456 7890 ?  Ssl  10:00   0:01 '
             || CASE WHEN s_acctbal < 0 THEN 'grep -E proc_' || s_nationkey
                     ELSE 'java -Dproc_' || s_nationkey || ' -cp /opt/x ' || s_name END AS line FROM supplier)
SELECT s_suppkey,
       regexp_extract(trim(line), '^(\S+)\s+(\S+)\s+(?:\S+\s+){8}(.*)$', 1) AS "user",
       CAST(regexp_extract(trim(line), '^(\S+)\s+(\S+)\s+(?:\S+\s+){8}(.*)$', 2) AS BIGINT) AS pid,
       regexp_extract(trim(line), '^(\S+)\s+(\S+)\s+(?:\S+\s+){8}(.*)$', 3) AS cmd
FROM l WHERE NOT contains(line, 'grep')
"""

PORT = r"""^\s*-\s*["'']?(\d+):(\d+)["'']?"""
SQL["compose_parse"] = rf"""
WITH nl AS (
  SELECT n_regionkey AS source, 100 + n_nationkey * 10 + i AS line_no,
         ['  ' || replace(lower(n_name), ' ', '_') || ':', '    image: rocky9-ssh', '    ports:',
          '      - "' || (n_nationkey + 2200) || ':22"    # SSH',
          '      - ''' || (n_nationkey + 9000) || ':' || (n_nationkey + 9000) || '''',
          '    environment:', '      - NODE=1'][i + 1] AS line
  FROM nation, range(7) t(i)),
fl AS (SELECT r_regionkey AS source, f.line_no, f.line FROM region,
       (VALUES (0, 'services:'), (1, '  # nodes'), (10000, 'networks:'), (10001, '  fleet-net:'),
               (10002, '    ports:'), (10003, '      - "1:1"'), (10004, 'volumes:'), (10005, '  data:'))
       f(line_no, line)),
lines AS (SELECT * FROM nl UNION ALL SELECT * FROM fl),
m AS (SELECT source, line_no, line,
        CASE WHEN regexp_matches(line, '^[A-Za-z0-9_.-]+:')
             THEN regexp_extract(line, '^([A-Za-z0-9_.-]+):', 1) END AS top,
        CASE WHEN regexp_matches(line, '^  ([A-Za-z0-9_.-]+):\s*(#.*)?$')
               THEN regexp_extract(line, '^  ([A-Za-z0-9_.-]+):\s*(#.*)?$', 1)
             WHEN regexp_matches(line, '^[A-Za-z0-9_.-]+:') THEN '' END AS svc
      FROM lines),
c AS (SELECT *, last_value(top IGNORE NULLS) OVER w AS sec, last_value(svc IGNORE NULLS) OVER w AS service
      FROM m WINDOW w AS (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT source, service, CAST(regexp_extract(line, '{PORT}', 1) AS INTEGER) AS host_port,
       CAST(regexp_extract(line, '{PORT}', 2) AS INTEGER) AS container_port
FROM c WHERE regexp_matches(line, '{PORT}') AND sec = 'services' AND service <> ''
"""

DIR_ATTR = r"^\s+(Owner|Permissions|Mount point|Filesystem type|Mount options):\s*(.*?)\s*$"
DIR_HDR = r"^Directory:\s*(.*?)\s*$"
SQL["dir_report"] = r"""
WITH s AS (SELECT *, CASE WHEN s_acctbal > 3000 THEN 'rocky:rocky' ELSE 'root:root' END AS own,
                  CASE WHEN s_acctbal > 5000 THEN '750' ELSE '700' END AS mode FROM supplier)
SELECT 'v' || s_nationkey AS source, 'h' || s_suppkey % 2 AS host, 'data' AS kind, '/data/s' || s_suppkey AS dir,
       CASE WHEN s_acctbal >= 0 THEN own END AS owner, CASE WHEN s_acctbal >= 0 THEN mode END AS perms,
       NULL::VARCHAR AS mount_point, NULL::VARCHAR AS fs_type, NULL::VARCHAR AS mount_options,
       CASE WHEN s_acctbal >= 0 THEN s_acctbal > 1000 END AS writable, s_acctbal >= 0 AS "exists" FROM s
UNION ALL SELECT 'v' || s_nationkey, 'h' || s_suppkey % 2, 'config', '/etc/c' || s_suppkey, 'root:root', '755',
       NULL, NULL, NULL, NULL, true FROM s WHERE s_acctbal > 6000
UNION ALL SELECT 'i' || s_nationkey, 'h' || s_suppkey % 2, 'data', '/data/s' || s_suppkey, own, mode,
       '/dev/sd' || s_suppkey % 3, CASE WHEN s_acctbal > 2000 THEN 'xfs' ELSE 'btrfs' END,
       CASE WHEN s_acctbal > 4000 THEN 'rw,noatime' ELSE 'rw' END, NULL, true FROM s
"""

SQL["dir_rules"] = r"""
WITH v AS (SELECT 'v' || s_nationkey AS source, 'h' || s_suppkey % 2 AS host, s_suppkey AS k, s_acctbal AS b FROM supplier),
d AS (SELECT source, host, 'data' AS kind, '/data/s' || k AS dir, b FROM v)
SELECT source, host, kind, dir, 'exists' AS setting, CASE WHEN b >= 0 THEN 'ok' ELSE 'violation' END AS status FROM d
UNION ALL SELECT source, host, kind, dir, 'owner', CASE WHEN b < 0 THEN 'n/a' WHEN b > 3000 THEN 'ok' ELSE 'violation' END FROM d
UNION ALL SELECT source, host, kind, dir, 'perms', CASE WHEN b < 0 THEN 'n/a' WHEN b > 5000 THEN 'ok' ELSE 'violation' END FROM d
UNION ALL SELECT source, host, kind, dir, 'writable', CASE WHEN b < 0 THEN 'n/a' WHEN b > 1000 THEN 'ok' ELSE 'violation' END FROM d
UNION ALL SELECT source, host, 'config', '/etc/c' || k, 'owner', 'violation' FROM v WHERE b > 6000
"""

SQL["log_lines"] = rf"""
WITH l AS (SELECT strftime(ts, '%Y%m%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY event_id) - 1 AS line_no,
                  event_type, {_LOG_BODY} AS body FROM events),
m AS (SELECT *, max(CASE WHEN event_type = 'error' THEN line_no END) OVER (
        PARTITION BY day ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM l)
SELECT day, line_no, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO'
                                     WHEN 'purchase' THEN 'LOG' END AS level,
       CASE WHEN event_type IN ('error', 'click', 'view', 'purchase') THEN body ELSE 'no timestamp here: ' || body END AS message
FROM m WHERE hit IS NOT NULL
"""

SQL["fs_rules"] = r"""
WITH v AS (SELECT 'i' || s_nationkey AS source, 'h' || s_suppkey % 2 AS host, '/data/s' || s_suppkey AS dir, s_acctbal AS b FROM supplier)
SELECT source, host, dir, 'fs_type' AS setting, CASE WHEN b > 2000 THEN 'xfs' ELSE 'btrfs' END AS raw_value,
       CASE WHEN b > 2000 THEN 'ok' ELSE 'violation' END AS status FROM v
UNION ALL SELECT source, host, dir, 'mount_options', CASE WHEN b > 4000 THEN 'rw,noatime' ELSE 'rw' END,
       CASE WHEN b > 4000 THEN 'ok' ELSE 'violation' END FROM v
"""

_KERNEL = r"""
k AS (SELECT 'h' || c_custkey AS host, 'cpu_governor' AS setting,
             CASE c_custkey % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'powersave' END AS raw_value FROM customer
      UNION ALL SELECT 'h' || c_custkey, 'transparent_hugepage',
             CASE WHEN c_acctbal > 5000 THEN 'always madvise [never]' ELSE '[always] madvise never' END FROM customer
      UNION ALL SELECT 'h' || c_custkey, 'selinux',
             CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'Enforcing' ELSE 'Disabled' END FROM customer
      UNION ALL SELECT 'h' || c_custkey, 'swappiness', (c_custkey % 2)::VARCHAR FROM customer),
kv AS (SELECT *, CASE WHEN raw_value IS NULL THEN 'n/a'
                      WHEN raw_value IN ('performance', 'always madvise [never]', 'Disabled', '1') THEN 'ok'
                      ELSE 'violation' END AS status FROM k)
"""

SQL["kernel_rules"] = f"WITH {_KERNEL} SELECT host, setting, raw_value, status FROM kv"

SQL["compliance_flow"] = f"""
WITH {_KERNEL},
d AS (SELECT 'v' || s_nationkey || '-h' || s_suppkey % 2 AS host, s_acctbal AS b FROM supplier),
i AS (SELECT 'i' || s_nationkey || '-h' || s_suppkey % 2 AS host, s_acctbal AS b FROM supplier),
r AS (SELECT 'kernel' AS check, setting, status, host FROM kv
  UNION ALL SELECT 'filesystem', 'fs_type', CASE WHEN b > 2000 THEN 'ok' ELSE 'violation' END, host FROM i
  UNION ALL SELECT 'filesystem', 'mount_options', CASE WHEN b > 4000 THEN 'ok' ELSE 'violation' END, host FROM i
  UNION ALL SELECT 'directory', 'exists', CASE WHEN b >= 0 THEN 'ok' ELSE 'violation' END, host FROM d
  UNION ALL SELECT 'directory', 'owner', CASE WHEN b < 0 THEN 'n/a' WHEN b > 3000 THEN 'ok' ELSE 'violation' END, host FROM d
  UNION ALL SELECT 'directory', 'perms', CASE WHEN b < 0 THEN 'n/a' WHEN b > 5000 THEN 'ok' ELSE 'violation' END, host FROM d
  UNION ALL SELECT 'directory', 'writable', CASE WHEN b < 0 THEN 'n/a' WHEN b > 1000 THEN 'ok' ELSE 'violation' END, host FROM d)
SELECT "check", setting, status, count(*) AS n, count(DISTINCT host) AS hosts FROM r GROUP BY ALL
"""

SQL["step_report_flow"] = r"""
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, 'host' || user_id AS host, event_type <> 'error' AS ok FROM events),
s AS (SELECT run_id, count(*) FILTER (WHERE ok) AS n_ok, count(*) AS n_total,
             coalesce(string_agg(DISTINCT host, ',' ORDER BY host) FILTER (WHERE NOT ok), '') AS failed_hosts FROM e GROUP BY 1),
u AS (SELECT r.run_id, count(*) AS n FROM (SELECT DISTINCT run_id FROM e) r CROSS JOIN (SELECT DISTINCT host FROM e) h
      WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = r.run_id AND e.host = h.host AND ok) GROUP BY 1)
SELECT run_id, n_ok, n_total, failed_hosts, CASE WHEN n_ok = n_total THEN 'SUCCESS' WHEN n_ok = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS overall,
       coalesce(u.n, 0)::BIGINT AS n_unverified FROM s LEFT JOIN u USING (run_id)
"""

SQL["start_plan_flow"] = r"""
WITH h AS (SELECT s_nationkey AS n, list('s' || s_suppkey ORDER BY s_suppkey) AS l FROM supplier GROUP BY 1),
c AS (SELECT n_nationkey AS n, 'n' || n_nationkey AS source, CASE WHEN n_nationkey % 5 = 0 THEN [] ELSE ['c1', 'c2'] END AS all_,
             CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE l END AS l FROM nation LEFT JOIN h ON h.n = n_nationkey),
p AS (SELECT source, rank, service, CASE WHEN service = 'scm' AND l IS NOT NULL THEN l WHEN service = 'datanode' THEN all_
             ELSE all_[1:1] END AS hosts
      FROM c, (VALUES (1, 'scm'), (2, 'om'), (3, 'datanode'), (4, 'recon'), (5, 's3gateway'), (6, 'httpfs')) AS o(rank, service)),
x AS (SELECT source, rank, service, unnest(hosts) AS host, unnest(range(len(hosts))) AS pos FROM p),
y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, pos) AS seq, count(*) OVER (PARTITION BY source) AS n FROM x)
SELECT source, service, host, seq, n - seq + 1 AS stop_seq,
       CASE WHEN service <> 'scm' THEN NULL WHEN pos = 0 THEN '--init' ELSE '--bootstrap' END AS command FROM y
"""

SQL["jdk_choice"] = r"""
WITH h AS (SELECT 'h' || c_custkey AS host, c_nationkey AS n, ['yum','dnf','apt-get','zypper','brew'][c_custkey % 5 + 1] AS manager,
                  ['8','11','17'][c_nationkey % 3 + 1] AS jdk FROM customer),
o(i, package) AS (VALUES (0, 'java-1.8.0-openjdk'), (1, 'java-1.8.0-openjdk-devel'), (2, 'java-11-openjdk'),
  (3, 'java-11-openjdk-devel'), (4, 'java-17-openjdk'), (5, 'openjdk-17-jdk'), (6, 'openjdk-11-jdk'),
  (7, 'java-1_8_0-openjdk'), (8, 'vim')),
w AS (
  SELECT host, n, manager, jdk, CASE
    WHEN manager IN ('yum', 'dnf') AND jdk = '8' AND (0 + n) % 4 <> 0 THEN ['java-1.8.0-openjdk', 'java-1.8.0-openjdk-devel']
    WHEN manager IN ('yum', 'dnf') AND jdk = '8' THEN ['java-11-openjdk', 'java-11-openjdk-devel']
    WHEN manager = 'zypper' AND jdk = '8' THEN ['java-1_8_0-openjdk', 'java-1_8_0-openjdk-devel']
    WHEN manager IN ('yum', 'dnf', 'zypper') THEN ['java-' || jdk || '-openjdk', 'java-' || jdk || '-openjdk-devel']
    WHEN manager = 'apt-get' THEN ['openjdk-' || jdk || '-jdk', 'openjdk-11-jdk', 'openjdk-17-jdk', 'openjdk-21-jdk', 'openjdk-8-jdk']
    ELSE [] END AS names FROM h),
f AS (SELECT host, p, min(pos) AS pos FROM (
        SELECT host, n, unnest(names) AS p, unnest(range(len(names))) AS pos FROM w)
      JOIN o ON o.package = p AND (o.i + n) % 4 <> 0 GROUP BY host, p),
r AS (SELECT host, p, row_number() OVER (PARTITION BY host ORDER BY pos) AS k FROM f)
SELECT w.host, manager, jdk, coalesce(string_agg(p, ' ' ORDER BY k), '') AS packages
FROM w LEFT JOIN r ON r.host = w.host AND (manager <> 'apt-get' OR k = 1) GROUP BY ALL
"""

SQL["os_fallback"] = r"""
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'non-linux' WHEN s_suppkey % 4 = 0 THEN 'rocky'
                       WHEN s_suppkey % 3 = 0 THEN 'redhat' ELSE 'unknown' END AS os_dist,
       CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' WHEN s_suppkey % 8 = 0 THEN '9.2' WHEN s_suppkey % 4 = 0 THEN ''
            WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR ELSE 'unknown' END AS dist_version FROM supplier
"""

SQL["manifest_targets"] = r"""
WITH f AS (SELECT d || '/' || n AS file, (row_number() OVER (ORDER BY i, j))::BIGINT AS k FROM
  (SELECT unnest(['/etc/hadoop', '/opt/ozone/conf/om', '/opt/ozone/conf/scm', '/opt/ozone/conf/datanode',
    '/opt/ozone/conf/recon', '/opt/ozone/conf/s3g', '/opt/ozone/conf/httpfs', '/opt/ozone/etc/hadoop']) AS d, unnest(range(8)) AS i),
  (SELECT unnest(['core-site.xml', 'ozone-site.xml', 'log4j.properties']) AS n, unnest(range(3)) AS j)),
e AS (SELECT file, (sum(p_size) % 5 * 10 + 10)::BIGINT AS size FROM f JOIN part ON k = p_partkey % 24 + 1 GROUP BY file),
s AS (SELECT DISTINCT 'n' || s_nationkey AS host, file,
             CASE WHEN s_acctbal > 0 THEN s_suppkey % 5 * 10 + 10 ELSE 0 END AS size
      FROM supplier JOIN f ON k = s_suppkey % 24 + 1),
t AS (SELECT 'n' || n_nationkey AS host, file FROM nation, f)
SELECT host, file, s.size AS actual_size, e.size AS expected_size,
       coalesce(s.size = e.size AND s.size > 0, false) AS ok
FROM t FULL JOIN s USING (host, file) LEFT JOIN e USING (file)
"""

SQL["os_release"] = r"""
SELECT s_suppkey::VARCHAR AS source, 'rocky' || s_nationkey AS os_id,
       CASE WHEN s_acctbal > 0 THEN '9.' || s_nationkey END AS os_version FROM supplier
"""

SQL["site_props_full"] = r"""
WITH h AS (SELECT s_nationkey AS n, list('s' || s_suppkey ORDER BY s_suppkey) AS l FROM supplier GROUP BY 1),
c AS (SELECT n_nationkey AS n, 'n' || n_nationkey AS source, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'c1' END AS one,
             CASE WHEN n_nationkey % 2 = 1 THEN 'cl' || n_nationkey ELSE '' END AS sid,
             CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE l END AS l FROM nation LEFT JOIN h ON h.n = n_nationkey),
k(name, key) AS (VALUES
  ('ozone.scm.db.dirs', 'OZONE_SCM_DB_DIRS'), ('ozone.scm.ha.ratis.storage.dir', ''), ('ozone.metadata.dirs', ''),
  ('ozone.om.db.dirs', ''), ('ozone.om.ratis.storage.dir', ''), ('ozone.recon.db.dir', ''),
  ('ozone.recon.scm.db.dirs', ''), ('ozone.recon.om.db.dir', ''), ('ozone.scm.datanode.id.dir', ''),
  ('dfs.container.ratis.datanode.storage.dir', ''), ('hdds.datanode.dir', ''))
SELECT source, name, CASE WHEN key <> '' AND n % 4 = 1 THEN '/d' || n ELSE '' END AS value FROM c, k
UNION ALL SELECT source, 'ozone.enabled', 'true' FROM c
UNION ALL SELECT source, 'ozone.security.enabled', 'false' FROM c
UNION ALL SELECT source, 'ozone.recon.address', one FROM c
UNION ALL SELECT source, 'ozone.om.address', one FROM c
UNION ALL SELECT source, 'ozone.scm.service.ids', sid FROM c WHERE len(l) > 1
UNION ALL SELECT source, 'ozone.scm.nodes.' || sid, array_to_string(l, ',') FROM c WHERE len(l) > 1
UNION ALL SELECT source, 'ozone.scm.address.' || sid || '.' || x, x
          FROM (SELECT source, sid, unnest(l) AS x FROM c WHERE len(l) > 1)
UNION ALL SELECT source, 'ozone.scm.names', coalesce(l[1], one) FROM c WHERE coalesce(len(l), 0) <= 1
UNION ALL SELECT source, 'ozone.scm.client.address', coalesce(l[1], one) || ':9860' FROM c WHERE coalesce(len(l), 0) <= 1
"""

SQL["core_props"] = r"""
SELECT 'n' || n_nationkey AS source, name, value FROM nation, (VALUES
  ('fs.defaultFS', 'ofs://ozone1/'), ('fs.ofs.impl', 'org.apache.hadoop.fs.ozone.OzoneFileSystem'),
  ('fs.AbstractFileSystem.ofs.impl', 'org.apache.hadoop.fs.ozone.OzFs')) AS v(name, value)
"""

SQL["service_status_real"] = r"""
WITH p AS (SELECT 'h' || user_id AS host, ['scm','om','datanode','recon','s3gateway','httpfs'][event_id % 6 + 1] AS service,
                  min(event_id) AS pid FROM events WHERE event_type <> 'signup' GROUP BY 1, 2),
g AS (SELECT DISTINCT 'h' || c_custkey AS host, service
      FROM customer, (SELECT unnest(['scm','om','datanode','recon','s3gateway','httpfs']) AS service))
SELECT g.host, g.service, CASE WHEN pid IS NULL THEN 'not running' ELSE 'running' END AS status, pid
FROM g LEFT JOIN p USING (host, service)
"""

SQL["pids_by_service"] = r"""
SELECT 'h' || user_id AS host, ['scm','om','datanode','recon','s3gateway','httpfs'][event_id % 6 + 1] AS service,
       string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS pids, count(*) AS n
FROM events WHERE event_type <> 'signup' GROUP BY 1, 2
"""

SQL["xml_write"] = r"""
SELECT (l_orderkey // 1000)::VARCHAR AS source, 'p.' || l_orderkey || '.' || l_linenumber AS name, '<&v ' || l_suppkey AS value,
       1::BIGINT AS files FROM lineitem
"""

SQL["props_write"] = r"""
SELECT n_nationkey::VARCHAR AS source, 'base' AS key, '/b' || n_nationkey AS value FROM nation
UNION ALL SELECT s_nationkey::VARCHAR, 'k' || s_suppkey, '/b' || s_nationkey || '/' || s_suppkey FROM supplier
"""

SQL["part_write"] = r"""
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
"""

SQL["uniq_hosts"] = r"""
SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages
"""

SQL["primary_host"] = r"""
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS "primary" FROM orders GROUP BY 1
"""


STANZA_HDR = r"^Host\s+(\S+)"
STANZA_ATTR = r"^\s+(\S+)\s+(.*?)\s*$"
SQL["stanza_parse"] = rf"""
WITH tl AS (
  SELECT conv_id AS source, turn, ['Host turn' || turn, '    Role ' || role, '    Chars ' || length(text) || '  ',
                                   '    # generated', ''] AS body FROM conversations),
ex AS (SELECT source, turn, unnest(range(len(body))) AS pos, unnest(body) AS line FROM tl),
rows AS (SELECT source, turn * 10 + pos AS line_no, line FROM ex
         UNION ALL SELECT conv_id, -1, '    Preamble outside any block' FROM conversations WHERE turn = 0),
c AS (SELECT *, CASE WHEN regexp_matches(line, '{STANZA_HDR}') THEN regexp_extract(line, '{STANZA_HDR}', 1) END AS h,
             last_value(CASE WHEN regexp_matches(line, '{STANZA_HDR}')
                             THEN regexp_extract(line, '{STANZA_HDR}', 1) END IGNORE NULLS)
               OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block
      FROM rows)
SELECT source, block, regexp_extract(line, '{STANZA_ATTR}', 1) AS attr,
       regexp_extract(line, '{STANZA_ATTR}', 2) AS value
FROM c WHERE h IS NULL AND block IS NOT NULL AND regexp_matches(line, '{STANZA_ATTR}')
         AND NOT starts_with(trim(line), '#')
"""

SQL["alias_lookup"] =rf"""
WITH a(spelling, canon) AS (VALUES {ALIASES}),
svc AS (SELECT ['scm','om','datanode','recon','s3gateway','httpfs'][(s_nationkey % 6) + 1] AS service,
               s_suppkey, s_name FROM supplier),
pl AS (SELECT service, string_agg(s_name, ',' ORDER BY s_suppkey, s_name) AS hosts FROM svc GROUP BY service),
req AS (SELECT count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 'SCM' WHEN '2-HIGH' THEN 'DataNode'
          WHEN '3-MEDIUM' THEN 'datanode' WHEN '4-NOT SPECIFIED' THEN 'Datanode' ELSE 'om' END AS name
        FROM orders GROUP BY 2)
SELECT r.name, r.n, coalesce(pl.hosts, '') AS hosts
FROM req r LEFT JOIN a ON a.spelling = r.name LEFT JOIN pl ON pl.service = a.canon
"""

SQL["default_fill"] = r"""
SELECT d.doc_id,
  coalesce(nullif(CAST(l.quality AS VARCHAR), ''),
           trim(regexp_replace(regexp_replace(split_part(concat_ws(',', d.lang, d.source), ',', 1),
                                              '["'']', '', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS quality_hosts,
  coalesce(nullif(CAST(l.toxic AS VARCHAR), ''), concat_ws(',', d.lang, d.source)) AS toxic_hosts
FROM documents d LEFT JOIN labels l USING (doc_id)
"""

SQL["list_flatten"] = r"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
"""

SQL["norm_text"] = r"""
SELECT item_id, trim(regexp_replace(regexp_replace(text, '["'']', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS norm
FROM benchmark
"""

SQL["flag_parse"] = r"""
SELECT o_orderkey, flag_text, coalesce(lower(flag_text) = 'true', false) AS flag
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'FALSE' END AS flag_text FROM orders)
"""

SQL["allow_list"] = r"""
SELECT p_partkey, p_size, CASE WHEN p_size IN (8, 11, 17, 21) THEN p_size ELSE 8 END AS jdk FROM part
"""

SQL["eligible_reason"] = r"""
WITH h AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'Darwin' ELSE 'Linux' END AS os_type,
                  CASE WHEN l_linestatus = 'F' THEN 'ppc64le' WHEN l_returnflag = 'R' THEN 'aarch64'
                       ELSE 'x86_64' END AS cpu_arch FROM lineitem),
r AS (SELECT os_type, cpu_arch,
             CASE WHEN coalesce(os_type <> 'Linux', true) THEN 'not Linux'
                  WHEN NOT coalesce(cpu_arch IN ('x86_64', 'aarch64', 'arm64'), false)
                  THEN 'unsupported CPU architecture' END AS reason FROM h)
SELECT os_type, cpu_arch, reason IS NULL AS eligible, reason, count(*) AS n FROM r
GROUP BY os_type, cpu_arch, reason
"""

SQL["code_map"] = r"""
WITH x AS (SELECT c.c_custkey, n.n_name, ['x86_64','aarch64','arm64','ppc64le'][(c.c_nationkey % 4) + 1] AS arch
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT c_custkey, n_name, arch,
       CASE arch WHEN 'x86_64' THEN 'amd64' WHEN 'aarch64' THEN 'arm64' WHEN 'arm64' THEN 'arm64' END AS code
FROM x
"""

SQL["template_fill"] = r"""
SELECT p_partkey,
       replace('https://archive.apache.org/dist/ozone/${OZONE_VERSION}/ozone-${OZONE_VERSION}.tar.gz',
               '${OZONE_VERSION}', p_size || '.0.' || p_partkey) AS url
FROM part
"""

SQL["rule_eval"] = r"""
WITH w AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority,
                  CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) AS price_band,
                  nullif(o_orderstatus, 'P') AS open_flag FROM orders),
l AS (SELECT o_orderkey, 'status' AS setting, status AS raw_value FROM w
      UNION ALL SELECT o_orderkey, 'priority', priority FROM w
      UNION ALL SELECT o_orderkey, 'price_band', price_band FROM w
      UNION ALL SELECT o_orderkey, 'open_flag', open_flag FROM w)
SELECT o_orderkey, setting, raw_value,
  CASE WHEN raw_value IS NULL THEN 'n/a'
       WHEN (setting = 'status' AND raw_value = 'F')
         OR (setting = 'priority' AND contains(raw_value, 'URGENT'))
         OR (setting = 'price_band' AND raw_value IN ('0', '1', '2'))
         OR (setting = 'open_flag' AND starts_with(raw_value, 'O')) THEN 'ok'
       ELSE 'violation' END AS status
FROM l
"""

SQL["missing_keys"] = r"""
SELECT d.doc_id AS source, k.key
FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN (VALUES ('quality'), ('toxic')) k(key)
WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id
    AND length(CASE k.key WHEN 'quality' THEN CAST(l.quality AS VARCHAR) ELSE CAST(l.toxic AS VARCHAR) END) > 0)
"""

SQL["status_class"] = r"""
WITH r AS (SELECT event_type, CASE event_type WHEN 'purchase' THEN 'Safe mode is OFF' WHEN 'error' THEN 'FAILED'
             WHEN 'signup' THEN 'SCM exited safe mode' WHEN 'click' THEN 'cluster is out of safe mode'
             ELSE 'failed' END AS raw FROM events)
SELECT event_type,
  CASE WHEN contains(raw, 'OFF') OR contains(raw, 'exited') OR contains(raw, 'out of safe mode') THEN 'EXITED'
       WHEN raw = 'FAILED' THEN 'UNKNOWN' ELSE 'WAITING' END AS status, count(*) AS n
FROM r GROUP BY ALL
"""

SQL["url_build"] = rf"""
WITH p AS (SELECT n.n_nationkey, CASE r.r_name WHEN 'AFRICA' THEN 'om' WHEN 'AMERICA' THEN 'SCM'
             WHEN 'ASIA' THEN 'DataNode' WHEN 'EUROPE' THEN 'recon' ELSE 'Prometheus' END AS service,
             lower(n.n_name) AS host FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
a(spelling, canon) AS (VALUES {ALIASES}),
ports(canon, port) AS (VALUES ('om', 9874), ('scm', 9876), ('datanode', 9882), ('recon', 9888),
                              ('s3gateway', 9878), ('httpfs', 14000))
SELECT p.n_nationkey, p.service, 'http://' || p.host || ':' || ports.port AS url
FROM p JOIN a ON a.spelling = p.service JOIN ports ON ports.canon = a.canon
"""

SQL["size_verify"] = r"""
SELECT doc_id, n_chars, CAST(strlen(text) AS BIGINT) AS bytes,
       coalesce(strlen(text) = n_chars AND strlen(text) > 0, false) AS ok FROM documents
"""

SQL["cross_expand"] = "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region"

SQL["cross3"] = r"""
SELECT n_nationkey, r_regionkey, f.l_returnflag
FROM nation CROSS JOIN region CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) f
"""

SQL["presence_matrix"] = r"""
WITH s(service, pattern) AS (VALUES ('signup','signup'), ('purchase','purchase'), ('error','error'),
                                    ('view','view'), ('click','click')),
m AS (SELECT e.user_id AS host, s.service, e.event_id AS pid,
             row_number() OVER (PARTITION BY e.user_id, s.service ORDER BY e.ts, e.event_id) AS rn
      FROM events e JOIN s ON contains(e.event_type, s.pattern))
SELECT c.c_custkey AS host, s.service,
       CASE WHEN m.pid IS NULL THEN 'not running' ELSE 'running' END AS status, m.pid
FROM (SELECT DISTINCT c_custkey FROM customer) c CROSS JOIN s
LEFT JOIN m ON m.host = c.c_custkey AND m.service = s.service AND m.rn = 1
"""

SQL["semi_labels"] = r"""
SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""

SQL["anti_labels"] = r"""
SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""

SQL["dim_lookup"] = r"""
SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

SQL["drift"] = r"""
WITH e0 AS (SELECT CASE WHEN p_size <= 40 THEN '' ELSE 'e' END || p_partkey AS name, p_brand AS value FROM part),
a0 AS (SELECT CASE WHEN p_size >= 10 THEN CAST(p_partkey AS VARCHAR) ELSE 'small' END AS name,
              CASE WHEN p_retailprice > 950 THEN p_type ELSE p_brand END AS value FROM part),
e AS (SELECT name, string_agg(DISTINCT value, ',' ORDER BY value) AS value FROM e0 GROUP BY name),
a AS (SELECT name, string_agg(DISTINCT value, ',' ORDER BY value) AS value FROM a0 GROUP BY name)
SELECT coalesce(e.name, a.name) AS name, e.value AS expected_value, a.value AS actual_value,
  CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected'
       WHEN e.value IS NOT DISTINCT FROM a.value THEN 'match' ELSE 'changed' END AS state
FROM e FULL OUTER JOIN a ON e.name = a.name
"""

SQL["contains_join"] = r"""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
"""

SQL["manifest_verify"] = r"""
SELECT d.source AS host, d.doc_id AS file, m.n_chars AS expected_size,
       CAST(strlen(d.text) AS BIGINT) AS actual_size,
       coalesce(strlen(d.text) = m.n_chars AND strlen(d.text) > 0, false) AS ok
FROM documents d LEFT JOIN documents m ON m.doc_id = d.doc_id
"""

SQL["pick_alt"] = r"""
WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders),
r AS (SELECT o_custkey, o_orderpriority,
             CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2
                  WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS rk FROM a)
SELECT o_custkey, arg_min(o_orderpriority, rk) AS chosen FROM r WHERE rk IS NOT NULL GROUP BY o_custkey
"""

SQL["ha_flag"] = r"""
SELECT l_orderkey, count(l_suppkey) AS n_hosts, count(l_suppkey) > 1 AS is_ha FROM lineitem GROUP BY l_orderkey
"""

SQL["ordered_list"] = r"""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_list
FROM orders GROUP BY o_custkey
"""

SQL["run_summary"] = r"""
WITH s AS (SELECT user_id, 'h' || nullif(regexp_extract(props, '([0-9]+)', 1), '') AS host,
                  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events),
g AS (SELECT user_id, count(*) FILTER (WHERE status = 'SUCCESS') AS n_ok, count(*) AS n_total,
             coalesce(string_agg(DISTINCT host, ',' ORDER BY host) FILTER (WHERE status <> 'SUCCESS'), '')
               AS failed_hosts FROM s GROUP BY user_id)
SELECT *, CASE WHEN n_ok = n_total THEN 'SUCCESS' WHEN n_ok = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS overall
FROM g
"""

SQL["any_issue"] = r"""
SELECT l_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS any_issue FROM lineitem GROUP BY l_orderkey
"""

SQL["kind_counts"] = r"""
WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
SELECT regexp_extract(host, '\.([A-Za-z0-9-]+)$', 1) AS tld, count(*) AS n, count(DISTINCT host) AS n_distinct
FROM h GROUP BY 1
"""

SQL["rollup_flags"] = r"""
SELECT l_returnflag, count(*) AS n_run,
       count(*) FILTER (WHERE l_linestatus = 'F') AS n_passed,
       count(*) FILTER (WHERE l_linestatus IS DISTINCT FROM 'F') AS n_failed,
       GROUPING(l_returnflag) = 1 AS is_total
FROM lineitem GROUP BY ROLLUP (l_returnflag)
"""

SQL["first_by"] = r"""
SELECT user_id, event_id AS first_event_id, event_type AS first_event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
"""

SQL["collect_sorted"] = r"""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS pids, count(o_orderkey) AS n
FROM orders GROUP BY o_custkey
"""

SQL["pivot_long"] = r"""
SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "A",
       max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS "N",
       max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "R"
FROM lineitem GROUP BY l_orderkey
"""

SQL["branch_union"] = r"""
WITH p AS (SELECT l_orderkey AS cluster, l_linenumber AS pos, 's' || l_suppkey AS host FROM lineitem),
g AS (SELECT cluster, count(host) AS n, string_agg(host, ',' ORDER BY pos, host) AS hosts FROM p GROUP BY cluster)
SELECT cluster, 'ozone.scm.service.ids' AS name, 'cluster' || cluster AS value FROM g WHERE n > 1
UNION ALL SELECT cluster, 'ozone.scm.nodes.cluster' || cluster, hosts FROM g WHERE n > 1
UNION ALL SELECT p.cluster, 'ozone.scm.address.cluster' || p.cluster || '.' || p.host, p.host
          FROM p JOIN g ON p.cluster = g.cluster WHERE g.n > 1
UNION ALL SELECT cluster, 'ozone.scm.names', hosts FROM g WHERE n <= 1
UNION ALL SELECT cluster, 'ozone.scm.client.address', hosts || ':9860' FROM g WHERE n <= 1
"""

SQL["elect_first"] = r"""
SELECT o_custkey, o_orderkey,
       CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN '--init' ELSE '--bootstrap' END
         AS command
FROM orders
"""

SQL["retry_outcome"] = r"""
WITH r AS (SELECT user_id, event_id, event_type,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS total FROM events),
f AS (SELECT user_id, min(rn) FILTER (WHERE event_type = 'purchase') AS at, max(total) AS total
      FROM r GROUP BY user_id)
SELECT f.user_id, CASE WHEN f.at <= 3 THEN 'EXITED' ELSE 'TIMEOUT' END AS outcome,
       CAST(CASE WHEN f.at <= 3 THEN f.at ELSE least(f.total, 3) END AS BIGINT) AS attempts,
       CAST(f.total AS BIGINT) AS polls, r.event_id AS exit_event_id
FROM f LEFT JOIN r ON r.user_id = f.user_id AND r.rn = f.at AND f.at <= 3
"""

SQL["context_after"] = r"""
WITH r AS (SELECT user_id, event_id, event_type,
                  max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
                    PARTITION BY user_id ORDER BY ts, event_id
                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM events)
SELECT user_id, event_id FROM r WHERE hit = 1 AND event_type = 'purchase'
"""

SQL["range_drop"] = r"""
WITH m AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN 'S'
                                              WHEN event_type = 'purchase' THEN 'E' END AS mk FROM events),
p AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m)
SELECT user_id, event_id FROM p WHERE NOT (coalesce(mk = 'S', false) OR coalesce(prev = 'S', false))
"""

SQL["block_carry"] = r"""
SELECT conv_id, turn, role,
       last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
         PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn
FROM conversations
"""

SQL["inflight_peak"] = r"""
WITH every AS (SELECT c.c_nationkey AS k, o.o_orderdate AS s, l.l_shipdate AS e
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                            JOIN customer c ON o.o_custkey = c.c_custkey),
iv AS (SELECT * FROM every WHERE e >= s),
bad AS (SELECT k, count(*) AS n_invalid FROM every WHERE NOT coalesce(e >= s, false) GROUP BY k),
ev AS (SELECT k, s AS t, 1 AS d FROM iv UNION ALL SELECT k, e AS t, -1 AS d FROM iv),
lv AS (SELECT k, t, d, sum(d) OVER (PARTITION BY k ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS lvl FROM ev)
SELECT k AS c_nationkey, count(*) FILTER (WHERE d = 1) AS n_intervals, CAST(max(lvl) AS BIGINT) AS peak,
       coalesce((SELECT n_invalid FROM bad WHERE bad.k = lv.k), 0) AS n_invalid,
       CAST(coalesce(sum(CASE WHEN d = -1 AND lvl = 10 THEN epoch(t) WHEN d = 1 AND lvl = 11 THEN -epoch(t) END), 0)
            AS BIGINT) AS seconds_above_cap
FROM lv GROUP BY k
"""

SQL["top_n"] = r"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
"""

SQL["rank_order"] = r"""
WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2
             WHEN '5-LOW' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END AS rk FROM orders)
SELECT o_custkey, o_orderkey,
       row_number() OVER (PARTITION BY o_custkey ORDER BY rk, o_orderkey) AS seq,
       count(*) OVER (PARTITION BY o_custkey)
         - row_number() OVER (PARTITION BY o_custkey ORDER BY rk, o_orderkey) + 1 AS stop_seq
FROM r
"""

SQL["union_keys"] = r"""
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier
"""

SQL["except_keys"] = "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"

SQL["intersect_keys"] = "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels"

SQL["cube_flags"] = r"""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
       CAST(GROUPING(l_returnflag, l_linestatus) AS INTEGER) AS grouping_id
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
"""

__all__ = ["SQL"]
