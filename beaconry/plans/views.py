"""Signals and control tables derived from the supplied tables.

Each view is one SELECT. The text is shared by Spark and by the SQL that checks the results; the
few functions the two dialects spell differently come from `Dialect`. Views may read other views.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from beaconry.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Dialect:
    """Functions the two dialects spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def ms(self, ts):
        return f"unix_millis({ts})" if self.spark else f"epoch_ms({ts})"

    def at(self, seconds):
        """A timestamp from whole epoch seconds."""
        return f"timestamp_seconds({seconds})" if self.spark else f"make_timestamp(({seconds}) * 1000000)"

    def stamp(self, ts):
        """A timestamp truncated to milliseconds."""
        return f"timestamp_millis({self.ms(f'cast({ts} as timestamp)')})" if self.spark else f"date_trunc('milliseconds', {ts})"

    def map(self, *pairs):
        flat = [(f"'{k}'", v) for k, v in pairs]
        if self.spark:
            return "map(" + ", ".join(f"{k}, {v}" for k, v in flat) + ")"
        return "MAP {" + ", ".join(f"{k}: {v}" for k, v in flat) + "}"

    def hex(self, n, width):
        return f"lpad(lower(hex({n})), {width}, '0')"

    def fmt(self, ts, pattern):
        """Format a timestamp; patterns are named so that both dialects agree."""
        spark = {"rfc3164": "MMM dd HH:mm:ss", "rfc3339": "yyyy-MM-dd'T'HH:mm:ss'Z'"}
        duck = {"rfc3164": "%b %d %H:%M:%S", "rfc3339": "%Y-%m-%dT%H:%M:%SZ"}
        if self.spark:
            quoted = spark[pattern].replace("'", "\\'")
            return f"date_format({ts}, '{quoted}')"
        return f"strftime({ts}, '{duck[pattern]}')"


def _views(d: Dialect) -> dict[str, str]:
    day0 = 1704067200  # 2024-01-01
    return {
        # --- signals ---
        "metrics": f"""
            SELECT 't' || (user_id % 5) AS tenant_id, 'c' || user_id AS resource_id,
                   'site' || (user_id % 7) AS site_id, {d.stamp('ts')} AS observed_at,
                   {d.stamp('ts')} + (event_id % 7) * INTERVAL '1' MINUTE AS ingested_at,
                   event_type AS metric, value, 'unit' AS unit,
                   {d.map(('k', "regexp_extract(props, '([0-9]+)', 1)"))} AS labels, event_id
            FROM events""",
        # A series per (resource, metric): the label is constant so that counters have a history.
        "counters": f"""
            SELECT 't' || (user_id % 5) AS tenant_id, 'c' || user_id AS resource_id,
                   'site' || (user_id % 7) AS site_id, {d.stamp('ts')} AS observed_at,
                   {d.stamp('ts')} AS ingested_at, event_type AS metric, value, 'bytes' AS unit,
                   {d.map(('interface', "'eth' || (user_id % 2)"))} AS labels, event_id
            FROM events""",
        "logs": f"""
            SELECT 't' || (doc_id % 5) AS tenant_id, 'c' || (doc_id % 150) AS resource_id,
                   'site' || (doc_id % 7) AS site_id, {d.at(f'{day0} + doc_id * 60')} AS observed_at,
                   {d.at(f'{day0} + doc_id * 60 + (doc_id % 11) * 600')} AS ingested_at,
                   'syslog' AS source_kind,
                   CASE WHEN doc_id % 3 = 0 THEN 'acme' WHEN doc_id % 3 = 1 THEN 'globex' ELSE '' END AS source_vendor,
                   CASE doc_id % 9 WHEN 0 THEN 'trace' WHEN 1 THEN 'debug' WHEN 2 THEN 'info'
                        WHEN 3 THEN 'notice' WHEN 4 THEN 'warn' WHEN 5 THEN 'error'
                        WHEN 6 THEN 'critical' WHEN 7 THEN 'alert' ELSE 'emergency' END AS severity,
                   cast(doc_id % 24 as int) AS facility, text AS body,
                   CASE WHEN doc_id % 4 = 0 THEN {d.map(('region', "lang"))}
                        ELSE {d.map(('region', "lang"), ('rack', "'rack' || (doc_id % 13)"))} END AS attributes,
                   source AS host_name, lang AS service_name,
                   CASE WHEN doc_id % 3 = 0 THEN {d.hex('doc_id', 32)} ELSE '' END AS trace_id,
                   CASE WHEN doc_id % 3 = 0 THEN {d.hex('doc_id * 64 + 1', 16)} ELSE '' END AS span_id,
                   doc_id
            FROM documents""",
        "platform_events": f"""
            SELECT 't' || (user_id % 5) AS tenant_id, 'c' || user_id AS resource_id,
                   'site' || (user_id % 7) AS site_id, {d.stamp('ts')} AS observed_at,
                   {d.stamp('ts')} AS ingested_at, 'syslog' AS source_kind, 'acme' AS source_vendor,
                   CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'info' ELSE 'notice' END AS severity,
                   CASE event_id % 4 WHEN 0 THEN 'authentication' WHEN 1 THEN 'network' WHEN 2 THEN 'dns' ELSE 'vpn' END AS event_category,
                   CASE event_id % 4 WHEN 0 THEN CASE WHEN value > 20 THEN 'failure' ELSE 'success' END
                        WHEN 1 THEN CASE WHEN value > 10 THEN 'denied' ELSE 'allowed' END
                        WHEN 2 THEN 'query' ELSE 'start' END AS event_type,
                   'event ' || event_id AS summary,
                   CASE event_id % 4
                        WHEN 2 THEN {d.map(('dns.question.name', "'host' || (event_id % 31) || '.example'"), ('dns.response_code', "CASE WHEN event_id % 3 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END"))}
                        ELSE {d.map(('source.ip', "'10.2.' || (user_id % 250) || '.' || (event_id % 97)"), ('user.name', "'user' || (user_id % 40)"))} END AS attributes,
                   event_id
            FROM events""",
        "states": f"""
            SELECT 't' || (o_custkey % 5) AS tenant_id, 'c' || o_custkey AS resource_id,
                   'site' || (o_custkey % 7) AS site_id, cast(o_orderdate as timestamp) AS observed_at,
                   cast(o_orderdate as timestamp) AS ingested_at, 'info' AS severity,
                   '' AS previous_status,
                   CASE o_orderstatus WHEN 'F' THEN 'up' WHEN 'O' THEN 'down' ELSE 'degraded' END AS current_status,
                   o_orderpriority AS reason, {d.map(('order', "cast(o_orderkey as string)"))} AS attributes,
                   o_orderkey
            FROM orders""",
        "flows": f"""
            SELECT 't' || (l_suppkey % 5) AS tenant_id, 's' || l_suppkey AS resource_id,
                   'site' || (l_suppkey % 7) AS site_id,
                   cast(l_shipdate as timestamp) + (l_orderkey % 86400) * INTERVAL '1' SECOND AS observed_at,
                   cast(l_shipdate as timestamp) + (l_orderkey % 86400 + 60) * INTERVAL '1' SECOND AS ingested_at,
                   cast(l_shipdate as timestamp) + (l_orderkey % 86400) * INTERVAL '1' SECOND AS started_at,
                   '10.0.' || ((l_suppkey // 250) % 250) || '.' || (l_suppkey % 250) AS src_address,
                   '10.' || (1 + (l_partkey // 62500)) || '.' || ((l_partkey // 250) % 250) || '.' || (l_partkey % 250) AS dst_address,
                   cast(1024 + l_orderkey % 50000 as int) AS src_port,
                   cast(CASE l_linenumber WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 ELSE 8000 + l_linenumber END as int) AS dst_port,
                   cast(CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 89 + l_linenumber - 2 END as int) AS protocol,
                   cast(round(l_extendedprice * 100) as bigint) AS bytes,
                   cast(round(l_quantity) as bigint) AS packets,
                   cast(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 64 ELSE 512 END as bigint) AS sampling_rate,
                   cast(0 as int) AS tcp_flags, cast(0 as int) AS tos,
                   CASE WHEN l_linenumber % 2 = 0 THEN cast(l_linenumber as bigint) END AS input_if,
                   cast(NULL as bigint) AS output_if, cast(NULL as bigint) AS src_as, cast(NULL as bigint) AS dst_as,
                   's' || l_suppkey AS src_resource_id, '' AS dst_resource_id,
                   {d.map(('line', "cast(l_linenumber as string)"))} AS attributes,
                   l_orderkey, l_linenumber, l_partkey, l_suppkey
            FROM lineitem""",
        "numbered_lines": """
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_shipdate, l_quantity,
                   row_number() OVER (PARTITION BY l_orderkey
                       ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_returnflag) AS rn
            FROM lineitem""",
        "spans": f"""
            SELECT 't' || (l_orderkey % 5) AS tenant_id, 's' || l_suppkey AS resource_id,
                   'site' || (l_suppkey % 7) AS site_id,
                   {d.at(f'{day0} + (l_orderkey % 86400) * 30 + rn')} AS observed_at,
                   {d.at(f'{day0} + (l_orderkey % 86400) * 30 + rn + 5')} AS ingested_at,
                   'svc' || (l_suppkey % 40) AS service_id, {d.hex('l_orderkey', 32)} AS trace_id,
                   {d.hex('l_orderkey * 64 + rn', 16)} AS span_id,
                   CASE WHEN rn = 1 THEN ''
                        WHEN rn % 5 = 0 THEN {d.hex('l_orderkey * 64 + 63', 16)}
                        WHEN rn = 4 THEN {d.hex('l_orderkey * 64 + 2', 16)}
                        ELSE {d.hex('l_orderkey * 64 + rn - 1', 16)} END AS parent_span_id,
                   'op' || (l_partkey % 20) AS name,
                   CASE WHEN rn = 1 THEN 'server' ELSE 'client' END AS kind,
                   cast(round(l_extendedprice * 100) as bigint) * 1000 AS duration_ns,
                   CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'N' THEN 'ok' ELSE 'unset' END AS status_code,
                   '' AS status_message, cast(0 as float) AS sampling_probability, 'lib' AS scope_name,
                   {d.map(('part', "cast(l_partkey as string)"))} AS attributes, l_orderkey, rn
            FROM numbered_lines""",
        # --- raw input ---
        # The parts of a line, and which of ten shapes it is written in.
        "syslog_parts": f"""
            SELECT event_id, 't' || (user_id % 5) AS tenant_id, {d.stamp('ts')} AS received_at,
                   date_trunc('second', ts) - INTERVAL '2' DAY AS stamp, '192.0.2.' || (user_id % 250) AS peer,
                   event_id % 10 AS shape, cast((event_id * 37) % 192 as int) AS pri, 'Host-' || user_id AS host, 'app_' || event_type AS app,
                   cast(event_id % 9999 as string) AS pid, 'ID' || (event_id % 47) AS msgid,
                   'user' || (user_id % 40) || ' said k=v in [brackets]' AS msg
            FROM events""",
        "syslog_lines": f"""
            SELECT event_id, tenant_id, received_at, peer || ':514' AS peer,
                   CASE shape
                     WHEN 0 THEN '<' || pri || '>' || {d.fmt('stamp', 'rfc3164')} || ' ' || host || ' ' || app || '[' || pid || ']: ' || msg
                     WHEN 1 THEN '<' || pri || '>' || {d.fmt('stamp', 'rfc3164')} || ' ' || host || ' ' || app || ': ' || msg
                     WHEN 2 THEN '<' || pri || '>' || {d.fmt('stamp', 'rfc3164')} || ' ' || host || ' ' || msg
                     WHEN 3 THEN '<' || pri || '>1 ' || {d.fmt('stamp', 'rfc3339')} || ' ' || host || ' ' || app || ' ' || pid || ' ' || msgid
                                 || ' [ex@32473 user="' || msgid || '" path="a]b"][b@1 n="' || pid || '"] ' || msg
                     WHEN 4 THEN '<' || pri || '>1 ' || {d.fmt('stamp', 'rfc3339')} || ' ' || host || ' ' || app || ' - - - ' || msg
                     WHEN 5 THEN '<' || pri || '>1 - - - - - - ' || msg
                     WHEN 6 THEN msg
                     WHEN 7 THEN '<0' || pri || '>' || msg
                     WHEN 8 THEN '<' || pri || '>yesterday at noon ' || msg
                     ELSE '<' || pri || '>1 ' || {d.fmt('stamp', 'rfc3339')} || ' ' || host END AS line
            FROM syslog_parts""",
        # Messages in three grammars; the fourth is prose and must yield nothing.
        "security_parts": f"""
            SELECT event_id, 't' || (user_id % 5) AS tenant_id, 'c' || user_id AS resource_id, {d.stamp('ts')} AS observed_at,
                   event_id % 4 AS shape, event_id % 5 AS topic,
                   '10.0.' || (user_id % 250) || '.' || (event_id % 250) AS src, '203.0.113.' || (event_id % 250) AS dst,
                   cast(1 + event_id % 1024 as string) AS port, 'user' || (user_id % 40) AS who,
                   CASE WHEN value > 20 THEN 'Deny' ELSE 'accept' END AS act, CASE WHEN value > 20 THEN 'failure' ELSE 'SUCCESS' END AS res
            FROM events""",
        # Topics: 0 firewall, 1 sign-in, 2 resolver, 3 tunnel, 4 pairs that mean nothing here.
        "security_lines": """
            SELECT event_id, tenant_id, resource_id, observed_at, CASE WHEN topic = 3 THEN 'sslvpn' ELSE 'app' END AS service_name, 'info' AS severity,
                   CASE shape
                     WHEN 0 THEN CASE topic
                       WHEN 0 THEN 'fw src=' || src || ' dst=' || dst || ' dpt=' || port || ' act=' || act || ' msg="two words" src=9.9.9.9'
                       WHEN 1 THEN 'user=' || who || ' result=' || res || ' src-ip=' || src
                       WHEN 2 THEN 'query=' || who || '.example rcode=NOERROR qtype=A'
                       WHEN 3 THEN 'user=' || who || ' action=connect status=ok'
                       ELSE 'a=1 b=2 c=' || port END
                     WHEN 1 THEN 'CEF:0|Acme|FW|1.0|100|' || CASE topic WHEN 4 THEN '' ELSE 'Rule ' || chr(92) || '| ' || topic END || '|5|' || CASE topic
                       WHEN 0 THEN 'src=' || src || ' dst=' || dst || ' act=' || act
                       WHEN 1 THEN 'suser=' || who || ' outcome=' || res
                       WHEN 2 THEN 'query=' || who || '.example'
                       WHEN 3 THEN 'suser=' || who || ' act=logout'
                       ELSE 'src=' || src || ' dst=' || dst || ' dpt=' || port || ' act=' || act END
                     WHEN 2 THEN CASE topic
                       WHEN 0 THEN '{"src":"' || src || '","dst":"' || dst || '","disposition":"' || act || '","deep":{"a":[1,2]}}'
                       WHEN 1 THEN '{"username":"' || who || '","result":"' || res || '","n":' || port || '}'
                       WHEN 2 THEN '{"qname":"' || who || '.example","rcode":"NXDOMAIN","ok":true}'
                       WHEN 3 THEN '{"usr":"' || who || '","action":"start","x":null}'
                       ELSE '{"src":"' || src || '","user":"' || who || '"}' END
                     ELSE 'Started service=sshd for ' || who || ' on ' || src END AS body
            FROM security_parts""",
        "decoded_flows": f"""
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 't' || (l_suppkey % 5) AS tenant_id, 's' || l_suppkey AS resource_id,
                   cast(l_shipdate as timestamp) + (l_orderkey % 86400) * INTERVAL '1' SECOND AS exported_at,
                   cast((l_orderkey * 1000003) % 4294967296 as bigint) AS header_uptime,
                   cast(((l_orderkey * 1000003) % 4294967296 + 4294967296 - l_partkey * 100 - 5000) % 4294967296 as bigint) AS first_uptime,
                   cast(((l_orderkey * 1000003) % 4294967296 + 4294967296 - l_partkey * 100) % 4294967296 as bigint) AS last_uptime,
                   CASE WHEN l_linenumber % 2 = 0 THEN '::FFFF:10.0.0.' || (l_suppkey % 250) ELSE '10.0.0.' || (l_suppkey % 250) END AS src_address,
                   CASE WHEN l_linenumber % 3 = 0 THEN '2001:DB8::' || (l_partkey % 99) ELSE '10.1.0.' || (l_partkey % 250) END AS dst_address,
                   cast(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 64 END as bigint) AS sampling_rate
            FROM lineitem""",
        # Readings of four scalars and two interface columns of every device.
        "readings": f"""
            SELECT 't' || (user_id % 5) AS tenant_id, 'c' || user_id AS resource_id, {d.stamp('ts')} AS observed_at, value, event_id,
                   CASE event_type WHEN 'error' THEN '1.3.6.1.2.1.1.3.0' WHEN 'click' THEN '1.3.6.1.2.1.2.2.1.10.' || (event_id % 4)
                     WHEN 'view' THEN '1.3.6.1.2.1.2.2.1.16.' || (event_id % 4) || '.7' WHEN 'purchase' THEN '1.3.6.1.4.9' ELSE '1.3.6.1.2.1.99.' || (event_id % 3) END AS oid
            FROM events""",
        "macs": """
            SELECT o_orderkey, 't' || (o_custkey % 5) AS tenant_id, 'c' || o_custkey AS resource_id,
                   CASE o_orderkey % 6
                     WHEN 0 THEN '00:1B:' || lpad(lower(hex(o_custkey % 256)), 2, '0') || ':' || lpad(lower(hex(o_orderkey % 256)), 2, '0') || ':01:02'
                     WHEN 1 THEN '70b3.d5' || lpad(lower(hex(o_custkey % 256)), 2, '0') || '.' || lpad(lower(hex(o_orderkey % 65536)), 4, '0')
                     WHEN 2 THEN '02-00-5e-00-00-' || lpad(lower(hex(o_orderkey % 256)), 2, '0')
                     WHEN 3 THEN '0050c2' || lpad(lower(hex(o_orderkey % 16777216)), 6, '0')
                     WHEN 4 THEN 'not a mac' ELSE '00:1b:00:00:00:0' END AS mac
            FROM orders""",
        # A registry made from the supplier list: blocks of 24, 28 and 36 bits.
        "mac_registry": """
            SELECT lpad(lower(hex(6912 + s_suppkey)), 6, '0') AS prefix, s_name AS organisation FROM supplier
            UNION ALL SELECT '70b3d5', 'Small blocks' FROM region WHERE r_regionkey = 0
            UNION ALL SELECT lpad(lower(hex(118177104 + s_suppkey)), 7, '0'), 'Medium ' || s_suppkey FROM supplier
            UNION ALL SELECT lpad(lower(hex(84680704 + s_suppkey)), 9, '0'), 'Narrow ' || s_suppkey FROM supplier""",
        # Neighbour tables of every supplier: three protocols, half the rows incomplete.
        "neighbours": """
            SELECT tenant_id, seen_from, place, CASE place % 3 WHEN 0 THEN 'lldp' WHEN 1 THEN 'cdp' ELSE 'arp' END AS protocol,
                   CASE WHEN place % 3 < 2 THEN CASE (place // 3) % 4 WHEN 0 THEN 'CH' || x WHEN 1 THEN 'ch' || x END END AS chassis_id,
                   CASE WHEN place % 3 < 2 AND (place // 12) % 3 <> 0 THEN CASE WHEN (place // 3) % 2 = 0 THEN 'supplier#' ELSE 'Supplier#' END || lpad(cast(x as string), 9, '0') END AS sys_name,
                   CASE WHEN place % 3 = 2 OR (place // 5) % 2 = 0 THEN '10.20.' || (place % 200) || '.' || (x % 250) END AS address,
                   CASE WHEN (place // 7) % 2 = 0 THEN 'model ' || (place % 9) END AS platform
            FROM (SELECT 't' || (o_custkey % 5) AS tenant_id, 's' || (o_custkey % (SELECT count(*) FROM supplier)) AS seen_from, o_orderkey AS place,
                    (o_custkey + 5 * (o_orderkey % 7)) % (SELECT count(*) FROM supplier) AS x FROM orders) AS placed""",
        # Candidates as they were before the batch: those of the first half of the orders.
        "stored_candidates": f"""
            SELECT tenant_id, source || '|' || address || '|' AS fingerprint, max(sys_name) AS sys_name, max(mac) AS mac, max(source) AS source,
                   max(address) AS address, cast(NULL as string) AS chassis_id, min(state) AS state, min(reason) AS reason,
                   min(last_seen) AS first_seen, max(last_seen) AS last_seen
            FROM candidates WHERE state <> 'unidentified' GROUP BY tenant_id, source || '|' || address || '|'""",
        "interfaces": """
            SELECT DISTINCT 't' || (l_suppkey % 5) AS tenant_id, 's' || l_suppkey AS parent_id, 'interface' AS kind, 'eth' || l_linenumber AS name,
                   cast(l_linenumber as string) AS index, cast(l_linenumber as int) AS index_number,
                   CASE WHEN l_linenumber % 2 = 1 THEN '00:1b:' || lpad(lower(hex((l_suppkey * 3 + l_linenumber) % 256)), 2, '0') || ':00:00:01' ELSE '02:00:00:00:00:01' END AS mac
            FROM lineitem""",
        "polled": """
            SELECT 't' || (c_custkey % 5) AS tenant_id, 'c' || c_custkey AS resource_id, CASE WHEN c_custkey % 4 = 0 THEN 'polled' END AS vendor,
                   CASE WHEN c_custkey % 3 = 0 THEN 'M' || (c_custkey % 9) END AS model, cast(NULL as string) AS os, '1.' || (c_custkey % 5) AS os_version,
                   CASE WHEN c_custkey % 2 = 0 THEN 'SN' || c_custkey WHEN c_custkey % 7 = 0 THEN '' END AS serial FROM customer""",
        # A sweep a month: every order is an address probed.
        "sightings": """
            SELECT 't' || (o_custkey % 5) AS tenant_id, 'run' || (o_orderkey % 24) AS run_id, 'o' || o_orderkey AS observation_id,
                   CASE o_orderkey % 9 WHEN 0 THEN 'silent' WHEN 1 THEN 'refused' ELSE 'answered' END AS result,
                   CASE WHEN o_orderkey % 5 <> 0 THEN 'dev' || o_custkey END AS sys_name, CASE WHEN o_orderkey % 10 = 5 THEN '1.3.6' END AS sys_object_id
            FROM orders""",
        "sweeps": """
            SELECT 't' || (s_suppkey % 5) AS tenant_id, 'job' || s_suppkey AS job_id, '10.' || (s_suppkey % 200) || '.' || (s_suppkey % 7) || '.0/' || (26 + s_suppkey % 7) AS cidr FROM supplier
            UNION ALL SELECT 't' || (s_suppkey % 5), 'job' || s_suppkey, '10.' || (s_suppkey % 200) || '.' || (s_suppkey % 7) || '.16/28' FROM supplier
            UNION ALL SELECT 't' || (s_suppkey % 5), 'job' || s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN '10.0.0.0/15' WHEN 2 THEN 'nonsense' ELSE '10.9.0.0/16' END FROM supplier WHERE s_suppkey % 4 <> 0""",
        # Hops of a path to every order's address, three probes each, some lost.
        "path_rows": """
            SELECT 't' || (l_orderkey % 5) AS tenant_id, 'path' || l_orderkey AS target, cast(rn as int) AS number,
                   CASE WHEN rn % 7 = 6 THEN NULL WHEN rn <= 2 THEN '10.0.0.' || rn WHEN rn = 3 THEN '100.64.1.1' ELSE '203.0.113.' || rn END AS address,
                   CASE WHEN rn % 7 = 6 THEN NULL ELSE l_quantity END AS rtt_a, CASE WHEN (l_partkey + rn) % 3 = 0 OR rn % 7 = 6 THEN NULL ELSE l_quantity + 0.5 END AS rtt_b
            FROM numbered_lines""",
        "collectors": f"""
            SELECT 'col' || c_custkey AS collector_id, CASE WHEN c_custkey % 2 = 0 THEN 'syslog' ELSE 'otlp' END AS kind, c_name AS name,
                   c_custkey % 11 = 0 AS retired, CASE WHEN c_custkey % 7 <> 0 THEN {d.at(f'{day0} + c_custkey % 500')} END AS last_seen_at FROM customer""",
        "evidence": """
            SELECT o_orderkey, mac, CASE o_orderkey % 8 WHEN 0 THEN 'HP LaserJet printer' WHEN 1 THEN 'Linux box' WHEN 2 THEN 'Cisco Adaptive Security Appliance, IOS switch' END AS sys_descr,
                   CASE (o_orderkey // 8) % 5 WHEN 0 THEN 'CAM-' || o_orderkey WHEN 1 THEN 'core-SW-1' WHEN 2 THEN 'printer' WHEN 3 THEN 'bob' END AS hostname,
                   cast(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 300 END as int) AS ttl FROM macs""",
        "makers": """
            SELECT prefix, CASE WHEN prefix LIKE '001b0%' THEN 'Zebra Inc' WHEN prefix LIKE '0050c2%' THEN 'MikroTik' ELSE organisation END AS organisation FROM mac_registry""",
        # --- inventory ---
        "resources": f"""
            SELECT 'c' || c_custkey AS id, 't' || (c_custkey % 5) AS tenant_id,
                   'site' || (c_custkey % 7) AS site_id, 's' || (c_custkey % (SELECT count(*) FROM supplier)) AS parent_id,
                   'host' AS kind, c_name AS name,
                   CASE WHEN c_custkey % 3 = 0 THEN 'acme' WHEN c_custkey % 3 = 1 THEN 'globex' ELSE '' END AS vendor,
                   CASE WHEN c_custkey % 19 = 0 THEN 'maintenance' WHEN c_custkey % 29 = 0 THEN 'decommissioned'
                        WHEN c_custkey % 2 = 0 THEN 'up' ELSE 'down' END AS status,
                   {d.map(('segment', 'c_mktsegment'))} AS tags
            FROM customer
            UNION ALL
            SELECT 's' || s_suppkey, 't' || (s_suppkey % 5), 'site' || (s_suppkey % 7), 'n' || (s_suppkey % 25),
                   'device', s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'globex' ELSE '' END, CASE WHEN s_suppkey % 13 = 0 THEN 'decommissioned' ELSE 'up' END,
                   {d.map(('segment', "'CORE'"))}
            FROM supplier
            UNION ALL
            SELECT 'n' || n_nationkey, 't' || (n_nationkey % 5), 'site' || (n_nationkey % 7), 'g' || (n_nationkey % 5),
                   'site', n_name, '', 'up', {d.map(('segment', "'PLACE'"))}
            FROM nation
            UNION ALL
            SELECT 'g' || r_regionkey, 't' || (r_regionkey % 5), 'site0', '', 'site', r_name, '', 'up',
                   {d.map(('segment', "'PLACE'"))}
            FROM region""",
        # Suppliers of one tenant in runs of six cabled in a ring, so that walks meet a cycle.
        "edges": """
            SELECT 't' || (c_custkey % 5) AS tenant_id, 'c' || c_custkey AS source_id,
                   's' || (c_custkey % (SELECT count(*) FROM supplier)) AS target_id, 'depends_on' AS kind, 'poll' AS discovered_by
            FROM customer
            UNION ALL
            SELECT 't' || (s_suppkey % 5), 's' || s_suppkey, 'n' || (s_suppkey % 25), 'member_of', 'poll' FROM supplier
            UNION ALL
            SELECT 't' || (n_nationkey % 5), 'n' || n_nationkey, 'g' || (n_nationkey % 5), 'member_of', 'poll' FROM nation
            UNION ALL
            SELECT 't' || (s_suppkey % 5), 's' || s_suppkey,
                   's' || CASE WHEN (s_suppkey // 5) % 6 = 5 OR s_suppkey + 5 >= (SELECT count(*) FROM supplier) THEN ((s_suppkey // 30) * 30) + s_suppkey % 5 ELSE s_suppkey + 5 END,
                   'connected_to', CASE WHEN s_suppkey % 3 = 0 THEN 'lldp' ELSE 'arp' END
            FROM supplier
            WHERE s_suppkey <> CASE WHEN (s_suppkey // 5) % 6 = 5 OR s_suppkey + 5 >= (SELECT count(*) FROM supplier) THEN ((s_suppkey // 30) * 30) + s_suppkey % 5 ELSE s_suppkey + 5 END
            UNION ALL
            SELECT 't' || (s_suppkey % 5), 's' || s_suppkey, 's' || (s_suppkey + 5), 'runs', 'poll' FROM supplier
            WHERE s_suppkey % 20 < 5 AND s_suppkey + 5 < (SELECT count(*) FROM supplier)
            UNION ALL
            SELECT 't' || (s_suppkey % 5), 's' || (s_suppkey + 5), 's' || s_suppkey, 'hosts', 'poll' FROM supplier
            WHERE s_suppkey % 20 < 5 AND s_suppkey + 5 < (SELECT count(*) FROM supplier)""",
        "aliases": """
            SELECT 't' || (c_custkey % 5) AS tenant_id, 'old' || c_custkey AS alias_id, 'c' || c_custkey AS resource_id
            FROM customer WHERE c_custkey % 10 = 3""",
        # Chains of merges: each customer merged into the next of its tenant, ten to a chain.
        "merges": """
            SELECT 't' || (c_custkey % 5) AS tenant_id, 'c' || c_custkey AS alias_id, 'c' || (c_custkey + 5) AS resource_id
            FROM customer WHERE (c_custkey // 5) % 10 <> 9""",
        "groups": """
            SELECT DISTINCT 't' || (c_custkey % 5) AS tenant_id, c_mktsegment AS group_id, 'Group ' || c_mktsegment AS name FROM customer
            UNION ALL
            SELECT 't' || r_regionkey, 'EMPTY', 'Group EMPTY' FROM region""",
        "group_members": """
            SELECT 't' || (c_custkey % 5) AS tenant_id, c_mktsegment AS group_id, 'c' || c_custkey AS resource_id FROM customer""",
        "identifiers": f"""
            SELECT 't' || (c_custkey % 5) AS tenant_id, 'c' || c_custkey AS resource_id, 'hostname' AS kind,
                   lower(c_name) AS value, {d.at(f'{day0} + c_custkey * 60')} AS last_seen FROM customer
            UNION ALL
            SELECT 't' || (c_custkey % 5), 'c' || c_custkey, 'mgmt_ip',
                   '10.' || (10 + c_custkey % 5) || '.' || ((c_custkey // 1250) % 250) || '.' || ((c_custkey // 5) % 250),
                   {d.at(f'{day0} + c_custkey * 90')} FROM customer
            UNION ALL
            SELECT 't' || (c_custkey % 5), 'c' || c_custkey, 'serial', 'SN' || c_custkey, {d.at(f'{day0} + c_custkey * 30')}
            FROM customer WHERE c_custkey % 3 = 0
            UNION ALL
            SELECT 't' || (s_suppkey % 5), 's' || s_suppkey, 'chassis_id', 'CH' || s_suppkey, {d.at(f'{day0} + s_suppkey * 30')}
            FROM supplier
            UNION ALL
            SELECT 't' || (s_suppkey % 5), 's' || s_suppkey, 'hostname', lower(s_name), {d.at(f'{day0} + s_suppkey * 30')}
            FROM supplier""",
        # What arrived in a batch: one observation per order, with mixtures of right, wrong and
        # unknown identifiers.
        "observed": """
            SELECT 't' || (o_custkey % 5) AS tenant_id, 'o' || o_orderkey AS observation_id,
                   CASE WHEN o_orderkey % 2 = 0 THEN 'syslog' ELSE 'otlp' END AS source, 'hostname' AS kind,
                   'customer#' || lpad(cast(o_custkey as string), 9, '0') AS value
            FROM orders WHERE o_orderkey % 4 <> 3
            UNION ALL
            SELECT 't' || (o_custkey % 5), 'o' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'syslog' ELSE 'otlp' END, 'mgmt_ip',
                   CASE WHEN o_orderkey % 7 = 0 THEN '10.99.' || (o_orderkey % 250) || '.' || (o_custkey % 250)
                        ELSE '10.' || (10 + o_custkey % 5) || '.' || ((o_custkey // 1250) % 250) || '.' || ((o_custkey // 5) % 250) END
            FROM orders WHERE o_orderkey % 3 <> 2
            UNION ALL
            SELECT 't' || (o_custkey % 5), 'o' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'syslog' ELSE 'otlp' END, 'serial',
                   CASE WHEN o_orderkey % 17 = 0 THEN 'SNX' || o_orderkey ELSE 'SN' || o_custkey END
            FROM orders WHERE o_orderkey % 5 = 0
            UNION ALL
            SELECT 't' || (o_custkey % 5), 'o' || o_orderkey, 'otlp', 'service_name', 'shop/' || (o_orderkey % 11)
            FROM orders WHERE o_orderkey % 12 = 11""",
        "observations": """
            SELECT 't' || (o_custkey % 5) AS tenant_id, 'o' || o_orderkey AS observation_id,
                   CASE WHEN o_orderkey % 2 = 0 THEN 'syslog' ELSE 'otlp' END AS source
            FROM orders""",
        # --- address space ---
        "subnets": """
            SELECT 't' || (n_nationkey % 5) AS tenant_id, 'net' || n_nationkey AS id, 'Net ' || n_name AS name,
                   '10.' || (10 + n_nationkey % 5) || '.' || (n_nationkey // 5) || '.0/24' AS cidr FROM nation
            UNION ALL
            SELECT 't' || r_regionkey, 'wide' || r_regionkey, 'Wide', '10.' || (10 + r_regionkey) || '.0.0/16' FROM region
            UNION ALL
            SELECT 't' || r_regionkey, 'link' || r_regionkey, 'Link', '10.' || (10 + r_regionkey) || '.0.2/31' FROM region
            UNION ALL
            SELECT 't' || r_regionkey, 'one' || r_regionkey, 'One', '10.' || (10 + r_regionkey) || '.0.9/32' FROM region""",
        "candidates": f"""
            SELECT 't' || (o_custkey % 5) AS tenant_id, CASE WHEN o_orderkey % 2 = 0 THEN 'sweep' ELSE 'arp' END AS source,
                   '10.' || (10 + o_custkey % 5) || '.' || ((o_custkey // 1250) % 250) || '.' || ((o_custkey // 5 + (o_orderkey % 4) * 60) % 256) AS address,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'Dev' || (o_orderkey % 8) END AS sys_name,
                   CASE WHEN o_orderkey % 5 = 0 THEN 'Linux box' END AS sys_descr,
                   CASE WHEN o_orderkey % 7 = 0 THEN '00:1b:' || (10 + o_orderkey % 80) END AS mac,
                   cast(NULL as string) AS chassis_id,
                   CASE WHEN o_orderkey % 11 = 0 THEN 'ignored' WHEN o_orderkey % 13 = 0 THEN 'promoted' ELSE 'unidentified' END AS state,
                   'seen ' || o_orderkey AS reason,
                   cast(o_orderdate as timestamp) + (o_orderkey % 86400) * INTERVAL '1' SECOND AS last_seen, o_orderkey
            FROM orders""",
        # --- alerting ---
        "rules": """
            SELECT 't' || r_regionkey AS tenant_id, 'rule-' || r_regionkey || '-' || e.event_type AS rule_id,
                   'High ' || e.event_type AS name, e.event_type AS metric,
                   CASE WHEN r_regionkey % 2 = 0 THEN 'critical' ELSE 'warn' END AS severity, 'gt' AS op,
                   cast(18 + r_regionkey as double) AS threshold,
                   cast(CASE WHEN r_regionkey % 3 = 0 THEN 0 ELSE 7200 END as bigint) AS hold_seconds
            FROM region CROSS JOIN (SELECT DISTINCT event_type FROM events) AS e""",
        "evaluations": f"""
            SELECT m.tenant_id, r.rule_id, m.resource_id, 'rule=' || r.rule_id || ',resource=' || m.resource_id AS dedup_key,
                   m.observed_at AS happened_at, m.event_id AS evaluation_id, m.value,
                   m.value > r.threshold AS breaching, r.hold_seconds
            FROM metrics AS m JOIN rules AS r ON m.tenant_id = r.tenant_id AND m.metric = r.metric""",
        # Windows on one host, on a group and on a site of every tenant, in two zones without
        # daylight saving.
        "windows": """
            SELECT 't' || (c_custkey % 5) AS tenant_id, 'w' || c_custkey AS window_id, 'resource' AS target_kind, 'c' || c_custkey AS target_id,
                   TIMESTAMP '2024-01-01 20:00:00' AS starts_at, cast(60 + c_custkey % 300 as int) AS duration_minutes,
                   CASE WHEN c_custkey % 2 = 0 THEN 'Asia/Dhaka' ELSE 'UTC' END AS timezone,
                   CASE c_custkey % 4 WHEN 0 THEN 'once' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'monthly' END AS recurrence,
                   cast(c_custkey % 7 as int) AS weekday, cast(1 + c_custkey % 31 as int) AS day,
                   CASE WHEN c_custkey % 8 = 1 THEN TIMESTAMP '2024-01-10 00:00:00' END AS until,
                   c_custkey % 3 <> 0 AS suppress_alerts, c_custkey % 3 <> 1 AS suppress_notifications
            FROM customer
            UNION ALL
            SELECT 't' || r_regionkey, 'wg' || r_regionkey, 'group', 'BUILDING', TIMESTAMP '2024-01-02 08:00:00', 600, 'UTC', 'daily',
                   0, 1, NULL, r_regionkey % 2 = 0, true FROM region
            UNION ALL
            SELECT 't' || r_regionkey, 'ws' || r_regionkey, 'site', 'site' || r_regionkey, TIMESTAMP '2024-01-03 00:00:00', 9000, 'UTC', 'weekly',
                   2, 1, NULL, true, false FROM region""",
        # The last word on every series: what state it was left in.
        "alert_states": f"""
            SELECT tenant_id, dedup_key, max(rule_id) AS rule_id, max(resource_id) AS resource_id,
                   CASE WHEN count(*) % 4 = 0 THEN 'firing' WHEN count(*) % 4 = 1 THEN 'pending' WHEN count(*) % 4 = 2 THEN 'resolved' ELSE 'ok' END AS state,
                   min(happened_at) AS since, max(happened_at) AS last_eval, max(value) AS last_value,
                   CASE WHEN count(*) % 3 = 0 THEN 'op' || (count(*) % 5) END AS acked_by,
                   CASE WHEN count(*) % 3 = 0 THEN max(happened_at) END AS acked_at
            FROM evaluations GROUP BY tenant_id, dedup_key""",
        # A cycle's results: every second series moved on, and a few new ones appeared.
        "alert_cycle": f"""
            SELECT tenant_id, CASE WHEN last_value > 30 THEN dedup_key || ',port=1' ELSE dedup_key END AS dedup_key, rule_id, resource_id,
                   CASE WHEN last_value > 60 THEN 'firing' WHEN last_value > 45 THEN 'pending' WHEN state = 'firing' THEN 'resolved' ELSE 'ok' END AS state,
                   last_eval AS since, last_eval, last_value + 1 AS last_value
            FROM alert_states WHERE last_value > 25""",
        # An incident for every rule, its alerts, and which of them were announced.
        "incidents": """
            SELECT tenant_id, 'inc-' || rule_id AS incident_id, CASE WHEN rule_id LIKE '%click' THEN 'closed' ELSE 'open' END AS state,
                   TIMESTAMP '2024-01-01 00:00:00' AS started_at, cast(NULL as timestamp) AS quiet_at FROM rules
            UNION ALL
            SELECT 't' || r_regionkey, 'inc-none-' || r_regionkey, 'open', TIMESTAMP '2024-01-01 00:00:00', NULL FROM region""",
        "incident_alerts": """
            SELECT tenant_id, 'inc-' || rule_id AS incident_id, dedup_key, resource_id, last_value > 50 AS notified, since AS first_alert_at
            FROM alert_states WHERE state <> 'ok'""",
        # Incidents of devices as well as hosts, so that some members have others above them.
        "member_rows": """
            SELECT tenant_id, incident_id, resource_id, first_alert_at FROM incident_alerts
            UNION ALL
            SELECT a.tenant_id, a.incident_id, e.target_id, a.first_alert_at + INTERVAL '1' MINUTE FROM incident_alerts AS a
            JOIN edges AS e ON e.tenant_id = a.tenant_id AND e.source_id = a.resource_id WHERE a.notified
            UNION ALL
            SELECT tenant_id, 'solo-' || id, id, TIMESTAMP '2024-01-01 00:00:00' FROM resources WHERE kind = 'device'""",
        "attempts": f"""
            SELECT tenant_id, 'ch' || (event_id % 3) AS channel_id, event_id AS attempt_id,
                   {d.at(f'{day0} + (event_id * 7919) % 259200')} AS happened_at
            FROM metrics""",
        "firings": f"""
            SELECT tenant_id, rule_id, resource_id, dedup_key, happened_at, evaluation_id
            FROM evaluations WHERE breaching""",
    }


_NAMES = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b")


def view_sql(name: str, spark: bool) -> str:
    text = _views(Dialect(spark))[name]
    return text.replace("//", "div") if spark else text


def requirements(text: str, names) -> list[str]:
    """Views a statement reads, those they read first."""
    found: list[str] = []

    def visit(sql: str):
        for name in _NAMES.findall(sql):
            if name in names and name not in found:
                visit(names[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def oracle(sql: str) -> str:
    """A checking statement with the views it reads put in front."""
    views = {n: view_sql(n, spark=False) for n in _views(Dialect(False))}
    text = sql.strip()
    needed = [f"{n} AS ({views[n].strip()})" for n in requirements(text, views)]
    if not needed:
        return text
    recursive = ""
    if text.upper().startswith("WITH RECURSIVE "):
        recursive, text = "RECURSIVE ", "WITH " + text[len("WITH RECURSIVE "):]
    if text.upper().startswith("WITH "):
        return f"WITH {recursive}{', '.join(needed)}, {text[5:]}"
    return f"WITH {', '.join(needed)} {text}"


@dataclass
class Tables:
    """Lazy access to the supplied tables and the views over them, as attributes."""

    spark: SparkSession
    folder: str
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        prepare(self.spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = view_sql(name, spark=True)
        return self.sql(text)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views by name."""
        known = [*TABLES, *_views(Dialect(True))]
        used = {n for n in _NAMES.findall(text) if n in known}
        framed = re.sub(
            r"\b(FROM|JOIN)(\s+)([a-z_]+)\b",
            lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in used else m[0],
            text.replace("{", "{{").replace("}", "}}"),
        )
        return self.spark.sql(framed, **{n: getattr(self, n) for n in used})
