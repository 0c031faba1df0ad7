"""Identity resolution, address space and network inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import addresses, devices, identity
from beaconry.plans.registry import query

# --- identity ---

_CONF = """CASE kind WHEN 'serial' THEN 1.0 WHEN 'chassis_id' THEN 1.0 WHEN 'mac' THEN 0.9 WHEN 'mgmt_ip' THEN 0.8
    WHEN 'hostname' THEN 0.65 WHEN 'service_name' THEN 0.6 END"""
_CANDIDATES = f"""seen AS (SELECT DISTINCT tenant_id, observation_id, kind, value FROM observed),
    hits AS (SELECT s.*, i.resource_id, cast({_CONF.replace('kind', 's.kind')} as double) AS c FROM seen AS s JOIN identifiers AS i
      ON i.tenant_id = s.tenant_id AND i.kind = s.kind AND i.value = s.value),
    cand AS (SELECT tenant_id, observation_id, resource_id, count(*) AS matched, 1 - product(1 - c) AS confidence FROM hits GROUP BY ALL),
    clash AS (SELECT DISTINCT c.tenant_id, c.observation_id, c.resource_id FROM cand AS c
      JOIN seen AS s ON s.tenant_id = c.tenant_id AND s.observation_id = c.observation_id AND s.kind IN ('serial', 'chassis_id')
      JOIN identifiers AS i ON i.tenant_id = c.tenant_id AND i.resource_id = c.resource_id AND i.kind = s.kind AND i.value <> s.value),
    full_cand AS (SELECT c.*, k.resource_id IS NOT NULL AS contradicted FROM cand AS c LEFT JOIN clash AS k
      ON k.tenant_id = c.tenant_id AND k.observation_id = c.observation_id AND k.resource_id = c.resource_id)"""
query("identity_candidates", f"WITH {_CANDIDATES} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM full_cand")(
    lambda t: identity.identity_candidates(t.observed, t.identifiers)
)
_DECIDE = f"""WITH {_CANDIDATES},
    best AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, observation_id) AS resources,
      row_number() OVER (PARTITION BY tenant_id, observation_id ORDER BY contradicted, confidence DESC, resource_id) AS rn FROM full_cand),
    offered AS (SELECT tenant_id, observation_id, count(*) AS n FROM seen GROUP BY ALL),
    judged AS (SELECT o.tenant_id, o.observation_id, o.source, b.resource_id AS best_id, b.confidence AS sure,
      CASE WHEN b.resource_id IS NULL THEN 'no_match' WHEN b.resources = 1 AND b.matched = f.n AND NOT b.contradicted THEN 'repeat'
        WHEN b.contradicted THEN 'tier_one_contradiction' WHEN b.confidence >= 0.95 THEN 'sure' WHEN b.confidence >= 0.60 THEN 'likely' ELSE 'below_floor' END AS why
      FROM observations AS o LEFT JOIN offered AS f ON f.tenant_id = o.tenant_id AND f.observation_id = o.observation_id
      LEFT JOIN best AS b ON b.tenant_id = o.tenant_id AND b.observation_id = o.observation_id AND b.rn = 1),
    decided AS (SELECT tenant_id, observation_id, source, CASE why WHEN 'repeat' THEN 'match' WHEN 'sure' THEN 'merge' WHEN 'likely' THEN 'review' ELSE 'new' END AS outcome,
      CASE WHEN why IN ('no_match', 'tier_one_contradiction', 'below_floor') THEN why END AS reason,
      CASE WHEN why IN ('repeat', 'sure') THEN best_id END AS resource_id, CASE WHEN why IN ('repeat', 'sure', 'likely') THEN sure END AS confidence FROM judged)"""


def _decided(t):
    return identity.identity_decide(t.observations, t.observed, t.identifiers)


query("identity_decide", f"{_DECIDE} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM decided")(_decided)
_NAMED = """WITH named AS (SELECT tenant_id, observation_id, arg_min(value, row(CASE kind WHEN 'hostname' THEN 1 WHEN 'serial' THEN 2 WHEN 'mgmt_ip' THEN 3 ELSE 5 END, kind, value)) AS name,
         bool_or(kind = 'hostname') AS h, bool_or(kind = 'service_name') AS s, bool_or(kind = 'mgmt_ip') AS a FROM observed GROUP BY ALL)
       SELECT o.tenant_id, o.observation_id, o.source, coalesce(name, 'unidentified-' || o.source) AS name,
         CASE WHEN o.source = 'otlp' AND coalesce(h, false) THEN 'host' WHEN coalesce(s, false) AND NOT a AND NOT h THEN 'service' ELSE 'device' END AS kind
       FROM observations AS o LEFT JOIN named AS n ON n.tenant_id = o.tenant_id AND n.observation_id = o.observation_id"""
query(
    "identity_name_kind",
    _NAMED,
)(lambda t: identity.identity_name_kind(t.observations, t.observed))
# Groups are components of a graph, found by an iterative job; a test checks them by brute force.
query("identity_new_groups")(lambda t: identity.identity_new_groups(t.observed, _decided(t)))
_TARGETS = f"""{_DECIDE},
    told AS (SELECT tenant_id, observation_id, string_agg(kind || '|' || value, ',' ORDER BY kind, value) AS told FROM seen GROUP BY ALL),
    told_of AS (SELECT d.tenant_id, d.observation_id, coalesce(reason, outcome) AS why, resource_id, told
      FROM decided AS d LEFT JOIN told AS s ON s.tenant_id = d.tenant_id AND s.observation_id = d.observation_id),
    target AS (SELECT tenant_id, observation_id, why, coalesce(resource_id, 'new-' || CASE WHEN told IS NULL THEN observation_id
      ELSE min(observation_id) OVER (PARTITION BY tenant_id, why, told, resource_id IS NULL) END) AS resource_id FROM told_of)"""


def _targets(t):
    return identity.identity_targets(t.observed, _decided(t))


query("identity_targets", f"{_TARGETS} SELECT * FROM target")(_targets)
query(
    "identity_changes",
    f"""{_TARGETS}, held AS (SELECT tenant_id, kind, value, min(resource_id) AS previous_id FROM identifiers GROUP BY ALL),
        claim AS (SELECT s.*, t.resource_id, previous_id, CASE WHEN why = 'tier_one_contradiction' THEN 0 WHEN why IN ('match', 'merge') THEN 1 ELSE 2 END AS rank
          FROM seen AS s JOIN target AS t ON t.tenant_id = s.tenant_id AND t.observation_id = s.observation_id
          LEFT JOIN held AS h ON h.tenant_id = s.tenant_id AND h.kind = s.kind AND h.value = s.value)
        SELECT tenant_id, kind, value, arg_min(resource_id, row(rank, observation_id)) AS resource_id, previous_id,
          CASE WHEN previous_id IS NULL THEN 'attached' ELSE 'moved' END AS change
        FROM claim GROUP BY tenant_id, kind, value, previous_id HAVING min(rank) = 0 OR previous_id IS NULL""",
)(lambda t: identity.identity_changes(t.observed, t.identifiers, _targets(t)))
query(
    "identity_provisional",
    f"""{_TARGETS}, named_of AS ({_NAMED})
        SELECT t.tenant_id, resource_id, arg_min(name, t.observation_id) AS name, arg_min(kind, t.observation_id) AS kind
        FROM target AS t JOIN named_of AS n ON n.tenant_id = t.tenant_id AND n.observation_id = t.observation_id
        WHERE why NOT IN ('match', 'merge') GROUP BY ALL""",
)(lambda t: identity.identity_provisional(identity.identity_name_kind(t.observations, t.observed), _targets(t)))
query(
    "observed_identifiers",
    """SELECT event_id, 'mgmt_ip' AS kind, peer AS value FROM syslog_parts
       UNION ALL SELECT event_id, 'hostname', lower(host) FROM syslog_parts WHERE shape IN (0, 1, 2, 3, 4, 9)""",
)(lambda t: identity.syslog_identifiers(_syslog_rows(t), ["event_id"]))
query(
    "observed_identifiers_otlp",
    """SELECT doc_id, 'hostname' AS kind, lower(host_name) AS value FROM logs
       UNION ALL SELECT doc_id, 'service_name', CASE WHEN doc_id % 4 = 0 THEN service_name ELSE 'rack' || (doc_id % 13) || '/' || service_name END FROM logs""",
)(
    lambda t: identity.otlp_host_identifiers(_otlp_rows(t), ["doc_id"]).unionByName(
        identity.otlp_service_identifiers(_otlp_rows(t), ["doc_id"])
    )
)


def _syslog_rows(t):
    from beaconry.sources import syslog

    return syslog.syslog_to_logs(syslog.parse_syslog(t.syslog_lines))


def _otlp_rows(t):
    """Resource attributes as an exporter would send them."""
    named = F.create_map(F.lit("host.name"), F.col("host_name"), F.lit("service.name"), F.col("service_name"))
    spaced = F.create_map(F.lit("service.namespace"), F.try_element_at("attributes", F.lit("rack")))
    rack = F.try_element_at("attributes", F.lit("rack")).isNotNull()
    return t.logs.select("doc_id", F.when(rack, F.map_concat(named, spaced)).otherwise(named).alias("attributes"))


_CHAINS = """WITH RECURSIVE steps AS (SELECT tenant_id, alias_id, resource_id FROM merges
    UNION SELECT h.tenant_id, h.alias_id, m.resource_id FROM steps AS h JOIN merges AS m ON m.tenant_id = h.tenant_id AND m.alias_id = h.resource_id),
    ends AS (SELECT h.* FROM steps AS h WHERE NOT EXISTS (SELECT 1 FROM merges AS m WHERE m.tenant_id = h.tenant_id AND m.alias_id = h.resource_id))"""
query("alias_collapse", f"{_CHAINS} SELECT * FROM ends")(lambda t: identity.alias_collapse(t.merges))
query(
    "merge_split",
    f"""{_CHAINS}, merged AS (SELECT i.tenant_id, coalesce(e.resource_id, i.resource_id) AS resource_id, i.kind, i.value FROM identifiers AS i
          LEFT JOIN ends AS e ON e.tenant_id = i.tenant_id AND e.alias_id = i.resource_id)
        SELECT tenant_id, CASE WHEN kind = 'serial' THEN 'split-' || value ELSE resource_id END AS resource_id, kind, value FROM merged""",
)(
    lambda t: _merge_then_split(t).select("tenant_id", "resource_id", "kind", "value")
)


def _merge_then_split(t):
    """Merge every chain, then split each serial number off into a resource of its own."""
    none = t.merges.limit(0)
    moved, _ = identity.merge(t.identifiers, none, t.merges)
    serials = moved.where("kind = 'serial'").select(
        "tenant_id", "kind", "value", "resource_id", F.concat(F.lit("split-"), F.col("value")).alias("new_resource_id")
    )
    return identity.split(moved, serials)


# --- address space ---

_NUM = "list_reduce(list_transform(string_split({c}, '.'), lambda x: cast(x as bigint)), lambda a, b: a * 256 + b)"
_NETS = f"""nets AS (SELECT *, cast(split_part(cidr, '/', 2) as int) AS bits, {_NUM.format(c="split_part(cidr, '/', 1)")} AS base FROM subnets),
    bounds AS (SELECT tenant_id, id, name, cidr, bits, base - base % cast(pow(2, 32 - bits) as bigint) AS lo, cast(pow(2, 32 - bits) as bigint) AS size FROM nets),
    claimed AS (SELECT tenant_id, {_NUM.format(c='value')} AS n, resource_id, last_seen FROM identifiers WHERE kind = 'mgmt_ip'),
    answered AS (SELECT tenant_id, {_NUM.format(c='address')} AS n, * EXCLUDE (tenant_id) FROM candidates)"""
query(
    "subnet_utilisation",
    f"""WITH {_NETS} SELECT b.tenant_id, b.id, b.name, b.cidr, CASE WHEN bits = 32 THEN 1 WHEN bits = 31 THEN 2 ELSE size - 2 END AS capacity,
        (SELECT count(DISTINCT n) FROM claimed AS c WHERE c.tenant_id = b.tenant_id AND c.n >= b.lo AND c.n < b.lo + b.size) AS assigned,
        (SELECT count(DISTINCT n) FROM answered AS a WHERE a.tenant_id = b.tenant_id AND a.n >= b.lo AND a.n < b.lo + b.size) AS responding,
        (SELECT count(DISTINCT a.n) FROM answered AS a ANTI JOIN claimed AS c ON c.tenant_id = a.tenant_id AND c.n = a.n
          WHERE a.tenant_id = b.tenant_id AND a.n >= b.lo AND a.n < b.lo + b.size) AS unaccounted FROM bounds AS b""",
)(lambda t: addresses.subnet_utilisation(t.subnets, t.identifiers, t.candidates))
query(
    "subnet_addresses",
    f"""WITH {_NETS}, c AS (SELECT tenant_id, n, arg_min(resource_id, row(-epoch_us(last_seen), resource_id)) AS resource_id, max(last_seen) AS cs FROM claimed GROUP BY ALL),
        a AS (SELECT tenant_id, n, max(last_seen) AS las FROM answered GROUP BY ALL),
        both_ AS (SELECT coalesce(c.tenant_id, a.tenant_id) AS tenant_id, coalesce(c.n, a.n) AS n, c.resource_id, a.n IS NOT NULL AS responding,
          greatest(cs, las) AS last_seen FROM c FULL JOIN a ON a.tenant_id = c.tenant_id AND a.n = c.n)
        SELECT b.tenant_id, b.id AS subnet_id, (n // 16777216) || '.' || (n // 65536) % 256 || '.' || (n // 256) % 256 || '.' || n % 256 AS address,
          x.resource_id, r.name AS resource_name, responding, responding AND x.resource_id IS NULL AS unclaimed, epoch_ms(x.last_seen) AS last_seen
        FROM both_ AS x JOIN bounds AS b ON b.tenant_id = x.tenant_id AND x.n >= b.lo AND x.n < b.lo + b.size
        LEFT JOIN resources AS r ON r.tenant_id = x.tenant_id AND r.id = x.resource_id""",
)(
    lambda t: addresses.subnet_addresses(t.subnets, t.identifiers, t.candidates, t.resources, t.makers).select(
        "tenant_id", "subnet_id", "address", "resource_id", "resource_name", "responding", "unclaimed", "last_seen"
    )
)
query(
    "range_expand",
    f"""WITH ok AS (SELECT * FROM sweeps WHERE regexp_full_match(cidr, '[0-9.]+/[0-9]+')),
        bad AS (SELECT * FROM sweeps WHERE NOT regexp_full_match(cidr, '[0-9.]+/[0-9]+')),
        sized AS (SELECT tenant_id, job_id, cast(split_part(cidr, '/', 2) as int) AS bits, {_NUM.format(c="split_part(cidr, '/', 1)")} AS base FROM ok),
        hosts AS (SELECT DISTINCT tenant_id, job_id, unnest(range(lo + edge, lo + size - edge)) AS n FROM (SELECT tenant_id, job_id,
          base - base % cast(pow(2, 32 - bits) as bigint) AS lo, cast(pow(2, 32 - bits) as bigint) AS size, CASE WHEN bits < 31 THEN 1 ELSE 0 END AS edge FROM sized
          WHERE bits >= 14))
        SELECT tenant_id, job_id, cidr, NULL AS address, 'not a range' AS problem FROM bad
        UNION ALL SELECT s.tenant_id, s.job_id, s.cidr, NULL, 'range too wide' FROM ok AS s WHERE cast(split_part(cidr, '/', 2) as int) < 14
        UNION ALL SELECT tenant_id, job_id, NULL, (n // 16777216) || '.' || (n // 65536) % 256 || '.' || (n // 256) % 256 || '.' || n % 256, NULL FROM hosts""",
)(lambda t: addresses.range_expand(t.sweeps, widest=14))

# --- devices ---

query(
    "device_guess",
    r"""WITH bare AS (SELECT e.*, lower(regexp_replace(mac, '[:. -]', '', 'g')) AS b FROM evidence AS e),
       owned AS (SELECT *, CASE WHEN regexp_full_match(b, '[0-9a-f]{12}') AND substr(b, 2, 1) IN ('0', '4', '8', 'c') THEN b END AS m FROM bare),
       vendors AS (SELECT o.*, coalesce(r9.organisation, r7.organisation, r6.organisation) AS vendor FROM owned AS o LEFT JOIN makers AS r9 ON r9.prefix = substr(m, 1, 9)
         LEFT JOIN makers AS r7 ON r7.prefix = substr(m, 1, 7) LEFT JOIN makers AS r6 ON r6.prefix = substr(m, 1, 6)),
       roles AS (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN 'printer' WHEN 1 THEN 'server' WHEN 2 THEN 'firewall' END AS d, CASE WHEN vendor = 'Zebra Inc' THEN 'printer' WHEN vendor = 'MikroTik' THEN 'router' END AS v,
         CASE (o_orderkey // 8) % 5 WHEN 0 THEN 'camera' WHEN 1 THEN 'switch' WHEN 2 THEN 'printer' END AS h,
         CASE o_orderkey % 8 WHEN 0 THEN 'laserjet' WHEN 1 THEN 'linux' WHEN 2 THEN 'adaptive security appliance' END AS dw, CASE (o_orderkey // 8) % 5 WHEN 0 THEN 'cam' WHEN 1 THEN 'sw-' WHEN 2 THEN 'printer' END AS hw FROM vendors),
       said AS (SELECT *, list_filter(['sys_descr: it describes itself as ' || dw, CASE WHEN v IS NOT NULL THEN 'mac: the MAC is assigned to ' || vendor END,
         'hostname: the hostname contains "' || hw || '"', CASE WHEN ttl <= 64 THEN 'ttl: it replied with a TTL ' || (64 - ttl) || ' below 64' WHEN ttl <= 128 THEN 'ttl: it replied with a TTL ' || (128 - ttl) || ' below 128'
           WHEN ttl <= 255 THEN 'ttl: it replied with a TTL ' || (255 - ttl) || ' below 255' END], lambda x: x IS NOT NULL) AS reasons FROM roles)
       SELECT o_orderkey, coalesce(d, v, h, 'unknown') AS role, CASE WHEN d IS NOT NULL THEN 'likely' WHEN v IS NOT NULL AND h IS NOT NULL AND v <> h THEN 'possible' WHEN v IS NOT NULL THEN 'likely'
         WHEN h IS NOT NULL THEN 'possible' ELSE 'unknown' END AS confidence,
         array_to_string(CASE WHEN len(reasons) = 0 AND vendor IS NOT NULL THEN ['mac: the MAC is assigned to ' || vendor] ELSE reasons END, ';') AS reasons FROM said""",
)(lambda t: devices.device_guess(t.evidence, t.makers).select("o_orderkey", "role", "confidence", "reasons"))

# Row by row within each device, carrying the list of rows that stand.
_MERGED = """WITH RECURSIVE turns AS (SELECT *, lower(chassis_id) AS ch, lower(sys_name) AS nm,
        row_number() OVER (PARTITION BY tenant_id, seen_from ORDER BY protocol <> 'lldp', place) AS turn FROM neighbours WHERE protocol <> 'arp'),
    walk AS (SELECT tenant_id, seen_from, turn, place, place AS into_place, [{'place': place, 'ch': ch, 'nm': nm}] AS stand FROM turns WHERE turn = 1
      UNION ALL
      SELECT tenant_id, seen_from, turn, place, coalesce(hit[1].place, place), CASE WHEN len(hit) = 0 THEN list_append(stand, {'place': place, 'ch': ch, 'nm': nm}) ELSE stand END
      FROM (SELECT t.tenant_id, t.seen_from, t.turn, t.place, t.ch, t.nm, w.stand, CASE WHEN t.protocol = 'lldp' THEN [] ELSE list_filter(w.stand, lambda o:
          CASE WHEN o.ch IS NOT NULL AND t.ch IS NOT NULL THEN o.ch = t.ch ELSE coalesce(o.nm = t.nm, false) END) END AS hit
        FROM walk AS w JOIN turns AS t ON t.tenant_id = w.tenant_id AND t.seen_from = w.seen_from AND t.turn = w.turn + 1) AS stepped),
    taken AS (SELECT w.tenant_id, w.seen_from, w.into_place, arg_min(t.address, t.place) FILTER (t.address IS NOT NULL) AS address,
        arg_min(t.platform, t.place) FILTER (t.platform IS NOT NULL) AS platform FROM walk AS w
      JOIN turns AS t ON t.tenant_id = w.tenant_id AND t.seen_from = w.seen_from AND t.place = w.place WHERE w.place <> w.into_place GROUP BY ALL),
    merged AS (SELECT n.tenant_id, n.seen_from, n.protocol, n.place, n.chassis_id, n.sys_name, coalesce(n.address, k.address) AS address, coalesce(n.platform, k.platform) AS platform
      FROM walk AS w JOIN neighbours AS n ON n.tenant_id = w.tenant_id AND n.seen_from = w.seen_from AND n.place = w.place
      LEFT JOIN taken AS k ON k.tenant_id = w.tenant_id AND k.seen_from = w.seen_from AND k.into_place = w.place
      WHERE w.place = w.into_place AND (coalesce(n.address, k.address) IS NOT NULL OR n.chassis_id IS NOT NULL)
      UNION ALL SELECT tenant_id, seen_from, protocol, place, chassis_id, sys_name, address, platform FROM neighbours WHERE protocol = 'arp' AND address IS NOT NULL)"""
query("neighbour_merge", f"{_MERGED} SELECT * FROM merged")(lambda t: devices.neighbour_merge(t.neighbours))

_IDENTIFIED = f"""{_MERGED}, offered AS (SELECT tenant_id, seen_from, protocol, place, 'chassis_id' AS kind, chassis_id AS value FROM merged WHERE chassis_id IS NOT NULL
      UNION ALL SELECT tenant_id, seen_from, protocol, place, 'mgmt_ip', address FROM merged WHERE address IS NOT NULL
      UNION ALL SELECT tenant_id, seen_from, protocol, place, 'hostname', sys_name FROM merged WHERE sys_name IS NOT NULL),
    found AS (SELECT o.tenant_id, o.seen_from, o.protocol, o.place, min(i.resource_id) FILTER (o.kind = 'chassis_id') AS sure,
        count(DISTINCT i.resource_id) AS n, min(i.resource_id) AS lone FROM offered AS o
      JOIN identifiers AS i ON i.tenant_id = o.tenant_id AND i.kind = o.kind AND i.value = o.value GROUP BY ALL),
    identified AS (SELECT m.*, CASE WHEN f.n IS NULL THEN 'unidentified' WHEN sure IS NULL AND f.n > 1 THEN 'ambiguous' ELSE 'known' END AS verdict,
        CASE WHEN sure IS NOT NULL THEN sure WHEN f.n = 1 THEN lone END AS resource_id FROM merged AS m
      LEFT JOIN found AS f ON f.tenant_id = m.tenant_id AND f.seen_from = m.seen_from AND f.protocol = m.protocol AND f.place = m.place)"""


def _identified(t):
    return devices.neighbour_identify(devices.neighbour_merge(t.neighbours), t.identifiers)


query(
    "neighbour_edges",
    f"""{_IDENTIFIED} SELECT tenant_id, least(seen_from, resource_id) AS source_id, greatest(seen_from, resource_id) AS target_id,
        arg_max(protocol, place) AS discovered_by, 'connected_to' AS kind FROM identified WHERE verdict = 'known' AND resource_id <> seen_from GROUP BY 1, 2, 3""",
)(lambda t: devices.neighbour_edges(_identified(t)))
query(
    "neighbour_candidates",
    f"SELECT tenant_id, protocol AS source, seen_from, place, verdict AS state FROM ({_IDENTIFIED} SELECT * FROM identified) WHERE verdict <> 'known'",
)(lambda t: devices.neighbour_candidates(_identified(t)).select("tenant_id", "source", "seen_from", "place", "state"))
query(
    "candidate_upsert",
    """WITH batch AS (SELECT tenant_id, source || '|' || address || '|' AS fingerprint, arg_max(sys_name, row(last_seen, o_orderkey)) FILTER (sys_name IS NOT NULL) AS sys_name,
         arg_max(mac, row(last_seen, o_orderkey)) FILTER (mac IS NOT NULL) AS mac, arg_max(state, row(last_seen, o_orderkey)) AS state, arg_max(reason, row(last_seen, o_orderkey)) AS reason,
         min(last_seen) AS first_seen, max(last_seen) AS last_seen FROM candidates WHERE state = 'unidentified' GROUP BY ALL)
       SELECT coalesce(n.tenant_id, o.tenant_id) AS tenant_id, coalesce(n.fingerprint, o.fingerprint) AS fingerprint, coalesce(n.sys_name, o.sys_name) AS sys_name, coalesce(n.mac, o.mac) AS mac,
         coalesce(o.state, n.state) AS state, coalesce(o.reason, n.reason) AS reason, epoch_ms(coalesce(o.first_seen, n.first_seen)) AS first_seen, epoch_ms(greatest(o.last_seen, n.last_seen)) AS last_seen
       FROM stored_candidates AS o FULL JOIN batch AS n ON n.tenant_id = o.tenant_id AND n.fingerprint = o.fingerprint""",
)(
    lambda t: devices.candidate_upsert(
        t.stored_candidates, t.candidates.where("state = 'unidentified'"), ["sys_name", "mac"], ["last_seen", "o_orderkey"]
    ).select("tenant_id", "fingerprint", "sys_name", "mac", "state", "reason", "first_seen", "last_seen")
)
query(
    "path_summary",
    """SELECT tenant_id, target, count(*) AS hops, count(address) AS answered, min(number) FILTER (address LIKE '203.%' OR address LIKE '100.%') AS leaves_private_at,
       round(max(least(rtt_a, rtt_b)), 6) AS slowest_ms FROM path_rows GROUP BY ALL""",
)(lambda t: devices.path_summary(t.path_rows.withColumn("rtt_ms", F.array("rtt_a", "rtt_b"))))
query(
    "path_hops",
    """SELECT tenant_id, target, number, round((CASE WHEN rtt_a IS NULL THEN 1 ELSE 0 END + CASE WHEN rtt_b IS NULL THEN 1 ELSE 0 END) / 2, 6) AS loss,
       round(least(rtt_a, rtt_b), 6) AS best_ms FROM path_rows""",
)(
    lambda t: devices.path_hops(t.path_rows.withColumn("rtt_ms", F.array("rtt_a", "rtt_b"))).select(
        "tenant_id", "target", "number", "loss", "best_ms"
    )
)


def _with_attributes(t):
    return t.resources.withColumn("attributes", F.create_map(F.lit("region"), F.col("site_id")))


query(
    "inventory_children",
    """SELECT tenant_id, id, parent_id, kind, name, site_id, 'region=' || site_id AS attributes FROM resources
       UNION ALL SELECT i.tenant_id, i.parent_id || '/interface/' || i.name, i.parent_id, 'interface', i.name, r.site_id, 'network.interface.index=' || max(i.index)
       FROM interfaces AS i JOIN resources AS r ON r.tenant_id = i.tenant_id AND r.id = i.parent_id GROUP BY ALL""",
)(
    lambda t: devices.inventory_children(_with_attributes(t), t.interfaces).select(
        "tenant_id", "id", "parent_id", "kind", "name", "site_id", "attributes"
    )
)
query(
    "inventory_child_edges",
    "SELECT DISTINCT tenant_id, parent_id || '/interface/' || name AS source_id, parent_id AS target_id FROM interfaces",
)(
    lambda t: devices.child_edges(t.interfaces, devices.inventory_children(_with_attributes(t), t.interfaces)).select(
        "tenant_id", "source_id", "target_id"
    )
)
query(
    "inventory_child_identifiers",
    "SELECT tenant_id, 'mac' AS kind, mac AS value, min(parent_id || '/interface/' || name) AS resource_id, 0.9 AS confidence FROM interfaces GROUP BY ALL",
)(
    lambda t: devices.child_identifiers(
        t.interfaces.withColumn("identifier_kind", F.lit("mac")).withColumn("value", F.col("mac")),
        devices.inventory_children(_with_attributes(t), t.interfaces), t.identifiers,
    )
)
query(
    "infer_vendor",
    """WITH made AS (SELECT i.tenant_id, i.parent_id, arg_min(m.organisation, row(i.index_number, i.mac)) AS maker FROM interfaces AS i
         JOIN makers AS m ON m.prefix = substr(replace(i.mac, ':', ''), 1, 6) WHERE i.mac LIKE '00:%' GROUP BY ALL)
       SELECT r.tenant_id, r.id, CASE WHEN r.vendor <> '' THEN r.vendor ELSE coalesce(m.maker, r.vendor) END AS vendor FROM resources AS r
       LEFT JOIN made AS m ON m.tenant_id = r.tenant_id AND m.parent_id = r.id""",
)(lambda t: devices.infer_vendor(t.resources, t.interfaces, t.makers).select("tenant_id", "id", "vendor"))
query(
    "device_facts",
    """SELECT r.tenant_id, r.id, coalesce(p.vendor, r.vendor) AS vendor, coalesce(p.model, 'old') AS model, 'oldos' AS os, coalesce(p.os_version, '0') AS os_version
       FROM resources AS r LEFT JOIN polled AS p ON p.tenant_id = r.tenant_id AND p.resource_id = r.id""",
)(
    lambda t: devices.device_facts(
        t.resources.withColumns({"model": F.lit("old"), "os": F.lit("oldos"), "os_version": F.lit("0")}), t.polled
    ).select("tenant_id", "id", "vendor", "model", "os", "os_version")
)
query(
    "device_serials",
    """SELECT tenant_id, 'serial' AS kind, serial AS value, resource_id FROM polled AS p WHERE serial <> '' AND NOT EXISTS (
       SELECT 1 FROM identifiers AS i WHERE i.tenant_id = p.tenant_id AND i.kind = 'serial' AND i.value = p.serial)""",
)(lambda t: devices.serial_identifiers(t.polled, t.identifiers))
query(
    "sweep_outcomes",
    f"""{_DECIDE} SELECT s.tenant_id, s.run_id, count(*) AS probed, count(*) FILTER (result <> 'silent') AS answered,
        count(*) FILTER (result = 'answered' AND (sys_name IS NOT NULL OR sys_object_id IS NOT NULL) AND outcome = 'new') AS created,
        count(*) FILTER (result = 'answered' AND (sys_name IS NOT NULL OR sys_object_id IS NOT NULL) AND outcome IN ('match', 'merge')) AS merged,
        count(*) FILTER (result = 'answered' AND (sys_name IS NOT NULL OR sys_object_id IS NOT NULL) AND outcome = 'review') AS for_review,
        count(*) FILTER (result = 'refused' OR result = 'answered' AND sys_name IS NULL AND sys_object_id IS NULL) AS candidates
        FROM sightings AS s LEFT JOIN decided AS d ON d.tenant_id = s.tenant_id AND d.observation_id = s.observation_id GROUP BY ALL""",
)(lambda t: devices.sweep_outcomes(t.sightings, _decided(t)))

query(
    "sweep_candidates",
    """SELECT tenant_id, run_id, observation_id, CASE result WHEN 'refused' THEN 'unreachable' ELSE 'unidentified' END AS state,
        CASE result WHEN 'refused' THEN 'credentials_refused' ELSE 'no_name_or_object_id' END AS reason
        FROM sightings WHERE result = 'refused' OR result = 'answered' AND sys_name IS NULL AND sys_object_id IS NULL""",
)(lambda t: devices.sweep_candidates(t.sightings).select("tenant_id", "run_id", "observation_id", "state", "reason"))

_NOW = "2024-01-01 00:08:00"
query(
    "collector_health",
    f"""SELECT collector_id, CASE WHEN retired THEN 'retired' WHEN last_seen_at IS NULL THEN 'silent'
        WHEN last_seen_at < TIMESTAMP '{_NOW}' - INTERVAL '3' MINUTE THEN 'quiet' ELSE 'reporting' END AS health FROM collectors""",
)(
    lambda t: devices.collector_health(t.collectors, F.lit(_NOW).cast("timestamp")).select("collector_id", "health")
)
query(
    "collector_quiet",
    f"""SELECT collector_id, epoch_ms(last_seen_at + INTERVAL '3' MINUTE) AS observed_at, 'Collector stopped reporting: ' || kind || ' ' || name AS summary
        FROM collectors WHERE NOT retired AND last_seen_at < TIMESTAMP '{_NOW}' - INTERVAL '3' MINUTE AND kind = 'syslog'""",
)(
    # Every quiet collector of one kind has been reported already.
    lambda t: devices.collector_quiet(
        t.collectors, t.collectors.where("kind = 'otlp'").select("collector_id", "last_seen_at"), F.lit(_NOW).cast("timestamp")
    ).select("collector_id", "observed_at", "summary")
)
