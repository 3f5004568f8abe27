"""DuckDB formulations: the derived inputs and tables as named sub-queries.

Written in the direct form (range joins, correlated EXISTS, distinct counts),
not in the form the engine uses. ``sql(body)`` prepends the sub-queries that
the body needs, in dependency order.
"""

from __future__ import annotations

import re

from testbed import traces as T

AS_OF, GAP, CUTOFF_TS, SINCE = 1706659200, 86400, 1706400000, 1706659200 - 90 * 86400
D30 = AS_OF - 30 * 86400
TODAY = "DATE '2024-01-31'"


def sev(x: str) -> str:
    return f"(CASE WHEN {x} <= 1 THEN 1 WHEN {x} = 2 THEN 3 WHEN {x} = 3 THEN 7 ELSE 12 END)::DOUBLE"


def dur(x: str) -> str:
    return f"(1 + least({x}::DOUBLE / 86400, 30) / 10::DOUBLE)"


def rec(n: str) -> str:
    return f"(1 + greatest(0, {n} - 1) * 0.5::DOUBLE)"


def score(risk: str) -> str:
    return f"greatest(0::DOUBLE, 100 - least(coalesce({risk}, 0)::DOUBLE * 0.2::DOUBLE, 100))"


def lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def pick(words, index: str) -> str:
    return f"({lst(words)})[(({index}) % {len(words)}) + 1]"


CODE = "printf('P%04d', {})".format
MODE = "(SELECT {key} FROM (SELECT {group}, {key}, sum({weight}) s FROM {table} GROUP BY ALL) m WHERE m.{group} = {outer} ORDER BY s DESC, {key} LIMIT 1)"

CTES: dict[str, str] = {
    "ev": "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events",
    "history": f"""SELECT 'V' || user_id AS uniqueid, sec AS ts,
        [CASE WHEN event_type = 'view' AND k % 5 = 0 THEN '0' ELSE {CODE('k % 10')} END, {CODE('10 + k % 3')}] AS codes,
        CASE WHEN k % 7 <> 0 THEN value END AS lat, -value AS lng, CASE WHEN k % 4 <> 0 THEN k::VARCHAR END AS pgn
        FROM ev WHERE event_type <> 'signup'""",
    "cyc": "SELECT 'V' || user_id AS uniqueid, sec AS cycle_ts FROM ev WHERE event_type = 'signup' AND k % 11 <> 0",
    "profile": """SELECT 'T' || (c_nationkey % 5) AS clientLoginId, 'V' || c_custkey AS uniqueid, c_name AS vehicle_number,
        CASE WHEN c_nationkey % 6 = 0 THEN '' ELSE c_mktsegment END AS customer_name, 'M' || c_nationkey AS model,
        (2010 + c_custkey % 12)::INT AS manufacturing_year, c_mktsegment AS vehicle_type,
        (['obd_solution', 'obd_analog_solution', 'obd_fuel+fuel_solution', 'gps_only'])[c_custkey % 4 + 1] AS solutionType
        FROM customer""",
    "vm": "SELECT * FROM profile WHERE solutionType IN ('obd_solution', 'obd_analog_solution', 'obd_fuel+fuel_solution')",
    "dm": f"""SELECT {CODE('p_partkey')} AS dtc_code,
        (['Engine', 'Emission Control', 'Safety', 'Electrical', 'nan', 'None'])[p_partkey % 6 + 1] AS system,
        (['Powertrain', 'Coolant', 'Emission', 'Electrical', 'None'])[p_partkey % 5 + 1] AS subsystem,
        p_name AS description, p_type AS primary_cause, p_brand AS symptoms, p_size % 5 AS severity_level,
        p_retailprice / 1000 AS estimated_repair_hours, p_size % 2 AS driver_related,
        CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Inspect ' || p_name END AS action_required
        FROM part WHERE p_partkey <> 12""",
    "exploded": f"""SELECT vm.clientLoginId, h.uniqueid, vm.vehicle_number, h.ts, h.dtc_code, coalesce(h.lat, 0) AS lat,
        coalesce(h.lng, 0) AS lng, coalesce(h.pgn, '') AS dtc_pgn
        FROM (SELECT *, unnest(codes) AS dtc_code FROM history) h JOIN vm USING (uniqueid)
        WHERE h.ts > {SINCE} AND h.ts <= {AS_OF} AND h.dtc_code <> '0'""",
    "secs": "SELECT uniqueid, dtc_code, ts, count(*) AS n FROM exploded GROUP BY ALL",
    "lagged": "SELECT *, lag(ts, 1, 0) OVER (PARTITION BY uniqueid, dtc_code ORDER BY ts) AS prev_ts FROM secs",
    "bounded": """SELECT l.*, CASE WHEN prev_ts > 0 AND EXISTS (SELECT 1 FROM cyc c WHERE c.uniqueid = l.uniqueid
        AND c.cycle_ts > l.prev_ts AND c.cycle_ts <= l.ts) THEN 1 ELSE 0 END AS has_boundary FROM lagged l""",
    "broken": f"""SELECT *, CASE WHEN prev_ts = 0 OR ts - prev_ts > {GAP} OR has_boundary = 1 THEN 1 ELSE 0 END AS is_break
        FROM bounded""",
    "numbered": "SELECT *, sum(is_break) OVER (PARTITION BY uniqueid, dtc_code ORDER BY ts)::BIGINT AS episode_no FROM broken",
    "epi": """SELECT uniqueid, dtc_code, episode_no, min(ts) AS first_ts, max(ts) AS last_ts, sum(n)::BIGINT AS occurrence_count
        FROM numbered GROUP BY ALL""",
    "maxcyc": "SELECT uniqueid, max(cycle_ts) AS max_cycle_ts FROM cyc GROUP BY ALL",
    "resolved": f"""SELECT e.*, greatest(0, last_ts - first_ts) AS resolution_time_sec,
        CASE WHEN last_ts <= {CUTOFF_TS} AND coalesce(m.max_cycle_ts, 0) > last_ts THEN 1 ELSE 0 END AS is_resolved,
        coalesce(first_ts - lag(last_ts) OVER (PARTITION BY uniqueid, dtc_code ORDER BY first_ts), 0)
        AS gap_from_previous_episode FROM epi e LEFT JOIN maxcyc m USING (uniqueid)""",
    "epcount": "SELECT uniqueid, dtc_code, count(*) AS ep_count FROM epi GROUP BY ALL",
    "risk": f"""SELECT r.uniqueid, sum({sev('coalesce(dm.severity_level, 1)')} * {dur('r.resolution_time_sec')}
        * {rec('c.ep_count')}) AS risk FROM resolved r LEFT JOIN dm USING (dtc_code)
        JOIN epcount c ON c.uniqueid = r.uniqueid AND c.dtc_code = r.dtc_code WHERE is_resolved = 0 GROUP BY ALL""",
    "during": """SELECT e.uniqueid, e.dtc_code, e.episode_no, count(*) AS n FROM epi e JOIN cyc c ON c.uniqueid = e.uniqueid
        AND c.cycle_ts >= e.first_ts AND c.cycle_ts <= e.last_ts GROUP BY ALL""",
    "vfm": f"""SELECT r.uniqueid || '_' || r.dtc_code || '_' || r.episode_no AS episode_id, vm.clientLoginId, r.uniqueid,
        vm.vehicle_number, vm.customer_name, vm.model, vm.manufacturing_year, r.dtc_code,
        coalesce(nullif(nullif(dm.system, 'nan'), 'None'), '') AS system,
        coalesce(nullif(nullif(dm.subsystem, 'nan'), 'None'), '') AS subsystem,
        coalesce(nullif(dm.description, 'nan'), '') AS description,
        greatest(coalesce(dm.severity_level, 1), 1) AS severity_level, r.first_ts, r.last_ts,
        CAST(make_timestamp(r.first_ts * 1000000) AS DATE) AS event_date, r.occurrence_count, r.resolution_time_sec,
        r.is_resolved, '' AS resolution_reason, r.gap_from_previous_episode, coalesce(d.n, 0) AS engine_cycles_during,
        coalesce(dm.driver_related, 0) AS driver_related,
        CASE WHEN coalesce(dm.subsystem, '') ILIKE '%powertrain%' OR coalesce(dm.system, '') ILIKE '%engine%' THEN 1 ELSE 0 END AS has_engine_issue,
        CASE WHEN coalesce(dm.subsystem, '') ILIKE '%coolant%' THEN 1 ELSE 0 END AS has_coolant_issue,
        CASE WHEN coalesce(dm.system, '') ILIKE '%safety%' THEN 1 ELSE 0 END AS has_safety_issue,
        CASE WHEN coalesce(dm.subsystem, '') ILIKE '%emission%' OR coalesce(dm.system, '') ILIKE '%emission%' THEN 1 ELSE 0 END AS has_emission_issue,
        CASE WHEN coalesce(dm.subsystem, '') ILIKE '%electrical%' OR coalesce(dm.system, '') ILIKE '%electrical%' THEN 1 ELSE 0 END AS has_electrical_issue,
        {score('risk.risk')} AS vehicle_health_score
        FROM resolved r JOIN vm USING (uniqueid) LEFT JOIN dm ON dm.dtc_code = r.dtc_code
        LEFT JOIN risk ON risk.uniqueid = r.uniqueid
        LEFT JOIN during d ON d.uniqueid = r.uniqueid AND d.dtc_code = r.dtc_code AND d.episode_no = r.episode_no""",
    "vfmc": """SELECT f.*, count(*) OVER (PARTITION BY uniqueid, dtc_code) AS ep_count FROM vfm f""",
    "vcode_mode": """SELECT clientLoginId, uniqueid, dtc_code AS top FROM (SELECT *, row_number() OVER
        (PARTITION BY clientLoginId, uniqueid ORDER BY s DESC, dtc_code) AS rn FROM
        (SELECT clientLoginId, uniqueid, dtc_code, sum(occurrence_count) AS s FROM vfm GROUP BY ALL)) WHERE rn = 1""",
    "tcode_mode": """SELECT clientLoginId, dtc_code AS top FROM (SELECT *, row_number() OVER
        (PARTITION BY clientLoginId ORDER BY s DESC, dtc_code) AS rn FROM
        (SELECT clientLoginId, dtc_code, sum(occurrence_count) AS s FROM vfm GROUP BY ALL)) WHERE rn = 1""",
    "tsys_mode": """SELECT clientLoginId, system AS top FROM (SELECT *, row_number() OVER
        (PARTITION BY clientLoginId ORDER BY s DESC, system) AS rn FROM
        (SELECT clientLoginId, system, sum(occurrence_count) AS s FROM vfm GROUP BY ALL)) WHERE rn = 1""",
    "fstats": f"""SELECT clientLoginId, count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS active_veh,
        count(DISTINCT uniqueid) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_veh,
        count(*) FILTER (driver_related = 1) AS driver_faults,
        sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} * {dur('resolution_time_sec')} * {rec('ep_count')} ELSE 0 END) AS risk_sum,
        count(*) FILTER (is_resolved = 0 AND event_date >= {TODAY} - 7) AS recent_active,
        count(*) FILTER (is_resolved = 0 AND event_date >= {TODAY} - 14 AND event_date < {TODAY} - 7) AS prior_active
        FROM vfmc GROUP BY ALL""",
    "fhs": f"""SELECT a.clientLoginId, a.total AS total_vehicles, coalesce(s.active_veh, 0) AS vehicles_with_active_faults,
        coalesce(s.critical_veh, 0) AS vehicles_with_critical_faults, coalesce(s.driver_faults, 0) AS driver_related_faults,
        CASE WHEN coalesce(s.active_veh, 0) > 0 THEN {score('s.risk_sum / s.active_veh')} ELSE 100 END AS fleet_health_score,
        coalesce(c.top, '') AS most_common_dtc, coalesce(y.top, '') AS most_common_system,
        CASE WHEN coalesce(recent_active, 0) > coalesce(prior_active, 0) * 1.1 + 1 THEN 'increasing'
             WHEN coalesce(prior_active, 0) > 0 AND coalesce(recent_active, 0) < coalesce(prior_active, 0) * 0.9 THEN 'decreasing'
             ELSE 'stable' END AS active_fault_trend
        FROM (SELECT clientLoginId, count(*) AS total FROM vm GROUP BY ALL) a LEFT JOIN fstats s USING (clientLoginId)
        LEFT JOIN tcode_mode c USING (clientLoginId) LEFT JOIN tsys_mode y USING (clientLoginId)""",
    "distribution": """SELECT clientLoginId, dtc_code, min(description) AS description, min(system) AS system,
        min(subsystem) AS subsystem, min(severity_level) AS severity_level, count(DISTINCT uniqueid) AS vehicles_affected,
        count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS active_vehicles, sum(occurrence_count)::BIGINT AS total_occurrences,
        count(*) AS total_episodes, coalesce(avg(resolution_time_sec) FILTER (resolution_time_sec > 0), 0) AS avg_resolution_time,
        count(*) FILTER (driver_related = 1) AS driver_related_count FROM vfm GROUP BY clientLoginId, dtc_code""",
    "systems": f"""SELECT clientLoginId, CASE WHEN system IN ('', 'nan') THEN 'other' ELSE system END AS system,
        count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS vehicles_affected, count(*) FILTER (is_resolved = 0) AS active_faults,
        count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_faults,
        sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} ELSE 0 END) AS risk_score, 'stable' AS trend
        FROM vfm GROUP BY ALL""",
    "trends": f"""SELECT clientLoginId, event_date AS date, count(*) FILTER (is_resolved = 0) AS active_faults,
        count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical_faults, count(*) AS new_faults,
        count(*) FILTER (is_resolved = 1) AS resolved_faults, count(*) FILTER (driver_related = 1) AS driver_related_faults,
        {score(f"(sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} ELSE 0 END) / greatest(count(DISTINCT uniqueid) FILTER (is_resolved = 0), 1))")}
        AS fleet_health_score FROM vfm GROUP BY clientLoginId, event_date""",
    "vstats": f"""SELECT clientLoginId, uniqueid, count(*) FILTER (is_resolved = 0) AS active,
        count(*) FILTER (is_resolved = 0 AND severity_level >= 3) AS critical, count(*) AS total_eps,
        count(*) FILTER (first_ts >= {D30}) AS last_30,
        coalesce(avg(resolution_time_sec) FILTER (resolution_time_sec > 0), 0) AS avg_res, max(last_ts) AS last_ts,
        count(*) FILTER (driver_related = 1) AS driver_faults, max(has_engine_issue) AS e, max(has_emission_issue) AS m,
        max(has_safety_issue) AS s, max(has_electrical_issue) AS l,
        sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} * {dur('resolution_time_sec')} * {rec('ep_count')} ELSE 0 END) AS risk
        FROM vfmc GROUP BY clientLoginId, uniqueid""",
    "vhs": f"""SELECT vm.clientLoginId, vm.uniqueid, vm.vehicle_number, vm.customer_name, coalesce(active, 0) AS active_fault_count,
        coalesce(critical, 0) AS critical_fault_count, coalesce(total_eps, 0) AS total_episodes,
        coalesce(last_30, 0) AS episodes_last_30_days, coalesce(avg_res, 0)::DOUBLE AS avg_resolution_time,
        coalesce(last_ts, 0) AS last_fault_ts, {score('risk')} AS vehicle_health_score,
        coalesce(driver_faults, 0) AS driver_related_faults, coalesce(top, '') AS most_common_dtc,
        coalesce(e, 0) AS has_engine_issue, coalesce(m, 0) AS has_emission_issue, coalesce(s, 0) AS has_safety_issue,
        coalesce(l, 0) AS has_electrical_issue
        FROM vm LEFT JOIN vstats USING (clientLoginId, uniqueid) LEFT JOIN vcode_mode USING (clientLoginId, uniqueid)""",
    "impact": f"""SELECT clientLoginId, dtc_code, min(system) AS system, min(subsystem) AS subsystem,
        count(DISTINCT uniqueid) AS vehicles_affected, count(DISTINCT uniqueid) FILTER (is_resolved = 0) AS active_vehicles,
        coalesce(avg(resolution_time_sec) FILTER (resolution_time_sec > 0), 0) AS avg_resolution_time,
        (count(*) FILTER (driver_related = 1))::DOUBLE / count(*) AS driver_related_ratio,
        sum(CASE WHEN is_resolved = 0 THEN {sev('severity_level')} ELSE 0 END) AS fleet_risk_score
        FROM vfm GROUP BY clientLoginId, dtc_code""",
    "candidates": f"""SELECT f.clientLoginId, f.uniqueid, f.vehicle_number, f.dtc_code, f.description, f.severity_level,
        f.resolution_time_sec AS fault_duration_sec, coalesce(r.eps, 0) AS episodes_last_30_days,
        {sev('f.severity_level')} * {dur('f.resolution_time_sec')} * (1 + coalesce(r.eps, 0)) AS maintenance_priority_score,
        coalesce(dm.action_required, '') AS recommended_action
        FROM vfm f LEFT JOIN (SELECT uniqueid, dtc_code, count(*) AS eps FROM vfm WHERE first_ts >= {D30} GROUP BY ALL) r
        USING (uniqueid, dtc_code) LEFT JOIN dm ON dm.dtc_code = f.dtc_code WHERE f.is_resolved = 0""",
    "maintenance": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY clientLoginId, uniqueid, dtc_code
        ORDER BY maintenance_priority_score DESC, fault_duration_sec DESC) AS rn FROM candidates) WHERE rn = 1""",
    "vcodes": "SELECT DISTINCT uniqueid, dtc_code FROM vfm",
    "vtotals": """SELECT uniqueid, min(clientLoginId) AS clientLoginId, count(*) AS episodes, max(last_ts) AS last_ts,
        count(DISTINCT dtc_code) AS codes FROM vfm GROUP BY uniqueid""",
    "cooccurrence": """SELECT min(t.clientLoginId) AS clientLoginId, a.dtc_code AS dtc_code_a, b.dtc_code AS dtc_code_b,
        sum(t.episodes)::BIGINT AS cooccurrence_count, count(*) AS vehicles_affected, 0::DOUBLE AS avg_time_gap_sec,
        max(t.last_ts) AS last_seen_ts FROM vcodes a JOIN vcodes b ON a.uniqueid = b.uniqueid AND a.dtc_code < b.dtc_code
        JOIN vtotals t ON t.uniqueid = a.uniqueid GROUP BY a.dtc_code, b.dtc_code HAVING count(*) >= 2""",
    # gap-only batch variant
    "bsecs": "SELECT uniqueid, dtc_code, ts, count(*) AS n FROM exploded GROUP BY ALL",
    "bnum": f"""SELECT *, sum(CASE WHEN p IS NULL OR ts - p > {GAP} THEN 1 ELSE 0 END) OVER
        (PARTITION BY uniqueid, dtc_code ORDER BY ts)::BIGINT AS episode_no FROM
        (SELECT *, lag(ts) OVER (PARTITION BY uniqueid, dtc_code ORDER BY ts) AS p FROM bsecs)""",
    "bepi": """SELECT uniqueid, dtc_code, episode_no, min(ts) AS first_ts, max(ts) AS last_ts, sum(n)::BIGINT AS occurrences
        FROM bnum GROUP BY ALL""",
    "bnext": """SELECT *, lead(first_ts) OVER (PARTITION BY uniqueid, dtc_code ORDER BY first_ts) AS next_first,
        (SELECT max(ts) FROM exploded) AS newest FROM bepi""",
    "bres": f"""SELECT uniqueid, dtc_code, episode_no, first_ts, last_ts, occurrences, last_ts - first_ts AS persistence_sec,
        CASE WHEN found AND last_ts <= greatest(0, newest - 259200) THEN 1 ELSE 0 END AS is_resolved,
        CASE WHEN last_ts > greatest(0, newest - 259200) THEN 'recent_window_ambiguous'
             WHEN found THEN 'engine_cycle_no_reappearance' ELSE '' END AS resolution_reason,
        CAST(make_timestamp(first_ts * 1000000) AS DATE) AS event_date,
        ('0x' || substr(sha1(uniqueid || '|' || dtc_code || '|' || first_ts || '|' || episode_no), 1, 15))::BIGINT AS episode_id
        FROM (SELECT *, EXISTS (SELECT 1 FROM cyc c WHERE c.uniqueid = b.uniqueid AND c.cycle_ts > b.last_ts
              AND (b.next_first IS NULL OR c.cycle_ts < b.next_first)) AS found FROM bnext b)""",
    # assistant traces
    "tr": f"""SELECT conv_id::INT AS c, turn::INT AS t, role, text AS x, length(text) AS len, 'R' || conv_id || '-' || turn AS rid,
        1704067200 + conv_id * 3600 + turn * 60 AS ts,
        CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'pc' || (conv_id % 3) END AS customer_name,
        CASE WHEN turn % 2 = 0 THEN 'q: ' || role ELSE 'in: ' || role END AS query,
        CASE WHEN (conv_id + turn) % 5 = 4 THEN 'fleet_health' ELSE {pick(T.INTENTS, 'conv_id + turn')} END AS intent,
        coalesce(quality, 0.5)::DOUBLE AS correctness, coalesce(quality, 0.5)::DOUBLE * 0.5 + 0.25 AS completeness,
        0.5 + (turn % 4)::DOUBLE / 10 AS relevance, coalesce(1 - toxic, 0.5)::DOUBLE AS groundedness,
        {pick(T.CAUSES, 'conv_id + turn')} AS root_cause, CASE WHEN conv_id % 2 = 0 THEN 'llm' ELSE 'heuristic' END AS judge_mode,
        'r' || (conv_id % 2) AS release_version, CASE WHEN conv_id % 3 = 0 THEN 'dev' ELSE 'prod' END AS env_name,
        (len % 50)::DOUBLE / 10 AS latency_sec,
        CASE (conv_id + turn) % 10 WHEN 0 THEN ['context_length_exceeded'] WHEN 1 THEN ['x'] ELSE []::VARCHAR[] END AS reasons
        FROM conversations LEFT JOIN labels ON doc_id = conv_id""",
    "tfinal": """SELECT *, round(0.30 * round(correctness, 3) + 0.25 * round(groundedness, 3) + 0.20 * round(relevance, 3)
        + 0.25 * round(completeness, 3), 3)::DOUBLE AS final_score FROM tr""",
    "tev": f"""SELECT *, CASE WHEN (c + p) % 7 = 0 THEN 'sql' ELSE 'node' END AS type, {pick(T.NODES, 'p')} AS node,
        (len % 100 + p)::DOUBLE / 100 AS duration, t + p AS row_count,
        CASE WHEN (c + p) % 5 = 0 THEN 'error' ELSE 'success' END AS status,
        CASE WHEN p % 2 = 0 THEN 'cust' || (c % 4) ELSE customer_name END AS e_customer,
        CASE WHEN p % 3 = 0 THEN 'fleet' ELSE 'vehicle' END AS e_mode,
        CASE WHEN (c + t + p) % 9 = 0 THEN 1 ELSE 0 END AS sql_errors_delta,
        CASE WHEN (c + p) % 6 = 0 THEN 0 ELSE 1 END AS tool_called,
        CASE WHEN p = 0 AND (c + t) % 5 = 2 THEN 1 ELSE 0 END AS intent_is_unknown,
        CASE WHEN (c + p) % 11 = 0 THEN NULL ELSE ((c * 7 + p * 13 + t) % 100)::DOUBLE / 100 END AS score
        FROM (SELECT *, unnest(range(0, t % 8 + 1)) AS p FROM tfinal)""",
    "tnode": "SELECT * FROM tev WHERE type = 'node'",
    "tsql": f"""SELECT *, {pick(T.TOOLS, 'c + q')} AS tool, {pick(T.QUERIES, 'c + q')} AS sql_text,
        CASE WHEN (c + t + q) % 4 <> 0 THEN 1 ELSE 0 END AS success, (c * q + t) % 5 AS row_count,
        (q + 1)::DOUBLE / 10 AS duration_sec FROM (SELECT *, unnest(range(0, t % 3 + 1)) AS q FROM tfinal)""",
    "ttool": f"""SELECT *, CASE WHEN q < 2 THEN ((c + q) % 4)::INT END AS fix,
        CASE WHEN (c + q) % 2 = 0 THEN sql_text END AS generated_query,
        CASE WHEN success = 0 THEN 'bad' END AS err, (c + q) % 3 AS data_rows, (c + q) % 5 = 0 AS has_section FROM tsql""",
    "tplan": "SELECT * FROM ttool WHERE q = 0 OR generated_query IS NOT NULL OR fix IS NOT NULL OR c % 2 = 0",
    "tprompt": f"""SELECT *, unnest({lst(T.PROMPTS)}) AS prompt_key,
        unnest([{', '.join(f"'v' || ((c + {i}) % 3)" for i in range(len(T.PROMPTS)))}]) AS prompt_version FROM tfinal""",
    "tpscore": f"""SELECT e.*, m.prompt_key, 'v' || ((c + m.i) % 3) AS prompt_version FROM tev e JOIN (VALUES
        {', '.join(f"('{n}', '{k}', {i})" for i, (n, k) in enumerate(T.NODE_TO_PROMPT.items()))}) m(node, prompt_key, i)
        ON m.node = e.node WHERE e.score IS NOT NULL""",
    "cohorts": """SELECT prompt_key, prompt_version, avg(score) AS avg_node_score, avg(final_score) AS avg_final_score,
        count(*) AS runs FROM tpscore GROUP BY ALL HAVING count(*) >= 3""",
    "buckets": """SELECT prompt_key, prompt_version, root_cause, count(*) AS runs, avg(score) AS avg_node_score FROM tpscore
        WHERE score < 0.7 GROUP BY ALL""",
    # evaluation
    "q0": f"""SELECT *, {pick(T.DATASETS, 'c')} AS dataset, {pick(T.INTENTS[:4], 'c')} AS expected_intent,
        CASE WHEN c % 6 = 0 THEN []::VARCHAR[] ELSE list_distinct([{pick(T.TOOLS, 'c')}, {pick(T.TOOLS, 'c + t')}]) END AS want,
        list_distinct(list_transform(range(0, t % 3 + 1), lambda q: {pick(T.TOOLS, 'c + q')})) AS got,
        ({lst(T.KEYWORDS)})[1:(t % 5)] AS kws FROM tfinal""",
    "q1": """SELECT *, len(list_intersect(want, got)) AS n_both, CASE WHEN intent = expected_intent THEN 1 ELSE 0 END AS intent_match,
        CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda k: contains(lower(x), k)))::DOUBLE / len(kws) ELSE 1 END AS hits FROM q0""",
    "q2": """SELECT *, CASE WHEN len(want) > 0 THEN n_both::DOUBLE / len(want) ELSE 1 END AS r,
        CASE WHEN len(got) > 0 THEN n_both::DOUBLE / len(got) ELSE 1 END AS pr FROM q1""",
    "q3": """SELECT rid, count(*) AS n_sql, sum(success)::DOUBLE / count(*) AS ok,
        (count(*) FILTER (lower(trim(sql_text)) LIKE 'select%' OR lower(trim(sql_text)) LIKE 'with%'))::DOUBLE / count(*) AS shape
        FROM tsql GROUP BY rid""",
    "q4": """SELECT rid, count(*) AS n_nodes, sum(duration) AS total, max(duration) AS top FROM tnode GROUP BY rid""",
    "scored": """SELECT q2.rid AS id, dataset, expected_intent, intent AS actual_intent, intent_match,
        round(r, 3) AS tool_recall, round(pr, 3) AS tool_precision,
        round(CASE WHEN pr + r > 0 THEN 2 * pr * r / (pr + r) ELSE 0 END, 3) AS tool_f1, round(hits, 3) AS keyword_hits,
        round(hits, 3) AS correctness, round(0.6 * intent_match + 0.4 * hits, 3) AS relevance,
        round(0.5 * hits + 0.5 * r, 3) AS completeness, greatest(0, round(1 - (0.6 * hits + 0.4 * r), 3)) AS hallucination_risk,
        n_sql AS sql_query_count, round(ok, 3) AS sql_success_rate, round(r, 3) AS sql_tool_alignment,
        round(shape, 3) AS sql_shape_validity, round(0.7 * r + 0.3 * shape, 3) AS sql_relevance_score, 'heuristic' AS judge_mode,
        latency_sec, len AS tokens_prompt, len // 2 AS tokens_completion, coalesce(n_nodes, 0) AS node_events_count,
        round(coalesce(total, 0), 3) AS node_latency_total_sec, round(coalesce(total / n_nodes, 0), 3) AS node_latency_avg_sec,
        round(coalesce(top, 0), 3) AS node_latency_max_sec, reasons, len + len // 2 AS tokens_total, len(got) AS n_tools
        FROM q2 JOIN q3 USING (rid) LEFT JOIN q4 USING (rid)""",
    # conversations
    "conv": """SELECT conv_id::VARCHAR AS conversation_id, ' Fleet' || ((conv_id + turn) % 4) || ' ' AS customer_name, turn,
        1704067200 + conv_id * 3600 + turn * 60 AS created_ts, conv_id FROM conversations""",
    "creq": """SELECT CASE WHEN conv_id % 4 = 0 THEN 'new-' ELSE '' END || conv_id AS conversation_id, 'fleet' || (conv_id % 3) AS customer_name,
        CASE WHEN turn % 2 = 0 THEN 'fleet' ELSE 'general' END AS mode, 1704067200 + conv_id * 3600 + turn * 60 AS created_ts,
        turn, text AS query_text, conv_id FROM conversations""",
    "msg": """SELECT conv_id::VARCHAR AS conversation_id, turn::INT AS message_index, role, text AS content,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations""",
}


def sql(body: str) -> str:
    """``body`` with the sub-queries it refers to, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = [f"{n} AS ({CTES[n]})" for n in needed]
    if not parts:
        return nudged(body)
    own = re.match(r"\s*WITH\s+", body)
    joined = ",\n".join(parts)
    return nudged(f"WITH {joined},\n{body[own.end():]}" if own else f"WITH {joined}\n{body}")


NUDGE = "1.37e-9"


def nudged(text: str) -> str:
    """Four-digit roundings move exact ties off the boundary, as ``plain`` does:
    two sums of the same numbers may differ in the last bit."""
    out, i = [], 0
    while True:
        j = text.find("round(", i)
        if j < 0:
            return "".join(out) + text[i:]
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        inner = text[j + 6:k - 1]
        out.append(text[i:j])
        if inner.rstrip().endswith(", 4"):
            out.append(f"round(({nudged(inner.rstrip()[:-3])}) + {NUDGE}::DOUBLE, 4)")
        else:
            # coarser roundings settle the last bits first, as the engine does
            digits = re.search(r",\s*(\d)\s*$", inner)
            value = nudged(inner[:digits.start()])
            out.append(f"round(round({value}, 9), {digits.group(1)})")
        i = k
