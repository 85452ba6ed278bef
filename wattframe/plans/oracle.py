"""The registered queries as SQL over the same tables, for checking.

Written against the raw tables with plain windows and joins, so it shares no code with the
queries it checks.
"""

from __future__ import annotations

import re

FEATURES = (
    "cpu_time_ns", "ctx_switches", "cpu_freq_mhz", "major_faults", "minor_faults", "rss_bytes", "gpu_active_ns",
)

VIEWS = {
    "tele": """
SELECT event_id, ts, epoch_us(ts) AS ts_us, user_id % 4 AS host_id, user_id AS pid,
  user_id % 50 AS tgid, event_id % 4 AS cpu_id, k, probe_kind AS event_kind,
  CAST(epoch_us(ts) AS HUGEINT) * 1000000000000 + event_id AS pos,
  CASE WHEN probe_kind IN ('switch','exec') THEN 'cpu' WHEN probe_kind = 'gpu_submit' THEN 'gpu' ELSE 'mem' END AS probe,
  CASE WHEN k % 10 = 9 THEN '' ELSE
    CASE (user_id + k % 2) % 8 WHEN 0 THEN 'python3' WHEN 1 THEN 'torch' WHEN 2 THEN 'node' WHEN 3 THEN 'postgres'
      WHEN 4 THEN 'ollama' WHEN 5 THEN 'nginx' WHEN 6 THEN 'vllm' ELSE 'bash' END END AS comm,
  CASE WHEN probe_kind = 'switch' THEN CAST(ROUND(value * 100) AS BIGINT) * 10000 ELSE CAST(0 AS BIGINT) END AS delta_ns,
  CAST(k % 2 AS BIGINT) AS prev_state, CAST(k AS BIGINT) AS error_code,
  CASE user_id % 7 WHEN 0 THEN 'us' WHEN 1 THEN 'eu' WHEN 2 THEN 'fr' WHEN 3 THEN 'in' WHEN 4 THEN 'cn' ELSE 'other' END AS region
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        CASE event_type WHEN 'click' THEN 'switch' WHEN 'signup' THEN 'exec' WHEN 'view' THEN 'fault_user'
          WHEN 'error' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN 'reclaim' ELSE 'fault_kernel' END
          ELSE 'gpu_submit' END AS probe_kind
      FROM events) e""",
    "tele_sched": """
SELECT event_id, ts, ts_us, cpu_id, prev_state, pid AS next_pid,
  CASE WHEN k % 20 = 0 THEN CAST(-1 AS BIGINT)
       ELSE coalesce(lag(pid) OVER (PARTITION BY cpu_id ORDER BY ts, event_id), CAST(0 AS BIGINT)) END AS prev_pid
FROM tele""",
    "tele_cgroup": """
SELECT host_id, pid,
  concat('0::/', chr(10), '12:devices:', CASE pid % 6
    WHEN 0 THEN concat('/docker/', cid)
    WHEN 1 THEN concat('/kubepods.slice/cri-containerd-', cid, '.scope')
    WHEN 2 THEN concat('/machine.slice/libpod-', cid, '.scope')
    WHEN 3 THEN concat('/system.slice/svc-', cid, '.scope')
    WHEN 4 THEN concat('/custom/', cid)
    ELSE '/' END, chr(10)) AS cgroup_text,
  CASE pid % 4 WHEN 0 THEN 'max' WHEN 1 THEN '9223372036854771712' WHEN 2 THEN ' 536870912 ' ELSE '1048576' END AS mem_limit_text
FROM (SELECT DISTINCT host_id, pid, concat(md5(concat('c', CAST(pid % 20 AS STRING))), md5(concat('d', CAST(pid % 20 AS STRING)))) AS cid FROM tele) p""",
    "tele_captures": """
SELECT event_id, ts_us, host_id, pid,
  CASE WHEN pid % 6 = 5 THEN '' ELSE left(md5(concat('c', CAST((pid + event_id % 3) % 20 AS STRING))), 12) END AS id
FROM tele WHERE k % 5 = 2""",
    "pid_marks": """
SELECT *, lead(rank) OVER w AS next_rank, lead(id) OVER w AS next_id, row_number() OVER w AS nth
FROM (SELECT DISTINCT host_id, pid, ts_us, 0 AS rank, CAST(NULL AS VARCHAR) AS id FROM tele WHERE event_kind = 'exec'
      UNION ALL
      SELECT host_id, pid, ts_us, 1, arg_max(id, event_id) FROM tele_captures GROUP BY host_id, pid, ts_us) m
WINDOW w AS (PARTITION BY host_id, pid ORDER BY ts_us, rank)""",
    "pid_versions": """
SELECT host_id, pid, valid_us, arg_max(id, rank) AS container_id
FROM (SELECT host_id, pid, ts_us AS valid_us, rank,
        CASE WHEN rank = 1 THEN id WHEN next_rank = 1 THEN next_id ELSE '' END AS id FROM pid_marks
      UNION ALL
      SELECT host_id, pid, CAST(-4611686018427387904 AS BIGINT), 1, id FROM pid_marks WHERE nth = 1 AND rank = 1) v
GROUP BY host_id, pid, valid_us""",
    "tele_inventory": """
SELECT c, concat('[{"Id":"', md5(concat('c', CAST(c AS STRING))), md5(concat('d', CAST(c AS STRING))),
  '","Names":["/svc-', CAST(c AS STRING), '"],"Image":"img-', CAST(c % 3 AS STRING), '","Labels":{',
  CASE WHEN c % 2 = 0 THEN concat('"io.kubernetes.pod.name":"pod-', CAST(c AS STRING), '","io.kubernetes.pod.namespace":"ns-', CAST(c % 4 AS STRING), '"') ELSE '' END,
  '}}]') AS doc
FROM (SELECT DISTINCT pid % 20 AS c FROM tele) i WHERE c < 15""",
    "tele_inventory_hist": """
SELECT d AS snapshot_ts, substr(md5(concat('c', CAST(c AS STRING))), 1, 12) AS short_id,
  concat('svc-', CAST(c AS STRING), '-', substr(CAST(d AS STRING), 1, 10)) AS name
FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM tele) a
CROSS JOIN (SELECT DISTINCT pid % 20 AS c FROM tele) b WHERE c < 15""",
    "tele_calibration": """
SELECT event_id, cpu_time_ns, ctx_switches, cpu_freq_mhz, major_faults, minor_faults, rss_bytes, gpu_active_ns,
  CAST(5.0e-9 AS DOUBLE) * cpu_time_ns + CAST(1.0e-5 AS DOUBLE) * ctx_switches + CAST(2.0e-4 AS DOUBLE) * cpu_freq_mhz
  + CAST(5.0e-4 AS DOUBLE) * major_faults + CAST(5.0e-7 AS DOUBLE) * minor_faults + CAST(1.0e-12 AS DOUBLE) * rss_bytes
  + CAST(3.0e-7 AS DOUBLE) * gpu_active_ns + CAST((event_id * 13) % 101 - 50 AS DOUBLE) / 10 AS energy_joules
FROM (SELECT event_id, CAST(CAST(ROUND(value * 100) AS BIGINT) * 10000 AS DOUBLE) AS cpu_time_ns,
  CAST(CAST(json_extract_string(props, '$.k') AS INT) + 1 AS DOUBLE) AS ctx_switches,
  CAST(800 + (user_id * 37) % 3700 AS DOUBLE) AS cpu_freq_mhz,
  CAST((event_id * 7) % 100 AS DOUBLE) AS major_faults, CAST((event_id * 31) % 49999 AS DOUBLE) AS minor_faults,
  CAST(1000000 + ((event_id * 7919) % 7993) * 1000000 AS DOUBLE) AS rss_bytes,
  CAST(((event_id * 104729) % 499) * 1000000 AS DOUBLE) AS gpu_active_ns FROM events) f""",
    "registry": """
SELECT DISTINCT date_trunc('hour', ts) AS interval_start,
  (epoch_us(date_trunc('hour', ts)) // 3600000000) % 5 < 3 AS available
FROM events""",
    "partial": """
SELECT event_id, ts, ts_us, pos, host_id, pid, tgid, probe, comm, region,
  CASE WHEN probe = 'cpu' THEN delta_ns ELSE CAST(0 AS BIGINT) END AS cpu_time_ns,
  CAST(CASE WHEN probe = 'cpu' THEN 1 ELSE 0 END AS BIGINT) AS ctx_switches,
  CAST(0 AS BIGINT) AS major_faults,
  CAST(CASE WHEN probe = 'mem' THEN 1 ELSE 0 END AS BIGINT) AS minor_faults,
  CAST(CASE WHEN probe = 'gpu' THEN 1 ELSE 0 END AS BIGINT) AS gpu_jobs_submitted,
  CAST(0 AS BIGINT) AS gpu_active_ns
FROM tele""",
    "vectors": """
SELECT date_trunc('hour', ts) AS "interval", host_id, pid, any_value(region) AS region,
  coalesce(arg_max(comm, pos) FILTER (WHERE comm <> ''), '') AS comm,
  CAST(sum(cpu_time_ns) AS BIGINT) AS cpu_time_ns, CAST(sum(ctx_switches) AS BIGINT) AS ctx_switches,
  CAST(sum(major_faults) AS BIGINT) AS major_faults, CAST(sum(minor_faults) AS BIGINT) AS minor_faults,
  CAST(sum(gpu_jobs_submitted) AS BIGINT) AS gpu_jobs_submitted,
  CAST(sum(gpu_active_ns) AS BIGINT) AS gpu_active_ns,
  CAST(max(ts_us) * 1000 AS BIGINT) AS timestamp_ns
FROM partial GROUP BY 1, 2, 3""",
    "nj": """
SELECT *, cpu_time_ns * 5 AS cpu_nj, (major_faults + minor_faults) * 500 AS memory_nj,
  gpu_jobs_submitted * 100000 AS gpu_nj,
  cpu_time_ns * 5 + (major_faults + minor_faults) * 500 + gpu_jobs_submitted * 100000 AS energy_nj
FROM vectors""",
    "heur": """
SELECT *, energy_nj / 1e9 AS energy_joules, cpu_nj / 1e9 AS cpu_energy_joules,
  memory_nj / 1e9 AS memory_energy_joules, gpu_nj / 1e9 AS gpu_energy_joules,
  energy_nj / 1e9 / CAST(1 AS DOUBLE) AS power_watts, energy_nj / 1e9 / 3.6e6 * CAST(475 AS DOUBLE) AS carbon_grams_co2,
  CAST(0.3 AS DOUBLE) AS confidence,
  comm IN ('python','python3','torch','tensorflow','triton','onnxruntime','trtexec','nvidia-smi','ollama','vllm','mlserver','bentoml') AS is_ai_inference
FROM nj""",
    "silent_sessions": """
SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY host_id, pid ORDER BY at_us) AS session
FROM (SELECT host_id, pid, epoch_us("interval") AS at_us, energy_nj,
        coalesce(epoch_us("interval") - lag(epoch_us("interval")) OVER (PARTITION BY host_id, pid ORDER BY "interval") > 72000000000, false) AS fresh
      FROM nj) g""",
    "ids": """
SELECT p.host_id, p.pid, coalesce(f.id, '') AS container_id
FROM tele_cgroup p LEFT JOIN (
  SELECT host_id, pid, left(arg_min(id, n), 12) AS id FROM (
    SELECT host_id, pid, n, coalesce(
      nullif(regexp_extract(path, '/docker/([a-f0-9]{12,64})', 1), ''),
      nullif(regexp_extract(path, '/cri-containerd-([a-f0-9]{12,64})\\.scope', 1), ''),
      nullif(regexp_extract(path, '/libpod-([a-f0-9]{12,64})\\.scope', 1), ''),
      nullif(regexp_extract(path, '-([a-f0-9]{12,64})\\.scope', 1), ''),
      nullif(regexp_extract(path, '([a-f0-9]{64})', 1), '')) AS id
    FROM (SELECT host_id, pid, n, regexp_extract(trim(line), '^[^:]*:[^:]*:(.*)$', 1) AS path
          FROM (SELECT host_id, pid, unnest(string_split(cgroup_text, chr(10))) AS line,
                  unnest(range(len(string_split(cgroup_text, chr(10))))) AS n FROM tele_cgroup) l) s) h
  WHERE id IS NOT NULL GROUP BY 1, 2) f USING (host_id, pid)""",
    "inventory": """
SELECT json_extract_string(doc, '$[0].Id') AS full_id, left(json_extract_string(doc, '$[0].Id'), 12) AS short_id,
  ltrim(json_extract_string(doc, '$[0].Names[0]'), '/') AS name,
  json_extract_string(doc, '$[0].Image') AS image_name,
  coalesce(json_extract_string(doc, '$[0].Labels."io.kubernetes.pod.name"'), '') AS pod_name,
  coalesce(json_extract_string(doc, '$[0].Labels."io.kubernetes.pod.namespace"'), '') AS pod_namespace,
  CAST(len(json_keys(doc, '$[0].Labels')) AS BIGINT) AS label_count
FROM tele_inventory""",
    "attributed": """
SELECT h.*, i.container_id, coalesce(v.name, '') AS container_name, coalesce(v.image_name, '') AS image_name,
  coalesce(v.pod_name, '') AS pod_name, coalesce(v.pod_namespace, '') AS pod_namespace
FROM heur h JOIN ids i USING (host_id, pid) LEFT JOIN inventory v ON v.short_id = i.container_id""",
    "labelled": """
SELECT * REPLACE (coalesce(nullif(container_id, ''), 'host') AS container_id,
  coalesce(nullif(container_name, ''), nullif(container_id, ''), 'host') AS container_name)
FROM attributed""",
    "summary": """
SELECT "interval", CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS total_energy_joules,
  CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS total_power_watts,
  CAST(sum(energy_nj) * 475000 AS DOUBLE) / 1e3 / 1e9 / 3.6e6 AS total_carbon_grams_co2,
  count(*) AS tracked_processes, count(*) FILTER (WHERE is_ai_inference) AS ai_workload_count,
  count(DISTINCT nullif(container_id, '')) AS container_count,
  round(avg(confidence), 9) AS avg_confidence
FROM attributed GROUP BY 1""",
    "z": """
SELECT *, CAST(1.45 AS DOUBLE) * ((CAST(cpu_time_ns AS DOUBLE) - CAST(5.0e8 AS DOUBLE)) / CAST(2.9e8 AS DOUBLE)) AS c0,
  CAST(0.029 AS DOUBLE) * ((CAST(ctx_switches AS DOUBLE) - CAST(5000 AS DOUBLE)) / CAST(2900 AS DOUBLE)) AS c1,
  CAST(0.2136 AS DOUBLE) * ((CAST(cpu_freq_mhz AS DOUBLE) - CAST(2650 AS DOUBLE)) / CAST(1068 AS DOUBLE)) AS c2,
  CAST(0.0145 AS DOUBLE) * ((CAST(major_faults AS DOUBLE) - CAST(50 AS DOUBLE)) / CAST(29 AS DOUBLE)) AS c3,
  CAST(0.0072 AS DOUBLE) * ((CAST(minor_faults AS DOUBLE) - CAST(25000 AS DOUBLE)) / CAST(14400 AS DOUBLE)) AS c4,
  CAST(0.0023 AS DOUBLE) * ((CAST(rss_bytes AS DOUBLE) - CAST(4.0e9 AS DOUBLE)) / CAST(2.3e9 AS DOUBLE)) AS c5,
  CAST(43.2 AS DOUBLE) * ((CAST(gpu_active_ns AS DOUBLE) - CAST(2.5e8 AS DOUBLE)) / CAST(1.44e8 AS DOUBLE)) AS c6
FROM @features""",
    "scored": """
SELECT * EXCLUDE (a_cpu, a_mem, a_gpu, a_all, total), total AS energy_joules,
  CASE WHEN a_all > 0 THEN total * (a_cpu / a_all) ELSE total END AS cpu_energy_joules,
  CASE WHEN a_all > 0 THEN total * (a_mem / a_all) ELSE CAST(0 AS DOUBLE) END AS memory_energy_joules,
  CASE WHEN a_all > 0 THEN total * (a_gpu / a_all) ELSE CAST(0 AS DOUBLE) END AS gpu_energy_joules
FROM (SELECT *, a_cpu + a_mem + a_gpu AS a_all FROM (
  SELECT * EXCLUDE (c0, c1, c2, c3, c4, c5, c6), abs(c0 + c1 + c2) AS a_cpu, abs(c3 + c4 + c5) AS a_mem, abs(c6) AS a_gpu,
    greatest(c0 + c1 + c2 + c3 + c4 + c5 + c6 + CAST(78 AS DOUBLE), CAST(0 AS DOUBLE)) AS total FROM z) a) b""",
    "live_features": """
SELECT *, CAST(0 AS BIGINT) AS cpu_freq_mhz, CAST(0 AS BIGINT) AS rss_bytes FROM vectors""",
    "calibration_features": "SELECT * EXCLUDE (energy_joules) FROM tele_calibration",
    "cpu_plain": """
SELECT host_id, pid, CAST(sum(delta_ns) AS BIGINT) AS total_cpu_time_ns, count(*) AS ctx_switches,
  count(*) FILTER (WHERE prev_state <> 0) AS voluntary_ctx_switches,
  count(*) FILTER (WHERE prev_state = 0) AS involuntary_ctx_switches,
  arg_max(cpu_id, pos) AS last_cpu_id, max(ts_us) * 1000 AS last_seen_ns, arg_min(comm, pos) AS comm
FROM tele WHERE event_kind = 'switch' GROUP BY 1, 2""",
    "cpu_reset": """
SELECT host_id, pid,
  CAST(coalesce(sum(delta_ns) FILTER (WHERE event_kind = 'switch'), 0) AS BIGINT) AS total_cpu_time_ns,
  count(*) FILTER (WHERE event_kind = 'switch') AS ctx_switches,
  count(*) FILTER (WHERE event_kind = 'switch' AND prev_state <> 0) AS voluntary_ctx_switches,
  count(*) FILTER (WHERE event_kind = 'switch' AND prev_state = 0) AS involuntary_ctx_switches,
  arg_max(cpu_id, pos) AS last_cpu_id, max(ts_us) * 1000 AS last_seen_ns, arg_min(comm, pos) AS comm
FROM (SELECT *, max(seg) OVER (PARTITION BY host_id, pid) AS last_seg FROM (
  SELECT *, count(*) FILTER (WHERE event_kind = 'exec') OVER (PARTITION BY host_id, pid ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS seg FROM tele WHERE probe = 'cpu') s) t
WHERE seg = last_seg GROUP BY 1, 2""",
    "classes": """
SELECT *, event_kind = 'fault_kernel' OR (event_kind = 'fault_user' AND error_code % 2 = 1) AS is_major,
  event_kind = 'fault_user' AND error_code % 2 = 0 AS is_minor, event_kind = 'reclaim' AS is_reclaim
FROM tele WHERE probe = 'mem'""",
    "mem_plain": """
SELECT host_id, pid, count(*) FILTER (WHERE is_major) AS major_faults, count(*) FILTER (WHERE is_minor) AS minor_faults,
  count(*) FILTER (WHERE NOT is_reclaim) AS total_faults, count(*) FILTER (WHERE is_reclaim) AS direct_reclaim_count,
  coalesce(max(ts_us) FILTER (WHERE NOT is_reclaim), min(ts_us)) * 1000 AS last_fault_ns,
  count(*) FILTER (WHERE is_minor) AS estimated_rss_pages, arg_min(comm, pos) AS comm
FROM classes GROUP BY 1, 2""",
    "gpu_plain": """
SELECT host_id, pid, count(*) AS total_jobs_submitted, CAST(0 AS BIGINT) AS total_gpu_active_ns,
  max(ts_us) * 1000 AS last_submit_ns, CAST(0 AS BIGINT) AS last_complete_ns, count(*) AS active_jobs,
  arg_min(comm, pos) AS comm
FROM tele WHERE probe = 'gpu' GROUP BY 1, 2""",
    "snap": """
SELECT p.host_id, p.pid, coalesce(nullif(c.comm, ''), m.comm, '') AS comm,
  coalesce(c.total_cpu_time_ns, 0) AS cpu_time_ns, coalesce(c.ctx_switches, 0) AS ctx_switches,
  coalesce(c.voluntary_ctx_switches, 0) AS voluntary_ctx_switches,
  coalesce(c.involuntary_ctx_switches, 0) AS involuntary_ctx_switches, CAST(0 AS BIGINT) AS cpu_freq_mhz,
  coalesce(c.last_cpu_id, 0) AS cpu_id, coalesce(m.major_faults, 0) AS major_faults,
  coalesce(m.minor_faults, 0) AS minor_faults, coalesce(m.estimated_rss_pages, 0) * 4096 AS rss_bytes,
  coalesce(m.direct_reclaim_count, 0) AS direct_reclaim_count,
  coalesce(g.total_jobs_submitted, 0) AS gpu_jobs_submitted, coalesce(g.total_gpu_active_ns, 0) AS gpu_active_ns,
  coalesce(c.last_seen_ns, 0) AS timestamp_ns
FROM (SELECT DISTINCT host_id, pid FROM tele) p LEFT JOIN cpu_reset c USING (host_id, pid)
  LEFT JOIN mem_plain m USING (host_id, pid) LEFT JOIN gpu_plain g USING (host_id, pid)""",
    "fallback_rows": """
SELECT v."interval", v.host_id, v.pid, v.comm, r.available AS by_model,
  CASE WHEN r.available THEN s.energy_joules ELSE v.energy_joules END AS energy_joules,
  CASE WHEN r.available THEN s.cpu_energy_joules ELSE v.cpu_energy_joules END AS cpu_energy_joules,
  CASE WHEN r.available THEN s.memory_energy_joules ELSE v.memory_energy_joules END AS memory_energy_joules,
  CASE WHEN r.available THEN s.gpu_energy_joules ELSE v.gpu_energy_joules END AS gpu_energy_joules,
  CASE WHEN r.available THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence, v.is_ai_inference
FROM heur v JOIN scored s USING ("interval", host_id, pid) JOIN registry r ON r.interval_start = v."interval" """,
    "cum": """
SELECT "interval", host_id, pid, comm, container_id, container_name,
  CAST(sum(energy_nj) OVER w AS DOUBLE) / 1e9 AS energy_joules_total,
  CAST(sum(energy_nj * 475000) OVER w AS DOUBLE) / 1e3 / 1e9 / 3.6e6 AS carbon_grams_co2_total
FROM labelled WINDOW w AS (PARTITION BY host_id, pid, comm, container_id, container_name ORDER BY "interval"
  ROWS UNBOUNDED PRECEDING)""",
    "counter": """
SELECT event_id, ts, ts_us, pos, host_id, pid, CAST(sum(delta_ns) OVER (PARTITION BY host_id, pid, seg ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter_ns
FROM (SELECT *, count(*) FILTER (WHERE event_kind = 'exec') OVER (PARTITION BY host_id, pid ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS seg FROM tele WHERE probe = 'cpu') s""",
    "grown": """
SELECT *, CASE WHEN before_ns IS NULL THEN 0 WHEN counter_ns < before_ns THEN counter_ns
  ELSE counter_ns - before_ns END AS increase
FROM (SELECT *, lag(counter_ns) OVER (PARTITION BY host_id, pid ORDER BY ts, event_id) AS before_ns FROM counter) c""",
    "moments": "SELECT avg(energy_joules) AS y_mean, " + ", ".join(
        f"avg({f}) AS m{i}, stddev_samp({f}) AS s{i}" for i, f in enumerate(FEATURES)
    ) + " FROM tele_calibration",
    # normal equations of the standardised features, right-hand side as the last column
    "equations": "SELECT [" + ", ".join(
        "[" + ", ".join(f"corr({f}, {g})" for g in FEATURES)
        + f", covar_samp({f}, energy_joules) / stddev_samp({f})]" for f in FEATURES
    ) + "] AS m FROM tele_calibration",
    # Gauss-Jordan elimination, one column per step
    "elimination": """
SELECT 0 AS k, m FROM equations
UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1
  THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
  ELSE list_transform(r, lambda v, j: v - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END)
FROM elimination WHERE k < 7""",
    "solution": """
SELECT list_transform(m, lambda r: r[8]) AS c FROM elimination WHERE k = 7""",
    "predicted": "SELECT t.event_id, t.energy_joules, greatest(m.y_mean + " + " + ".join(
        f"s.c[{i + 1}] * (t.{f} - m.m{i}) / m.s{i}" for i, f in enumerate(FEATURES)
    ) + ", CAST(0 AS DOUBLE)) AS p FROM tele_calibration t CROSS JOIN moments m CROSS JOIN solution s",
    # calibration rows up to each day, and their normal equations
    "daily_rows": """
SELECT d.day, c.* FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events) d
JOIN (SELECT t.*, date_trunc('day', e.ts) AS own_day FROM tele_calibration t JOIN events e USING (event_id)) c ON c.own_day <= d.day""",
    "daily_equations": "SELECT day, count(*) AS n, avg(energy_joules) AS y_mean, " + ", ".join(
        f"avg({f}) AS m{i}, stddev_samp({f}) AS s{i}" for i, f in enumerate(FEATURES)
    ) + ", [" + ", ".join(
        "[" + ", ".join(f"corr({f}, {g})" for g in FEATURES)
        + f", covar_samp({f}, energy_joules) / stddev_samp({f})]" for f in FEATURES
    ) + "] AS m FROM daily_rows GROUP BY day HAVING count(*) > 8",
    "daily_elimination": """
SELECT 0 AS k, day, m FROM daily_equations
UNION ALL SELECT k + 1, day, list_transform(m, lambda r, i: CASE WHEN i = k + 1
  THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
  ELSE list_transform(r, lambda v, j: v - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END)
FROM daily_elimination WHERE k < 7""",
    "daily_solution": """
SELECT q.* EXCLUDE (m), list_transform(e.m, lambda r: r[8]) AS c FROM daily_elimination e JOIN daily_equations q USING (day) WHERE k = 7""",
    # an exporter's counters, started again every midnight, and what they grow by
    "hist_counters": """
SELECT "interval", le, CAST(sum(c) OVER w AS BIGINT) AS cumulative, CAST(sum(n) OVER w AS BIGINT) AS observations,
  sum(s) OVER w AS nano
FROM (SELECT "interval", b.le, count(*) FILTER (WHERE confidence <= b.le) AS c, count(*) AS n,
        sum(CAST(round(confidence * 1e9) AS BIGINT)) AS s
      FROM fallback_rows CROSS JOIN bounds b GROUP BY 1, 2) h
WINDOW w AS (PARTITION BY date_trunc('day', "interval"), le ORDER BY "interval")""",
    "hist_increases": """
SELECT "interval", le, CASE WHEN p IS NULL THEN 0 WHEN restart THEN cumulative ELSE cumulative - p END AS c,
  CASE WHEN p IS NULL THEN 0 WHEN restart THEN nano ELSE nano - q END AS s
FROM (SELECT *, bool_or(cumulative < p OR nano < q) OVER (PARTITION BY "interval") AS restart
      FROM (SELECT *, lag(cumulative) OVER (PARTITION BY le ORDER BY "interval") AS p,
              lag(nano) OVER (PARTITION BY le ORDER BY "interval") AS q FROM hist_counters) l) r""",
    "bounds": "SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 'Infinity'::DOUBLE]::DOUBLE[]) AS le",
}


def sql(body: str, **features: str) -> str:
    """The statement with every view it needs, directly or not, in front of it."""
    texts = {n: t.replace("@features", features.get("features", "")) for n, t in VIEWS.items()}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in texts:
            if name not in needed and text is not texts[name] and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(texts[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    start = "WITH RECURSIVE " if {"elimination", "daily_elimination"} & set(needed) else "WITH "
    return start + ",\n".join(f"{n} AS ({texts[n].strip()})" for n in needed) + "\n" + body.strip()


VECTOR = """"interval", host_id, pid, comm, cpu_time_ns, ctx_switches, major_faults, minor_faults,
  gpu_jobs_submitted, gpu_active_ns, timestamp_ns"""
ESTIMATE = """energy_joules, cpu_energy_joules, memory_energy_joules, gpu_energy_joules, power_watts,
  carbon_grams_co2, confidence, is_ai_inference"""
PARTIAL = """event_id, ts, host_id, pid, tgid, probe, comm, cpu_time_ns, ctx_switches, major_faults,
  minor_faults, gpu_jobs_submitted, gpu_active_ns"""
SLIDING_MINUTE = "OVER (ORDER BY step RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)"

_SCORED_EXTRA = """energy_joules / CAST(1 AS DOUBLE) AS power_watts, energy_joules / 3.6e6 * CAST(475 AS DOUBLE) AS carbon_grams_co2,
  energy_joules, cpu_energy_joules, memory_energy_joules, gpu_energy_joules"""


def _rate(window_us: int) -> str:
    return sql(f"""
SELECT host_id, pid, make_timestamp(step) AS ts, counter_ns, increase,
  CAST(sum(increase) OVER (PARTITION BY host_id, pid ORDER BY step
    RANGE BETWEEN {window_us - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) / {window_us / 1e6:.1f}::DOUBLE AS rate_per_second
FROM (SELECT host_id, pid, ts_us - ts_us % 1000000 AS step, arg_max(counter_ns, pos) AS counter_ns,
        CAST(sum(increase) AS BIGINT) AS increase FROM grown GROUP BY 1, 2, 3) s""")


_EXEC_RESET = sql("SELECT * FROM cpu_reset")
_HISTOGRAM = """
SELECT {by} CASE WHEN isinf(b.le) THEN '+Inf' ELSE CAST(b.le AS VARCHAR) END AS le,
  count(*) FILTER (WHERE confidence <= b.le) AS cumulative, count(*) AS observations,
  round(sum(confidence), 6) AS total
FROM {rows} CROSS JOIN bounds b GROUP BY {group} b.le"""

ORACLE: dict[str, str] = {
    "partial_vectors": sql(f"SELECT {PARTIAL} FROM partial"),
    "fault_classes": sql("SELECT event_id, host_id, pid, event_kind, is_major, is_minor, is_reclaim FROM classes"),
    "pid_tgid_split": sql("SELECT event_id, (tgid << 32) + pid AS pid_tgid, pid, tgid FROM tele"),
    "ai_flag": sql(
        "SELECT event_id, comm, comm IN ('python3', 'torch', 'ollama', 'vllm') AS is_ai_inference FROM tele"
    ),
    "cpu_slices": sql("""
SELECT event_id, ts, cpu_id, prev_pid AS pid, (ts_us - before_us) * 1000 AS delta_ns, prev_state,
  prev_state = 0 AS involuntary
FROM (SELECT *, lag(ts_us) OVER w AS before_us, lag(next_pid) OVER w AS before_pid FROM tele_sched
      WINDOW w AS (PARTITION BY cpu_id ORDER BY ts, event_id)) s
WHERE before_pid = prev_pid AND before_us > 0"""),
    "decode_records": sql("""
SELECT probe, ts_us * 1000 AS timestamp_ns, pid, tgid, comm, cpu_time_ns, ctx_switches, major_faults,
  minor_faults, gpu_jobs_submitted, gpu_active_ns, false AS malformed FROM partial"""),
    "malformed_records": sql("""
SELECT probe, n_bytes, n_bytes < least_bytes AS malformed, n_bytes >= least_bytes AND n_bytes < whole_bytes AS partial,
  count(*) AS records, count(*) AS vectors, count(*) FILTER (n_bytes >= 16 AND pid > 0) AS with_header
FROM (SELECT probe, pid, least(event_id % 12 * 7, CASE probe WHEN 'mem' THEN 80 ELSE 64 END)::INTEGER AS n_bytes,
        CASE probe WHEN 'cpu' THEN 56 ELSE 40 END AS least_bytes,
        CASE probe WHEN 'mem' THEN 80 ELSE 64 END AS whole_bytes FROM tele)
GROUP BY ALL"""),
    "pid_batch_merge": sql(f"SELECT {VECTOR} FROM vectors"),
    "cpu_stats": sql("SELECT * FROM cpu_plain"),
    "cpu_stats_exec_reset": _EXEC_RESET,
    "mem_stats": sql("SELECT * FROM mem_plain"),
    "gpu_stats": sql("SELECT * FROM gpu_plain"),
    "feature_snapshot": sql("SELECT * FROM snap"),
    "snapshot_from_records": sql("SELECT * FROM snap"),
    "snapshot_tables": sql("SELECT * FROM snap"),
    "cgroup_container_id": sql("SELECT host_id, pid, container_id FROM ids"),
    "mem_limit": sql("""
SELECT host_id, pid, CASE WHEN trim(mem_limit_text) IN ('max', '9223372036854771712') THEN 0
  ELSE TRY_CAST(TRY_CAST(regexp_extract(trim(mem_limit_text), '^([0-9]+)', 1) AS UBIGINT) AS DECIMAL(20,0)) END
    AS limit_bytes,
  trim(mem_limit_text) <> 'max' AND TRY_CAST(regexp_extract(trim(mem_limit_text), '^([0-9]+)', 1) AS UBIGINT) IS NULL
    AS parse_error
FROM tele_cgroup"""),
    "container_inventory": sql("SELECT * FROM inventory"),
    "container_enrich": sql("""
SELECT "interval", host_id, pid, container_id, container_name, image_name, pod_name, pod_namespace
FROM attributed"""),
    "container_asof": sql("""
SELECT e.event_id, e.ts, e.host_id, e.pid, e.container_id, coalesce(h.name, '') AS container_name
FROM (SELECT t.event_id, t.ts, t.host_id, t.pid, i.container_id FROM tele t JOIN ids i USING (host_id, pid)) e
ASOF LEFT JOIN tele_inventory_hist h ON e.container_id = h.short_id AND e.ts >= h.snapshot_ts"""),
    "stream_counters_expiry": sql("""
SELECT make_timestamp(at_us) AS ts, host_id, pid, CAST(nj AS DOUBLE) / 1e9 AS energy_joules_total,
  CAST(nj * 475000 AS DOUBLE) / 1e3 / 1e9 / 3.6e6 AS carbon_grams_co2_total, ended
FROM (SELECT host_id, pid, at_us, nj, ended FROM (
        SELECT *, sum(energy_nj) OVER (PARTITION BY host_id, pid, session ORDER BY at_us) AS nj, false AS ended FROM silent_sessions) a
      UNION ALL
      SELECT host_id, pid, max(at_us) + 72000000000, sum(energy_nj), true FROM silent_sessions GROUP BY host_id, pid, session) u"""),
    "pid_container_asof": sql("""
SELECT e.event_id, e.ts, e.host_id, e.pid, e.container_id, coalesce(h.name, '') AS container_name
FROM (SELECT t.event_id, t.ts, t.host_id, t.pid, coalesce(v.container_id, '') AS container_id
      FROM tele t ASOF LEFT JOIN pid_versions v
      ON t.host_id = v.host_id AND t.pid = v.pid AND t.ts_us >= v.valid_us) e
ASOF LEFT JOIN tele_inventory_hist h ON e.container_id = h.short_id AND e.ts >= h.snapshot_ts"""),
    "heuristic_energy": sql(f'SELECT "interval", host_id, pid, comm, {ESTIMATE} FROM heur'),
    "records_to_energy": sql(f'SELECT "interval", host_id, pid, comm, {ESTIMATE} FROM heur'),
    "fallback_estimates": sql(
        f"""
SELECT "interval", host_id, pid, comm, confidence, is_ai_inference, {_SCORED_EXTRA},
  CASE WHEN by_model THEN '1.0.0-synthetic' ELSE 'heuristic' END AS model_version FROM fallback_rows""",
        features="live_features",
    ),
    "calibrated_energy": sql("""
SELECT event_id, greatest(CAST(5.0e-9 AS DOUBLE) * cpu_time_ns + CAST(1.0e-5 AS DOUBLE) * ctx_switches
  + CAST(2.0e-4 AS DOUBLE) * cpu_freq_mhz + CAST(5.0e-4 AS DOUBLE) * major_faults
  + CAST(5.0e-7 AS DOUBLE) * minor_faults + CAST(1.0e-12 AS DOUBLE) * rss_bytes
  + CAST(3.0e-7 AS DOUBLE) * gpu_active_ns, CAST(0 AS DOUBLE)) AS estimated_joules
FROM tele_calibration"""),
    "carbon_by_region": sql("""
SELECT region, CAST(grams AS DOUBLE) AS intensity, CAST(total_nj AS DOUBLE) / 1e9 AS energy_joules,
  CAST(total_nj * grams * 1000 AS DOUBLE) / 1e3 / 1e9 / 3.6e6 AS carbon_grams_co2
FROM (SELECT region, sum(energy_nj) AS total_nj, CASE region WHEN 'us' THEN 420 WHEN 'eu' THEN 275 WHEN 'fr' THEN 50
  WHEN 'in' THEN 720 WHEN 'cn' THEN 580 ELSE 475 END AS grams FROM nj GROUP BY region) r"""),
    "system_summary": sql("SELECT * FROM summary"),
    "threshold_bands": sql("""
SELECT "interval",
  CASE WHEN total_energy_joules >= 50 THEN 'red' WHEN total_energy_joules >= 10 THEN '#EAB839' ELSE 'green' END AS energy_band,
  CASE WHEN total_power_watts >= 20 THEN 'red' WHEN total_power_watts >= 5 THEN '#EAB839' ELSE 'green' END AS power_band,
  CASE WHEN total_carbon_grams_co2 >= 10 THEN 'red' WHEN total_carbon_grams_co2 >= 1 THEN '#EAB839' ELSE 'green' END AS carbon_band,
  CASE WHEN tracked_processes >= 50 THEN 'purple' ELSE 'blue' END AS processes_band,
  CASE WHEN avg_confidence >= 0.8 THEN 'green' WHEN avg_confidence >= 0.5 THEN '#EAB839' ELSE 'red' END AS confidence_band
FROM summary"""),
    "energy_totals": sql("""
SELECT CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS energy_joules, CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS power_watts,
  CAST(sum(energy_nj) * 475000 AS DOUBLE) / 1e3 / 1e9 / 3.6e6 AS carbon_grams_co2 FROM nj"""),
    "energy_by_component": sql("""
SELECT "interval", 'cpu' AS component, CAST(sum(cpu_nj) AS DOUBLE) / 1e9 AS energy_joules FROM nj GROUP BY 1
UNION ALL SELECT "interval", 'memory', CAST(sum(memory_nj) AS DOUBLE) / 1e9 FROM nj GROUP BY 1
UNION ALL SELECT "interval", 'gpu', CAST(sum(gpu_nj) AS DOUBLE) / 1e9 FROM nj GROUP BY 1"""),
    "energy_by_container": sql("""
SELECT "interval", container_id, CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS energy_joules FROM labelled GROUP BY 1, 2"""),
    "energy_by_container_name": sql("""
SELECT "interval", container_name, CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS energy_joules FROM labelled GROUP BY 1, 2"""),
    "gpu_energy_by_comm": sql("""
SELECT "interval", comm, CAST(sum(gpu_nj) AS DOUBLE) / 1e9 AS gpu_energy_joules FROM nj GROUP BY 1, 2"""),
    "ai_vs_general": sql("""
SELECT is_ai_inference AS is_ai_workload, CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS energy_joules,
  count(*) AS estimates FROM heur GROUP BY 1"""),
    "ai_vs_general_series": sql("""
SELECT f.is_ai_inference AS is_ai_workload, CAST(sum(e.energy_nj) AS DOUBLE) / 1e9 AS energy_joules
FROM heur e JOIN (SELECT DISTINCT "interval", host_id, pid, comm, is_ai_inference FROM heur) f
  USING ("interval", host_id, pid, comm) GROUP BY 1"""),
    "series_reducers": sql("""
SELECT component, round(avg(v), 6) AS mean_value, max(v) AS max_value, arg_max(v, "interval") AS last_value
FROM (SELECT "interval", 'cpu' AS component, CAST(sum(cpu_nj) AS DOUBLE) / 1e9 AS v FROM nj GROUP BY 1
  UNION ALL SELECT "interval", 'memory', CAST(sum(memory_nj) AS DOUBLE) / 1e9 FROM nj GROUP BY 1
  UNION ALL SELECT "interval", 'gpu', CAST(sum(gpu_nj) AS DOUBLE) / 1e9 FROM nj GROUP BY 1) s GROUP BY 1"""),
    "topk_energy": sql("""
SELECT "interval", row_number() OVER (PARTITION BY "interval" ORDER BY energy_nj DESC, host_id, pid) AS rank,
  host_id, pid, comm, energy_joules FROM heur QUALIFY rank <= 10"""),
    "top5_processes": sql("""
SELECT host_id, pid, comm, CAST((energy_nj + 500000) // 1000000 AS DOUBLE) / 1e3 AS energy_joules,
  CAST((energy_nj + 500000) // 1000000 AS DOUBLE) / 1e3 AS power_watts,
  coalesce(nullif(container_name, ''), 'System Workload') AS container,
  CASE WHEN is_ai_inference THEN 'AI Inference' ELSE 'Standard' END AS ai_task
FROM attributed WHERE "interval" = (SELECT max("interval") FROM vectors)
ORDER BY energy_nj DESC, host_id, pid LIMIT 5"""),
    "history_tail": sql("""
SELECT "interval", strftime("interval", '%H:%M') AS time, total_energy_joules AS energy, total_power_watts AS power,
  total_carbon_grams_co2 * 1e3 AS carbon_mg FROM summary ORDER BY "interval" DESC LIMIT 14"""),
    "lookback_15m": sql("""
SELECT event_id, ts, host_id, pid, probe FROM tele WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE"""),
    "metric_samples": sql("""
SELECT "interval", host_id, pid, comm, container_id, container_name, '' AS le, u.metric, u.value
FROM labelled, LATERAL (SELECT unnest([{'metric': 'energy_joules', 'value': energy_joules},
  {'metric': 'power_watts', 'value': power_watts}, {'metric': 'carbon_grams_co2', 'value': carbon_grams_co2},
  {'metric': 'cpu_energy_joules', 'value': cpu_energy_joules},
  {'metric': 'memory_energy_joules', 'value': memory_energy_joules},
  {'metric': 'gpu_energy_joules', 'value': gpu_energy_joules},
  {'metric': 'ai_workload_detected', 'value': CAST(is_ai_inference AS DOUBLE)}]) AS u) s
UNION ALL SELECT "interval", host_id, pid, comm, container_id, container_name, '', 'energy_joules_total',
  energy_joules_total FROM cum
UNION ALL SELECT "interval", host_id, pid, comm, container_id, container_name, '', 'carbon_grams_co2_total',
  carbon_grams_co2_total FROM cum
UNION ALL SELECT "interval", -1, -1, '', '', '', '', 'tracked_processes', CAST(count(*) AS DOUBLE)
FROM labelled GROUP BY "interval"
UNION ALL SELECT "interval", -1, -1, '', '', '', CASE WHEN isinf(b.le) THEN '+Inf' ELSE CAST(b.le AS VARCHAR) END,
  'estimation_confidence_bucket', CAST(count(*) FILTER (WHERE confidence <= b.le) AS DOUBLE)
FROM labelled CROSS JOIN bounds b GROUP BY "interval", b.le"""),
    "metric_sample_table": sql("""
SELECT "interval", count(*) AS series, max(energy_joules) AS largest FROM labelled GROUP BY 1"""),
    "gauge_latest": sql("""
SELECT "interval", host_id, pid, comm, container_id, container_name, energy_joules, power_watts, carbon_grams_co2,
  cpu_energy_joules, memory_energy_joules, gpu_energy_joules, CAST(is_ai_inference AS DOUBLE) AS ai_workload_detected
FROM labelled WHERE "interval" = (SELECT max("interval") FROM vectors)"""),
    "counter_cumulative": sql("SELECT * FROM cum"),
    "carbon_counter_rate": sql("""
SELECT "interval" AS ts, host_id, pid, comm, container_id, container_name,
  CAST(sum(increase) OVER (PARTITION BY host_id, pid, comm, container_id, container_name ORDER BY epoch_us("interval")
    RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS DOUBLE) / 21600.0::DOUBLE / 1e3 / 1e9 / 3.6e6
    AS carbon_grams_per_second
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY host_id, pid, comm, container_id, container_name
        ORDER BY "interval") = 1 THEN 0 ELSE energy_nj * 475000 END AS increase FROM labelled) g"""),
    "carbon_per_min": sql(f"""
SELECT make_timestamp(step) AS ts,
  CAST(sum(step_nj) {SLIDING_MINUTE} AS DOUBLE) / 1e9 / 3.6e6 * CAST(475 AS DOUBLE) AS carbon_grams_per_min
FROM (SELECT ts_us - ts_us % 1000000 AS step, sum(cpu_time_ns * 5 + minor_faults * 500 + gpu_jobs_submitted * 100000) AS step_nj
  FROM partial GROUP BY 1) s"""),
    "faults_per_min": sql(f"""
SELECT make_timestamp(step) AS ts, CAST(sum(majors) {SLIDING_MINUTE} AS BIGINT) AS major_per_min,
  CAST(sum(minors) {SLIDING_MINUTE} AS BIGINT) AS minor_per_min,
  CAST(sum(reclaims) {SLIDING_MINUTE} AS BIGINT) AS reclaim_per_min
FROM (SELECT ts_us - ts_us % 1000000 AS step, count(*) FILTER (WHERE is_major) AS majors,
  count(*) FILTER (WHERE is_minor) AS minors, count(*) FILTER (WHERE is_reclaim) AS reclaims
  FROM classes GROUP BY 1) s"""),
    "counter_rate": _rate(300_000_000),
    "counter_rate_6h": _rate(21_600_000_000),
    "confidence_histogram": sql(
        _HISTOGRAM.format(by="", rows="fallback_rows", group=""), features="live_features"
    ),
    "confidence_median": sql(
        """
SELECT day, observations, round(CASE WHEN isinf(le) THEN 0.99 ELSE
  low + (le - low) * ((rank - under) / (cumulative - under)) END, 9) AS median_confidence
FROM (SELECT *, observations * CAST(0.5 AS DOUBLE) AS rank, lag(le, 1, CAST(0 AS DOUBLE)) OVER w AS low,
        CAST(lag(cumulative, 1, 0) OVER w AS DOUBLE) AS under
      FROM (SELECT date_trunc('day', "interval") AS day, b.le, count(*) FILTER (WHERE confidence <= b.le) AS cumulative,
              count(*) AS observations FROM fallback_rows CROSS JOIN bounds b GROUP BY 1, 2) h
      WINDOW w AS (PARTITION BY day ORDER BY le)) r
WHERE cumulative >= rank QUALIFY row_number() OVER (PARTITION BY day ORDER BY le) = 1""",
        features="live_features",
    ),
    "confidence_panel": sql(
        """
SELECT "interval", observations, round(CASE WHEN isinf(le) THEN 0.99 ELSE
  low + (le - low) * ((rank - under) / (cumulative - under)) END, 9) AS median_confidence
FROM (SELECT *, observations * CAST(0.5 AS DOUBLE) AS rank, lag(le, 1, CAST(0 AS DOUBLE)) OVER w AS low,
        CAST(lag(cumulative, 1, 0) OVER w AS DOUBLE) AS under
      FROM (SELECT "interval", le, CAST(sum(c) OVER s AS BIGINT) AS cumulative, CAST(sum(n) OVER s AS BIGINT) AS observations
            FROM (SELECT "interval", b.le, count(*) FILTER (WHERE confidence <= b.le) AS c, count(*) AS n
                  FROM fallback_rows CROSS JOIN bounds b GROUP BY 1, 2) h
            WINDOW s AS (PARTITION BY le ORDER BY epoch_us("interval")
              RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)) t
      WINDOW w AS (PARTITION BY "interval" ORDER BY le)) r
WHERE cumulative >= rank QUALIFY row_number() OVER (PARTITION BY "interval" ORDER BY le) = 1""",
        features="live_features",
    ),
    "telemetry_json": sql("""
SELECT "interval", host_id, CAST(0 AS BIGINT) AS part, 'telemetry' AS type,
  strftime("interval", '%Y-%m-%dT%H:%M:%SZ') AS timestamp, count(*) AS processes, min(pid) AS first_pid,
  arg_min(container_id, pid) = '' AS first_on_host,
  count(*) FILTER (WHERE is_ai_inference) AS ai_workload_count,
  count(DISTINCT nullif(container_id, '')) AS container_count,
  CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS total_energy_joules
FROM attributed GROUP BY 1, 2"""),
    "histogram_counters": sql(
        """
SELECT "interval", 'estimation_confidence_bucket' AS metric,
  CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, CAST(cumulative AS DOUBLE) AS value FROM hist_counters
UNION ALL SELECT "interval", 'estimation_confidence_sum', '', CAST(nano AS DOUBLE) / 1e9 FROM hist_counters WHERE isinf(le)
UNION ALL SELECT "interval", 'estimation_confidence_count', '', CAST(observations AS DOUBLE) FROM hist_counters WHERE isinf(le)""",
        features="live_features",
    ),
    "confidence_rate_panel": sql(
        """
SELECT "interval", observations, CASE WHEN observations > 0 THEN round(CASE WHEN isinf(le) THEN 0.99 ELSE
  low + (le - low) * ((rank - under) / (cumulative - under)) END, 9) END AS median_confidence,
  CASE WHEN observations > 0 THEN round(nano / 1e9 / observations, 9) END AS mean_confidence,
  round(observations / 21600.0::DOUBLE, 9) AS count_per_second
FROM (SELECT *, observations * CAST(0.5 AS DOUBLE) AS rank, lag(le, 1, CAST(0 AS DOUBLE)) OVER w AS low,
        CAST(lag(cumulative, 1, 0) OVER w AS DOUBLE) AS under
      FROM (SELECT *, max(cumulative) OVER (PARTITION BY "interval") AS observations
            FROM (SELECT "interval", le, CAST(sum(c) OVER s AS BIGINT) AS cumulative, CAST(sum(s) OVER s AS DOUBLE) AS nano FROM hist_increases
                  WINDOW s AS (PARTITION BY le ORDER BY epoch_us("interval") RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)) t) o
      WINDOW w AS (PARTITION BY "interval" ORDER BY le)) r
WHERE cumulative >= rank QUALIFY row_number() OVER (PARTITION BY "interval" ORDER BY le) = 1""",
        features="live_features",
    ),
    "telemetry_parse": sql("""
SELECT a."interval", s.tracked_processes, s.total_energy_joules, a.pid, a.comm, a.container_id, a.container_name,
  a.energy_joules, a.is_ai_inference AS is_ai_workload
FROM attributed a JOIN (SELECT "interval", host_id, count(*) AS tracked_processes,
  CAST(sum(energy_nj) AS DOUBLE) / 1e9 AS total_energy_joules FROM attributed GROUP BY 1, 2) s USING ("interval", host_id)"""),
    "calibration_csv_roundtrip": sql("SELECT * FROM tele_calibration"),
    "standardize": sql(
        "SELECT event_id, "
        + ", ".join(f"round(({f} - m.a{i}) / m.s{i}, 5) AS scaled_{f}" for i, f in enumerate(FEATURES))
        + " FROM tele_calibration CROSS JOIN (SELECT "
        + ", ".join(f"avg({f}) AS a{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(FEATURES))
        + " FROM tele_calibration) m"
    ),
    "ols_single": sql("""
SELECT round(regr_slope(energy_joules, gpu_active_ns) * 1e9, 4) AS slope_nj,
  round(regr_intercept(energy_joules, gpu_active_ns), 4) AS intercept,
  round(regr_r2(energy_joules, gpu_active_ns), 6) AS r2_score,
  CAST(regr_count(energy_joules, gpu_active_ns) AS BIGINT) AS n FROM tele_calibration"""),
    "model_metrics": sql("""
SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2_score,
  round(avg(abs(y - p)), 6) AS mae_joules, min(y) AS min_joules, max(y) AS max_joules
FROM (SELECT energy_joules AS y, greatest(5.0e-9::DOUBLE * cpu_time_ns + 1.0e-5::DOUBLE * ctx_switches
  + 2.0e-4::DOUBLE * cpu_freq_mhz + 5.0e-4::DOUBLE * major_faults + 5.0e-7::DOUBLE * minor_faults
  + 1.0e-12::DOUBLE * rss_bytes + 3.0e-7::DOUBLE * gpu_active_ns, 0::DOUBLE) AS p FROM tele_calibration) q"""),
    "feature_ranges": sql(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, min({f}) AS min_value, max({f}) AS max_value FROM tele_calibration"
            for f in FEATURES
        )
    ),
    "train_model": sql(
        "SELECT 'intercept' AS feature, round(y_mean, 6) AS coefficient FROM moments UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{f}', round(c[{i + 1}], 6) FROM solution" for i, f in enumerate(FEATURES)
        )
    ),
    "incremental_ols": sql(
        " UNION ALL ".join(
            f"SELECT day AS \"interval\", n, '{f}' AS feature, round(c[{i + 1}], 5) AS coefficient FROM daily_solution"
            for i, f in enumerate(FEATURES)
        )
    ),
    "versioned_predictions": sql(
        "SELECT r.event_id, v.day AS model_interval, round(greatest(v.y_mean + "
        + " + ".join(f"v.c[{i + 1}] * (r.{f} - v.m{i}) / v.s{i}" for i, f in enumerate(FEATURES))
        + ", CASE WHEN v.day IS NOT NULL THEN CAST(0 AS DOUBLE) END), 3) AS predicted_joules "
        "FROM (SELECT t.*, date_trunc('day', e.ts) AS own_day FROM tele_calibration t JOIN events e USING (event_id)) r "
        "ASOF LEFT JOIN daily_solution v ON r.own_day > v.day"
    ),
    "feature_importance": sql(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(abs(c[{i + 1}]) / list_sum(list_transform(c, lambda v: abs(v))), 8) "
            "AS importance FROM solution"
            for i, f in enumerate(FEATURES)
        )
    ),
    "predict_energy": sql("SELECT event_id, energy_joules, round(p, 4) AS predicted_joules FROM predicted"),
    "model_roundtrip": sql("SELECT event_id, round(p, 4) AS predicted_joules FROM predicted"),
    "prediction_sample": sql("""
SELECT event_id, energy_joules AS actual, round(p, 4) AS predicted, round(abs(energy_joules - p), 4) AS error
FROM predicted ORDER BY event_id LIMIT 5"""),
    "energy_breakdown": sql(
        "SELECT event_id, energy_joules, cpu_energy_joules, memory_energy_joules, gpu_energy_joules FROM scored",
        features="calibration_features",
    ),
    "model_estimates": sql(
        f"""
SELECT host_id, pid, comm, {_SCORED_EXTRA}, CAST(0.85 AS DOUBLE) AS confidence,
  comm IN ('python3', 'torch', 'ollama', 'vllm') AS is_ai_inference, '1.0.0-synthetic' AS model_version FROM scored""",
        features="snap",
    ),
    "stream_decode": sql("""
SELECT probe, CASE WHEN header THEN ts_us * 1000 ELSE 0 END AS timestamp_ns, CASE WHEN header THEN pid ELSE 0 END AS pid,
  CASE WHEN header THEN tgid ELSE 0 END AS tgid, CASE WHEN whole THEN comm ELSE '' END AS comm,
  CASE WHEN whole THEN cpu_time_ns ELSE 0 END AS cpu_time_ns, CASE WHEN whole THEN ctx_switches ELSE 0 END AS ctx_switches,
  CAST(0 AS BIGINT) AS major_faults, CASE WHEN whole THEN minor_faults ELSE 0 END AS minor_faults,
  CASE WHEN whole THEN gpu_jobs_submitted ELSE 0 END AS gpu_jobs_submitted, CAST(0 AS BIGINT) AS gpu_active_ns,
  NOT whole AS malformed, CASE WHEN NOT whole THEN CAST(n_bytes AS INTEGER) END AS raw_bytes
FROM (SELECT *, n_bytes >= 16 AS header, n_bytes >= CASE probe WHEN 'cpu' THEN 56 ELSE 40 END AS whole
      FROM (SELECT *, least(event_id % 12 * 7, CASE probe WHEN 'mem' THEN 80 ELSE 64 END) AS n_bytes FROM partial) n) w"""),
    "stream_telemetry_parse": sql("""
SELECT "interval", tracked_processes, CAST(sum(tracked_processes) AS BIGINT) AS processes, CAST(sum(nj) AS BIGINT) AS nj,
  CAST(NULL AS BIGINT) AS unreadable
FROM (SELECT "interval", host_id, count(*) AS tracked_processes, sum(energy_nj) AS nj FROM attributed GROUP BY 1, 2) f
GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FROM (SELECT DISTINCT "interval", host_id FROM attributed) d"""),
    "stream_gauges": sql("""
SELECT "interval", host_id, pid, comm, energy_joules, power_watts, carbon_grams_co2, cpu_energy_joules,
  memory_energy_joules, gpu_energy_joules, false AS stale FROM heur
UNION ALL SELECT "interval" + INTERVAL 1 HOUR, host_id, pid, comm, NULL, NULL, NULL, NULL, NULL, NULL, true
FROM (SELECT *, lead("interval") OVER (PARTITION BY host_id, pid, comm ORDER BY "interval") AS later FROM heur) h
WHERE later IS NULL OR later > "interval" + INTERVAL 1 HOUR"""),
    "stream_fanin": sql(f"SELECT {PARTIAL} FROM partial"),
    "stream_pid_merge": sql(f"SELECT {VECTOR} FROM vectors"),
    "stream_counters": sql("""
SELECT host_id, pid, comm, CAST(sum(e) AS DOUBLE) / 1e9 AS energy_joules_total,
  CAST(sum(e) * 475000 AS DOUBLE) / 1e3 / 1e9 / 3.6e6 AS carbon_grams_co2_total
FROM (SELECT host_id, pid, comm, cpu_time_ns * 5 + minor_faults * 500 + gpu_jobs_submitted * 100000 AS e FROM partial) p
GROUP BY 1, 2, 3"""),
    "stream_exec_reset": _EXEC_RESET,
    "stream_enriched": sql("""
SELECT t.event_id, t.host_id, t.pid, i.container_id, coalesce(v.name, '') AS container_name,
  coalesce(v.pod_name, '') AS pod_name, CAST(CASE region WHEN 'us' THEN 420 WHEN 'eu' THEN 275 WHEN 'fr' THEN 50
  WHEN 'in' THEN 720 WHEN 'cn' THEN 580 ELSE 475 END AS DOUBLE) AS intensity
FROM tele t JOIN ids i USING (host_id, pid) LEFT JOIN inventory v ON v.short_id = i.container_id"""),
    "stream_energy": sql("""
SELECT event_id, host_id, pid, comm, e / 1e9 AS energy_joules, cpu_time_ns * 5 / 1e9 AS cpu_energy_joules,
  minor_faults * 500 / 1e9 AS memory_energy_joules, gpu_jobs_submitted * 100000 / 1e9 AS gpu_energy_joules,
  e / 1e9 AS power_watts, e / 1e9 / 3.6e6 * CAST(475 AS DOUBLE) AS carbon_grams_co2, CAST(0.3 AS DOUBLE) AS confidence,
  comm IN ('python3', 'torch', 'ollama', 'vllm') AS is_ai_inference
FROM (SELECT *, cpu_time_ns * 5 + minor_faults * 500 + gpu_jobs_submitted * 100000 AS e FROM partial) p"""),
    "stream_summary": sql("SELECT * FROM summary"),
    "stream_two_sinks": sql("""
SELECT "interval", m.metric, CAST(count(*) AS BIGINT) AS entries
FROM vectors CROSS JOIN (SELECT unnest(['energy_joules', 'power_watts', 'carbon_grams_co2', 'cpu_energy_joules',
  'memory_energy_joules', 'gpu_energy_joules', 'ai_workload_detected', 'energy_joules_total',
  'carbon_grams_co2_total', 'feed']) AS metric) m
GROUP BY 1, 2
UNION ALL SELECT DISTINCT "interval", 'tracked_processes', CAST(1 AS BIGINT) FROM vectors
UNION ALL SELECT DISTINCT "interval", 'estimation_confidence_bucket', CAST(10 AS BIGINT) FROM vectors"""),
}
ORACLE["stream_samples"] = ORACLE["metric_samples"]
ORACLE["stream_topk"], ORACLE["stream_history"] = ORACLE["topk_energy"], ORACLE["history_tail"]
ORACLE["stream_summary_chained"] = ORACLE["stream_summary"]
for _name in ("mem_stats", "gpu_stats", "feature_snapshot", "container_asof"):
    ORACLE[f"stream_{_name}"] = ORACLE[_name]
