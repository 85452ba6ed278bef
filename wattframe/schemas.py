"""Fixed schemas of the tables that cross a boundary."""

from __future__ import annotations

EVENTS = """
    event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string
"""

# what one captured record turns into
PARTIAL_VECTOR = """
    probe string, timestamp_ns bigint, pid bigint, tgid bigint, comm string, cpu_time_ns bigint,
    ctx_switches bigint, major_faults bigint, minor_faults bigint, gpu_jobs_submitted bigint,
    gpu_active_ns bigint, malformed boolean
"""

# per-process statistics of each probe
STATS = {
    "cpu": """
        host_id bigint, pid bigint, total_cpu_time_ns bigint, ctx_switches bigint,
        voluntary_ctx_switches bigint, involuntary_ctx_switches bigint, last_cpu_id bigint,
        last_seen_ns bigint, comm string""",
    "mem": """
        host_id bigint, pid bigint, major_faults bigint, minor_faults bigint,
        total_faults bigint, direct_reclaim_count bigint, last_fault_ns bigint,
        estimated_rss_pages bigint, comm string""",
    "gpu": """
        host_id bigint, pid bigint, total_jobs_submitted bigint, total_gpu_active_ns bigint,
        last_submit_ns bigint, last_complete_ns bigint, active_jobs bigint, comm string""",
}

INVENTORY_DOC = """
    array<struct<Id: string, Names: array<string>, Image: string, Labels: map<string,string>>>
"""

TELEMETRY_DOC = """
    timestamp string, type string,
    process_data array<struct<
        pid: bigint, comm: string, container_id: string, container_name: string,
        energy_joules: double, power_watts: double, carbon_grams_co2: double,
        cpu_energy_joules: double, memory_energy_joules: double, gpu_energy_joules: double,
        confidence: double, is_ai_workload: boolean>>,
    summary struct<
        total_energy_joules: double, total_power_watts: double, total_carbon_grams_co2: double,
        tracked_processes: bigint, ai_workload_count: bigint, container_count: bigint,
        avg_confidence: double>
"""
