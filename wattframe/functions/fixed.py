"""Fixed values.  Results are only comparable if these stay as they are."""

from __future__ import annotations

# --- heuristic coefficients, as whole nanojoules ---------------------------
NJ_PER_CPU_NS = 5
NJ_PER_FAULT = 500
NJ_PER_GPU_JOB = 100_000
NJ_PER_JOULE = 1e9

# --- energy to carbon ------------------------------------------------------
JOULES_PER_KWH = 3.6e6
DEFAULT_INTENSITY = 475.0  # gCO2 per kWh, world average
REGION_INTENSITY = {"us": 420.0, "eu": 275.0, "fr": 50.0, "in": 720.0, "cn": 580.0}

# --- estimate constants ----------------------------------------------------
HEURISTIC_CONFIDENCE = 0.3
MODEL_CONFIDENCE = 0.85
HEURISTIC_VERSION = "heuristic"
MODEL_VERSION = "1.0.0-synthetic"
WINDOW_SECONDS = 1.0

# --- process names counted as AI/ML workloads (exact, case-sensitive) ------
AI_COMMS = (
    "python",
    "python3",
    "torch",
    "tensorflow",
    "triton",
    "onnxruntime",
    "trtexec",
    "nvidia-smi",
    "ollama",
    "vllm",
    "mlserver",
    "bentoml",
)

# --- model features, in order, with the published calibration coefficients -
FEATURES = (
    "cpu_time_ns",
    "ctx_switches",
    "cpu_freq_mhz",
    "major_faults",
    "minor_faults",
    "rss_bytes",
    "gpu_active_ns",
)
CALIBRATED_COEFFICIENTS = {
    "cpu_time_ns": 5.0e-9,
    "ctx_switches": 1.0e-5,
    "cpu_freq_mhz": 2.0e-4,
    "major_faults": 5.0e-4,
    "minor_faults": 5.0e-7,
    "rss_bytes": 1.0e-12,
    "gpu_active_ns": 3.0e-7,
}
COMPONENTS = {
    "cpu": ("cpu_time_ns", "ctx_switches", "cpu_freq_mhz"),
    "memory": ("major_faults", "minor_faults", "rss_bytes"),
    "gpu": ("gpu_active_ns",),
}
TARGET = "energy_joules"

# --- containers ------------------------------------------------------------
CONTAINER_ID_PATTERNS = (
    r"/docker/([a-f0-9]{12,64})",
    r"/cri-containerd-([a-f0-9]{12,64})\.scope",
    r"/libpod-([a-f0-9]{12,64})\.scope",
    r"-([a-f0-9]{12,64})\.scope",
    r"([a-f0-9]{64})",
)
SHORT_ID_LENGTH = 12
POD_NAME_LABEL = "io.kubernetes.pod.name"
POD_NAMESPACE_LABEL = "io.kubernetes.pod.namespace"
NO_MEMORY_LIMIT = ("max", "9223372036854771712")

# --- pages, records --------------------------------------------------------
PAGE_BYTES = 4096
MAX_TRACKED_PIDS = 16384

# --- metric series ---------------------------------------------------------
HOST_CONTAINER = "host"
CONFIDENCE_BOUNDS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99)

# --- dashboard -------------------------------------------------------------
SYSTEM_WORKLOAD = "System Workload"
AI_BADGE = "AI Inference"
STANDARD_BADGE = "Standard"
HISTORY_POINTS = 14
# panel -> base colour, then (lower bound, colour) steps
THRESHOLDS = {
    "energy": ("green", ((10.0, "#EAB839"), (50.0, "red"))),
    "power": ("green", ((5.0, "#EAB839"), (20.0, "red"))),
    "carbon": ("green", ((1.0, "#EAB839"), (10.0, "red"))),
    "processes": ("blue", ((50.0, "purple"),)),
    "confidence": ("red", ((0.5, "#EAB839"), (0.8, "green"))),
}
