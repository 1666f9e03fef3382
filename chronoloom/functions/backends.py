"""Which model and which program a run uses, and how many work at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of backends, and the model that stands for tags of another server.
DEFAULT_SERVED_MODEL = "mlx-community/Qwen3-VL-8B-Instruct-4bit"
CPU_BACKEND, NATIVE_BACKEND = "faster", "cpp"
MOST_WORKERS = 4


def routed_model(model: Column, default: str = DEFAULT_SERVED_MODEL) -> Column:
    """A tag (name:size) names no model of this server and becomes its default; org/name passes, whatever follows."""
    return F.when(model.contains(":") & ~model.contains("/"), F.lit(default)).otherwise(model)


def worker_count(backend: Column, cores: Column) -> Column:
    """Half the cores, one to MOST_WORKERS, where the CPU works; one where a single device does."""
    half = F.floor(cores / 2).cast("int")
    return F.when(backend == CPU_BACKEND, F.greatest(F.lit(1), F.least(F.lit(MOST_WORKERS), half))).otherwise(1)


def resolved_backend(backend: Column, system: Column, machine: Column, native: Column) -> Column:
    """What ``auto`` stands for: the native program on its own hardware if it is there, else the CPU's; other names stay."""
    own = (system == "Darwin") & (machine == "arm64") & native
    return F.when(backend != "auto", backend).when(own, NATIVE_BACKEND).otherwise(CPU_BACKEND)
