"""Settings of the engine.  Fixed values: they have to equal the documented
behaviour for results to agree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    time_window_sec: int = 60
    crs_window_sec: int = 30
    max_chunk_lines: int = 50
    chunk_overlap_lines: int = 3
    storm_gap_sec: int = 300
    domino_lookback_hours: int = 24
    prefilter_limit: int = 500
    prefilter_window_minutes: int = 30
    top_k: int = 10
    rrf_k: int = 60
    bm25_weight: float = 0.4
    dense_weight: float = 0.6
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    weight_keyword: float = 40
    weight_bm25: float = 30
    weight_dense: float = 20
    weight_temporal: float = 10
    high: float = 80
    medium: float = 60
    low: float = 40
    temporal_bonus: int = 10
    cry_wolf_threshold: int = 100
    symptom_bonus: int = 20
    infra_categories: tuple[str, ...] = ("OS", "DISK", "NETWORK", "CRS")
    logical_codes: tuple[str, ...] = ("ORA-00942", "ORA-01031", "ORA-01403", "ORA-00001")
    severities: tuple[str, ...] = ("UNKNOWN", "INFO", "WARNING", "ERROR", "CRITICAL")
    layer_depth: dict[str, int] = field(
        default_factory=lambda: {
            "STORAGE": 0, "INFRA": 0, "OS": 1, "NETWORK": 1, "ASM": 2, "CRS": 2, "BACKUP": 2, "SECURITY": 2,
            "AUDIT": 3, "RDBMS": 3, "DB": 3, "CLIENT": 5, "UNKNOWN": 9,
        }
    )


DEFAULT = Settings()
#: where a settings file has them, and whole names elsewhere
FILE_NAMES = {
    "chunking.time_window_sec": "time_window_sec", "chunking.crs_window_sec": "crs_window_sec", "chunking.max_chunk_lines": "max_chunk_lines", "chunking.chunk_overlap_lines": "chunk_overlap_lines",
    "retrieval.top_k": "top_k", "retrieval.rrf_k": "rrf_k", "retrieval.bm25_weight": "bm25_weight", "retrieval.dense_weight": "dense_weight", "bm25.k1": "bm25_k1", "bm25.b": "bm25_b",
    "bm25.epsilon": "bm25_epsilon", "scoring.high": "high", "scoring.medium": "medium", "scoring.low": "low",
}


def load_settings(path: str) -> Settings:
    """Settings of a JSON or YAML file, the documented ones for what it
    leaves out.  Names are those of Settings, or sections of FILE_NAMES; what
    is neither is ignored.  YAML needs a YAML reader to be installed."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        raw = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError(f"{path} isn't JSON, and no YAML reader is installed") from missing
        raw = yaml.safe_load(text)
    flat = {}
    for name, value in (raw or {}).items():
        if isinstance(value, dict) and name not in Settings.__dataclass_fields__:
            flat |= {FILE_NAMES.get(f"{name}.{k}", k): v for k, v in value.items()}
        else:
            flat[name] = value
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in Settings.__dataclass_fields__ and v is not None}
    return Settings(**known)
