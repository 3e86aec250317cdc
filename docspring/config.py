"""Settings that change results, from arguments, environment or defaults, validated once on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from functools import lru_cache


def _of(default, least=None, most=None):
    return field(default=default, metadata={"least": least, "most": most})


@dataclass(frozen=True)
class Settings:
    """Environment variables carry the prefix DOCSPRING_ and the field's name in upper case."""

    chunk_size: int = _of(1200, 200)
    chunk_overlap: int = _of(200, 0)
    top_k: int = _of(5, 1, 50)
    embed_batch_size: int = _of(250, 1, 250)
    embed_max_tokens: int = _of(18000, 1024, 20000)
    hybrid: bool = True
    dense_pool: int = _of(24, 5, 200)
    sparse_pool: int = _of(24, 5, 200)
    rrf_k: int = _of(60, 1, 300)
    rrf_dense_weight: float = _of(1.0, 0.1, 5.0)
    rrf_sparse_weight: float = _of(1.0, 0.1, 5.0)
    cross_encoder_model: str | None = None
    cross_encoder_top_n: int = _of(24, 1, 120)
    metadata_boost: bool = True
    page_filter_min: int | None = _of(None, 1)
    page_filter_max: int | None = _of(None, 1)
    cache_enabled: bool = True
    cache_threshold: float = _of(0.92, 0.5, 1.0)
    cache_max_entries: int = _of(256, 16, 10000)
    cache_path: str = "data/answer_cache"
    multi_hop: bool = True
    plotting: bool = True
    index_tables: bool = True
    index_images: bool = True
    image_min_area_px: int = _of(8192, 0, 4_000_000)
    require_figure_label: bool = True
    patch_size_px: int = _of(256, 64)
    patch_stride_px: int = _of(192, 16)
    patch_dpi: int = _of(144, 36, 600)
    patch_max_pages: int = _of(40, 1)
    visual_prefetch: int = _of(96, 1, 500)
    visual_top_k: int = _of(6, 1, 50)
    maxsim: bool = True
    maxsim_slots: int = _of(8, 2, 32)
    index_path: str = "data/index"
    collection: str = "chunks"

    def __post_init__(self):
        for f in fields(self):
            value, least, most = getattr(self, f.name), f.metadata.get("least"), f.metadata.get("most")
            if value is not None and ((least is not None and value < least) or (most is not None and value > most)):
                raise ValueError(f"{f.name}={value!r} is outside {least} to {most}")

    @staticmethod
    def from_env(env: dict[str, str] | None = None, **given) -> Settings:
        env, out = os.environ if env is None else env, dict(given)
        for f in fields(Settings):
            raw = env.get(f"DOCSPRING_{f.name.upper()}")
            if f.name in out or raw is None:
                continue
            kind = str(f.type)
            if kind.startswith("bool"):
                out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif raw.strip() == "" and "None" in kind:
                out[f.name] = None
            else:
                out[f.name] = int(raw) if kind.startswith("int") else float(raw) if kind.startswith("float") else raw
        return Settings(**out)

    def snapshot(self, full_paths: bool = False) -> dict:
        """For reports: what retrieval depends on. Paths by their last part unless asked otherwise."""
        names = "chunk_size chunk_overlap top_k hybrid dense_pool sparse_pool rrf_k rrf_dense_weight rrf_sparse_weight cross_encoder_model cross_encoder_top_n metadata_boost page_filter_min page_filter_max cache_enabled cache_threshold multi_hop index_tables index_images image_min_area_px require_figure_label collection index_path"
        out = {k: getattr(self, k) for k in names.split()}
        if not full_paths:
            out["index_path"] = os.path.basename(self.index_path.rstrip("/"))
        return out


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    return Settings.from_env()


def clear_settings_cache() -> None:
    get_settings.cache_clear()
