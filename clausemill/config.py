"""Settings, read from the environment on the driver."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Every field can be overridden by the environment variable of its name in upper case."""

    chunk_size_chars: int = 1200
    chunk_overlap_chars: int = 200
    default_top_k: int = 6
    rrf_k: int = 60
    candidate_pool: int = 25
    max_context_chunks: int = 14
    fuzzy_match_threshold: float = 0.92
    fuzzy_max_length_ratio: float = 1.35
    min_quote_chars: int = 12
    reject_unchecked_options: bool = True
    strip_page_furniture: bool = True
    embedding_dimension: int = 384
    embedding_batch_size: int = 16
    embedding_query_prefix: str = ""
    embedding_document_prefix: str = ""
    use_fake_embeddings: bool = False
    embedding_model_path: str = ""
    use_fake_llm: bool = False
    llm_base_url: str = "http://127.0.0.1:8000/v1"
    llm_api_key: str = "local"
    llm_model: str = "gpt-oss-120b"
    llm_timeout_seconds: float = 180.0
    llm_max_output_tokens: int = 4096

    @classmethod
    def from_environment(cls, environ: dict[str, str] | None = None) -> Settings:
        environ = dict(os.environ) if environ is None else environ
        kinds = {"int": int, "float": float, "str": str, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on")}
        found = {f.name: kinds[f.type](environ[f.name.upper()]) for f in dataclasses.fields(cls) if f.name.upper() in environ}
        return cls(**found)

    def __post_init__(self) -> None:
        if self.chunk_overlap_chars >= self.chunk_size_chars:
            raise ValueError("overlap must be smaller than chunk_size")
