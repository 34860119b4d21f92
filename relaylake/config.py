"""Limits of a relay, with their defaults and environment overrides."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

CREATED_AT_WINDOW = 172_800
AUTH_WINDOW = 600
MAX_AUTHENTICATED = 16
SUPPORTED_NIPS = [1, 9, 11, 17, 40, 42, 45, 62, 70, 77]


@dataclass(frozen=True)
class Limits:
    listen: str = "0.0.0.0:8080"
    max_connections: int = 1024
    max_subscriptions: int = 20
    max_filters: int = 10
    max_limit: int = 500
    max_message_bytes: int = 131_072
    max_subid_length: int = 64
    max_filter_values: int = 256
    relay_url: str = ""
    compaction_interval: int = 21_600
    compaction_tombstones: int = 1000
    max_neg_records: int = 500_000
    max_event_tags: int = 2000
    max_content_bytes: int = 51_200
    content_bytes_by_kind: Mapping[int, int] = field(default_factory=dict)
    pending_deletions: int = 150_000

    def content_limit(self, kind: int) -> int:
        return self.content_bytes_by_kind.get(kind, self.max_content_bytes)

    @property
    def url(self) -> str:
        return self.relay_url or f"ws://{self.listen}"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Limits:
        """RELAY_<FIELD> of the environment; a number that doesn't parse keeps its default.

        RELAY_CONTENT_BYTES_BY_KIND is "kind:bytes,kind:bytes"; a malformed one raises ValueError.
        """
        made: dict = {}
        for f in fields(cls):
            raw = env.get(f"RELAY_{f.name.upper()}")
            if raw is None:
                continue
            if f.name == "content_bytes_by_kind":
                pairs = [p.split(":") for p in raw.split(",") if p.strip()]
                if any(len(p) != 2 for p in pairs):
                    raise ValueError(f"malformed per-kind content limits: {raw!r}")
                made[f.name] = {int(k): int(v) for k, v in pairs}
            elif f.type == "str":
                made[f.name] = raw
            else:
                try:
                    made[f.name] = int(raw)
                except ValueError:
                    continue
        if "max_subid_length" in made:
            made["max_subid_length"] = min(64, max(1, made["max_subid_length"]))
        return cls(**made)
