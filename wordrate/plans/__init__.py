"""Registered queries over the driver tables (importing the modules fills the registry)."""

from . import chat_q, files_q, io_q, norms_q, requests_q, scoring_q, splits_q, stats_q, stream_q, text_q  # noqa: F401
from .registry import HEADLINE, ORACLE, QUERIES  # noqa: F401
