"""Import every module with a registered query, to fill the registry."""

from colloquy.llm import filter_audit, html_text, media, packing, pieces, quality, simhash, suffixes, topk, toxicity, url_filters, warc, whitening  # noqa: F401
from colloquy.llm.common import REGISTRY

__all__ = ["REGISTRY"]
