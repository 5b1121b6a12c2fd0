"""Import every query module, in survey order, to fill the registry."""

from colloquy.catalog import REGISTRY
from colloquy.catalog import q_accounts, q_engine_first, q_events, q_first, q_given_text, q_guards, q_long_meetings, q_long_polish, q_match, q_recall, q_render, q_second, q_signals, q_sources, q_strategies, q_text, q_third  # noqa: F401

__all__ = ["REGISTRY"]
