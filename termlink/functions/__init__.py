"""Column functions."""

from .text import cache_key, is_abbreviation, normalise, slot_spellings, spans, template_slot, tokens

__all__ = ["cache_key", "is_abbreviation", "normalise", "slot_spellings", "spans", "template_slot", "tokens"]
