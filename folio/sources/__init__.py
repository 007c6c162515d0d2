from folio.sources.tables import attach, known_size, load, reading_text, spread

__all__ = ["attach", "known_size", "load", "reading_text", "spread"]
