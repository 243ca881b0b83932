"""Column expressions: text, entities, calendar and visit helpers."""
