"""All queries over the driver tables, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import outputs, prompts, records, requests, texts

QUERIES = outputs.QUERIES | prompts.QUERIES | records.QUERIES | requests.QUERIES | texts.QUERIES
ORACLES = outputs.ORACLES | prompts.ORACLES | records.ORACLES | requests.ORACLES | texts.ORACLES
