"""Explicit schemas of the catalogue tables and of what scans and searches return."""

from __future__ import annotations

EMAILS = "id BIGINT NOT NULL, message_id STRING NOT NULL, date BIGINT NOT NULL, sender STRING, recipient STRING, subject STRING, body_text STRING, body_length BIGINT NOT NULL, embedded BOOLEAN NOT NULL, mailing_list BOOLEAN NOT NULL"
EMAIL_SOURCES = "source STRING NOT NULL, message_id STRING NOT NULL, locator STRING NOT NULL"
EMAIL_VECTORS = "id BIGINT NOT NULL, embedding ARRAY<FLOAT> NOT NULL"
SCAN_PAIRS = "source STRING, message_id STRING, locator STRING, path STRING, offset BIGINT"
SCAN_STATUS = "source STRING, path STRING, ok BOOLEAN, error STRING"
#: ``kind``: a message; a file (or range of one) that was read or failed; a file that is gone.
SCAN_EVENTS = "source STRING, path STRING, kind STRING, message_id STRING, locator STRING, offset BIGINT, error STRING"
SEARCH_RESULT = "rank INT, score DOUBLE, message_id STRING, `from` STRING, `to` STRING, subject STRING, date STRING, body_preview STRING, is_mailing_list BOOLEAN"
